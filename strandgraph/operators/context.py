"""Context packages: what is known about every candidate, gathered for all candidates at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.scalar import comparisons, conjuncts, predicate_status, row_matches
from strandgraph.store import stash


def packages(candidates: DataFrame, dimensions: dict[str, DataFrame], key: str, evidence: str) -> DataFrame:
    """(key, one sorted evidence array per dimension, complete): a row per candidate.

    Each dimension is (key, evidence); complete lists the dimensions that have
    any. All dimensions are grouped together, so one shuffle serves them all,
    however many there are.
    """
    tagged = [d.select(F.col(key), F.lit(name).alias("d_"), F.col(evidence).cast("string").alias("e_")) for name, d in dimensions.items()]
    every = reduce(DataFrame.union, tagged, candidates.select(F.col(key), F.lit(None).cast("string"), F.lit(None).cast("string")).toDF(key, "d_", "e_"))
    arrays = [F.array_sort(F.collect_set(F.when(F.col("d_") == name, F.col("e_")))).alias(name) for name in dimensions]
    out = every.groupBy(key).agg(F.bool_or(F.col("d_").isNull()).alias("asked_"), *arrays).where("asked_").drop("asked_")
    return out.withColumn("complete", F.array_compact(F.array(*[F.when(F.size(name) > 0, F.lit(name)) for name in dimensions])))


def over_limit(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, n) of packages with more rows than a package may hold; they are reported, none is cut."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)


#: Accesses that ask the same are dealt over so many tasks, as what they are given may be long.
DEALT = 8


def split_by_predicate(accesses: DataFrame, entries: DataFrame, table: str, predicate: str, row: str, entry_id: str, access_id: str, shown: Callable[[str], Column] = F.col) -> DataFrame:
    """(access id, status, applicable, context): a table's entries that an access's
    predicate surely takes, and those that it may take.

    An EXACT predicate takes the entries that satisfy it and no others; with a
    PARTIAL one the entries that satisfy the known parts are context; without
    any known part all entries are. What is asked of a table meets its entries
    once, however many accesses ask it; ``shown`` makes of the two arrays what
    is to be returned, once too.
    """
    a = accesses.select(access_id, F.col(table).alias("t_"), F.col(predicate).alias("p_"))
    read = a.select(F.col("p_").alias("q_")).distinct().withColumn("parts_", conjuncts("q_")).withColumn("found_", comparisons(F.col("parts_")))
    read = stash(read.select("q_", "found_", predicate_status(F.col("parts_"), F.col("found_")).alias("status")), "predicates")
    asks = F.array_sort(F.collect_list(F.struct("t_", "found_"))).alias("asks_")
    who = stash(a.join(read, F.col("p_").eqNullSafe(F.col("q_"))).groupBy(access_id, "status").agg(asks), "accesses")
    asked = stash(who.select("status", "asks_").distinct(), "asks")
    each = asked.select("status", "asks_", F.explode("asks_").alias("ask_")).select("status", "asks_", "ask_.*")
    # Few bytes in, many out: numbers of tasks are given, as Spark would take one for so little to read.
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = entries.withColumnRenamed(table, "t_").where(F.col(entry_id).isNotNull()).repartition(n, entry_id).join(each, "t_")
    fits = (F.coalesce(F.size("found_") <= 0, F.lit(True)) | row_matches(row, F.col("found_")))
    exact = F.col("status") == "EXACT"
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(entry_id))))
    split = j.groupBy("status", "asks_").agg(pick(fits & exact).alias("applicable"), pick(fits & ~exact).alias("context"))
    none = F.array().cast(split.schema["context"].dataType)
    split = asked.join(split, ["status", "asks_"], "left").withColumns({c: F.coalesce(c, none) for c in ("applicable", "context")})
    split = stash(split.select("status", "asks_", shown("applicable").alias("applicable"), shown("context").alias("context")), "split")
    dealt = split.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    who = who.withColumn("deal_", F.pmod(F.xxhash64(access_id), F.lit(DEALT)).cast("int"))
    keys = ["status", "asks_", "deal_"]
    return who.repartition(n, *keys).join(dealt.hint("shuffle_hash"), keys).select(access_id, "status", "applicable", "context")


def named_evidence(rows: DataFrame, keys: list[str], id_col: str, name: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """(keys, id, name, evidence) with an item's evidence together, and the items (keys, id, names) that go by several names."""
    g = rows.groupBy(*keys, id_col).agg(F.array_sort(F.collect_set(name)).alias("names"), F.array_sort(F.collect_set(evidence)).alias("evidence"))
    one = F.size("names") == 1
    return g.where(one).select(*keys, id_col, F.col("names")[0].alias(name), "evidence"), g.where(~one).select(*keys, id_col, "names")


def decided_outcome(candidates: DataFrame, decisions: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, outcome, origin): the candidate's own outcome before the graph's; rows with neither go."""
    own, graph = F.col(f"c_.{outcome}"), F.col(f"d_.{outcome}")
    j = candidates.alias("c_").join(decisions.alias("d_"), F.col(f"c_.{key}") == F.col(f"d_.{key}"), "left")
    return j.select(F.col(f"c_.{key}").alias(key), F.coalesce(own, graph).alias(outcome), F.when(own.isNotNull(), "CANDIDATE").otherwise("GRAPH").alias("origin")).where(F.col(outcome).isNotNull())


def table_effects(rows: DataFrame, keys: list[str], scope: str, evidence: str, unapproved: str = "PROGRAM_CONTEXT") -> DataFrame:
    """(keys, scope, evidence, approved): evidence merged; what only the program's context shows is not approved."""
    return rows.groupBy(*keys, scope).agg(F.array_sort(F.collect_set(evidence)).alias("evidence")).withColumn("approved", F.col(scope) != unapproved)


def batch_status(rows: DataFrame, keys: list[str], content: list[str], confirmed: Column) -> DataFrame:
    """(keys, versions, status): INCONSISTENT if a key's rows differ in content (nulls compared), else CONFIRMED if any row is, else INFERRED."""
    versions = F.count_distinct(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    out = rows.groupBy(*keys).agg(versions.alias("versions"), F.bool_or(F.coalesce(confirmed, F.lit(False))).alias("any_"))
    return out.withColumn("status", F.when(F.col("versions") > 1, "INCONSISTENT").when(F.col("any_"), "CONFIRMED").otherwise("INFERRED")).drop("any_")


def lost_facts(facts: DataFrame, package: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Facts settled on a candidate (value not null) that its package lacks or holds otherwise; whole packages give none."""
    p = package.select(*keys, F.col(value).alias("held"))
    return facts.where(F.col(value).isNotNull()).join(p, keys, "left").where(~F.col(value).eqNullSafe(F.col("held")))


def declared_values(decisions: DataFrame, operands: str, items: DataFrame, scope: list[str], name: str, value: str, id_col: str) -> DataFrame:
    """(id, operand, value): the declared value of each operand whose name one item alone has in the scope."""
    one = items.groupBy(*scope, F.upper(F.trim(name)).alias("key_")).agg(F.count("*").alias("n_"), F.min(value).alias(value)).where("n_ = 1").drop("n_")
    o = decisions.select(id_col, *scope, F.explode(operands).alias("operand")).withColumn("key_", F.upper(F.trim("operand")))
    return o.join(one.where(F.col(value).isNotNull()), [*scope, "key_"]).select(id_col, "operand", value)
