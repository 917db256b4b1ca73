"""Dependency edges and a property graph derived from program rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.resolve import normal_name, resolve_names


def control_edges(targets: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jumps to their paragraphs by normal name within the program.

    ``targets``: program, paragraph, statement_id, construct, target (name).
    Gives the edges (program, from, to, construct, primary, evidence), one per
    triple with the lowest statement id first, and the warnings (program,
    paragraph, target, reason): AMBIGUOUS, UNRESOLVED or SELF.
    """
    index = paragraphs.select("program", F.lit(None).cast("string").alias("q"), F.col("name").alias("s"), normal_name(F.col("name")).alias("t"))
    r = resolve_names(targets.withColumnRenamed("target", "token"), index, "token", ["program"], "q", "s", "t")
    own = F.col("target") == normal_name(F.col("paragraph"))
    reason = F.when(F.col("resolution").isin("AMBIGUOUS", "UNRESOLVED"), F.col("resolution")).when(own, "SELF")
    r = r.withColumn("reason", reason)
    edges = r.where("reason is null").groupBy("program", F.col("paragraph").alias("from"), F.col("target").alias("to"), "construct").agg(F.min("statement_id").alias("primary"), F.array_sort(F.collect_set("statement_id")).alias("evidence"))
    return edges, r.where("reason is not null").select("program", "paragraph", F.col("token").alias("target"), "reason")


def data_edges(writes: DataFrame, reads: DataFrame, keys: list[str], place: str, rule: str | None = None) -> DataFrame:
    """(scope keys but the last, from, to, names, confidence): a place that
    writes a name and another that reads it.

    ``keys`` are the scope and the name. Both sides are first reduced to
    distinct rows, so a name is met once per pair of places. confidence is 0.8,
    or 0.7 where a ``rule`` column says SIMPLE for any of the names.
    """
    extra = [rule] if rule else []
    w = writes.select(*keys, F.col(place).alias("from"), *[F.col(c).alias("rw_") for c in extra]).distinct()
    r = reads.select(*keys, F.col(place).alias("to"), *[F.col(c).alias("rr_") for c in extra]).distinct()
    m = w.join(r, keys).where(F.col("from") != F.col("to"))
    weak = F.bool_or((F.col("rw_") == "SIMPLE") | (F.col("rr_") == "SIMPLE")) if rule else F.lit(False)
    return m.groupBy(*keys[:-1], "from", "to").agg(F.array_sort(F.collect_set(keys[-1])).alias("names"), F.when(weak, 0.7).otherwise(0.8).alias("confidence"))


def uses(accesses: DataFrame, keys: list[str], mode: str, evidence: str) -> DataFrame:
    """(keys, modes, evidence): all modes and evidence of one user and item, sorted."""
    return accesses.groupBy(*keys).agg(F.array_sort(F.collect_set(mode)).alias("modes"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def primary_access(accesses: DataFrame, keys: list[str], line: str, file: str, id_col: str) -> DataFrame:
    """One row per key with its first access by (line, file, id); a missing line comes first."""
    order = F.struct(F.coalesce(F.col(line), F.lit(-1)), F.coalesce(F.col(file), F.lit("")), F.col(id_col))
    return accesses.groupBy(*keys).agg(F.min_by(id_col, order).alias("primary"), F.count("*").alias("n"))


def single_outcome(df: DataFrame, keys: list[str], literal: str) -> DataFrame:
    """(keys, outcome): the literal if there is just one."""
    return df.groupBy(*keys).agg(F.when(F.count_distinct(literal) == 1, F.min(literal)).alias("outcome"))


def resolve_table(tokens: DataFrame, tables: DataFrame, token: str, scope: list[str]) -> DataFrame:
    """Table tokens to ids: qualified name, else unique last part, else an
    operational table of its own, with a warning where the last part is ambiguous."""
    r = resolve_names(tokens, tables, token, scope, "qualified", "terminal", "table_id")
    node = F.coalesce(F.col("target"), F.concat(F.lit("table::"), normal_name(F.col(token))))
    return r.select(*[r[c] for c in tokens.columns], node.alias("table_node"), F.col("target").isNull().alias("operational"), (F.col("resolution") == "AMBIGUOUS").alias("warning"))


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per id: labels of all, properties of the first by ``order``."""
    return nodes.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.min_by("properties", order).alias("properties"))


def edge_key(type_: str = "type", src: str = "src", dst: str = "dst", properties: str = "properties") -> Column:
    """SHA-256 over the edge's canonical JSON; property order does not matter."""
    props = F.map_from_entries(F.array_sort(F.map_entries(F.col(properties))))
    return F.sha2(F.to_json(F.struct(F.col(src).alias("from"), props.alias("properties"), F.col(dst).alias("to"), F.col(type_).alias("type")), {"ignoreNullFields": "false"}), 256)


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_key", edge_key()).dropDuplicates(["edge_key"])


def column_sets(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, only_left, only_right): columns that one side alone has."""
    a = left.groupBy(*keys).agg(F.collect_set(column).alias("a_"))
    b = right.groupBy(*keys).agg(F.collect_set(column).alias("b_"))
    empty = F.expr("cast(array() as array<string>)")
    x, y = F.coalesce("a_", empty), F.coalesce("b_", empty)
    return a.join(b, keys, "full_outer").select(*keys, F.array_sort(F.array_except(x, y)).alias("only_left"), F.array_sort(F.array_except(y, x)).alias("only_right"))


def reconcile(declared: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """(key, issue): UNKNOWN if declared but not registered, UNDOCUMENTED the other way."""
    a = declared.select(key).distinct().join(registered.select(key).distinct(), key, "left_anti").withColumn("issue", F.lit("UNKNOWN"))
    return a.unionByName(registered.select(key).distinct().join(declared.select(key).distinct(), key, "left_anti").withColumn("issue", F.lit("UNDOCUMENTED")))


def mapped_terms(items: DataFrame, glossary: DataFrame, tag: str, term: str) -> DataFrame:
    """``items`` with their tag's term and a warning where the glossary has none. A tag with two terms is an error."""
    one = glossary.groupBy(tag).agg(F.count_distinct(term).alias("n_"), F.min(term).alias("term"))
    one = one.select(tag, F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("several terms for tag "), F.col(tag)))).otherwise(F.col("term")).alias("term"))
    return items.join(one, tag, "left").withColumn("warning", F.col("term").isNull() & F.col(tag).isNotNull())


def numbered_decisions(statements: DataFrame, kinds: list[str]) -> DataFrame:
    """Decisions with their ordinal in the paragraph by execution order."""
    w = Window.partitionBy("program", "paragraph").orderBy("pos")
    return statements.where(F.col("kind").isin(kinds)).withColumn("ordinal", F.row_number().over(w))


def hierarchy(levels: list[tuple[str, DataFrame, str, str, str, str | None, str | None]]) -> DataFrame:
    """(id, label, name, parent) of all levels of a containment tree.

    Each level is (label, table, id prefix, key, name, parent's prefix, parent's key).
    """
    null = F.lit(None).cast("string")
    made = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    parts = [d.select(made(p, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), (made(up, above) if up else null).alias("parent")) for label, d, p, key, name, up, above in levels]
    return reduce(DataFrame.union, parts)


def variable_events(statements: DataFrame, items: DataFrame, scope: list[str], name: str, id_col: str, writes: str = "writes", reads: str = "reads") -> tuple[DataFrame, DataFrame]:
    """Names that statements write and read, as rows of items, with ``written``;
    and the names that no item or several have, with the reason."""
    both = F.concat(
        F.transform(F.coalesce(writes, F.array()), lambda x: F.struct(x.alias("token"), F.lit(True).alias("written"))),
        F.transform(F.coalesce(reads, F.array()), lambda x: F.struct(x.alias("token"), F.lit(False).alias("written"))),
    )
    tokens = statements.select(*[c for c in statements.columns if c not in (writes, reads)], F.inline(both))
    index = items.select(*scope, F.lit(None).cast("string").alias("q_"), F.col(name).alias("s_"), F.col(id_col).alias("i_"))
    r = resolve_names(tokens, index, "token", scope, "q_", "s_", "i_")
    found = F.col("target").isNotNull()
    return r.where(found).withColumnRenamed("target", id_col).drop("resolution"), r.where(~found).withColumnRenamed("resolution", "reason").drop("target")


def mapped_edges(facts: DataFrame, nodes: DataFrame, key: str, node: str) -> DataFrame:
    """``facts`` whose ``key`` is a node's; the job fails at a key that is no
    node, within the same join, so no other pass over the facts is needed."""
    ids = nodes.select(F.col(node).alias("n_")).distinct()
    j = facts.join(ids, F.col(key) == F.col("n_"), "left")
    checked = F.when(F.col("n_").isNotNull(), F.col("n_")).otherwise(F.raise_error(F.concat(F.lit(f"no node for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return j.select(*[checked.cast(facts.schema[c].dataType).alias(c) if c == key else F.col(c) for c in facts.columns])
