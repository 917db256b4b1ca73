"""Rule candidates: detection, merging, comparison, promotion and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.aggregates import ladder
from strandgraph.operators.joins import anchored


# --- detection --------------------------------------------------------------


def return_code_candidates(facts: DataFrame, tags: DataFrame, inside: DataFrame, tag: str = "return_code") -> DataFrame:
    """Facts (statement_id, target, literal, status) on items with the tag that
    lie in a decision (``inside``: statement_id, decision): DETERMINISTIC with
    confidence 1 for a literal, BLOCKED with 0 behind a barrier, else PARTIAL."""
    f = facts.join(tags.where(F.col("tag") == tag).select(F.col("item").alias("target")).distinct(), "target", "left_semi").join(inside, "statement_id")
    support = F.when(F.col("literal").isNotNull(), "DETERMINISTIC").when(F.col("status").isin("BARRIER", "INVALIDATED"), "BLOCKED").otherwise("PARTIAL")
    return f.withColumn("support", support).withColumn("confidence", F.when(F.col("support") == "DETERMINISTIC", 1.0).when(F.col("support") == "BLOCKED", 0.0).otherwise(0.5))


def condition_candidates(facts: DataFrame, conditions: DataFrame, tags: DataFrame, tag: str = "return_code") -> DataFrame:
    """Set-condition facts whose condition's parent item has the tag."""
    tagged = tags.where(F.col("tag") == tag).select(F.col("item").alias("parent")).distinct()
    c = conditions.join(tagged, "parent", "left_semi").select(F.col("condition").alias("source"), "parent")
    return facts.join(c, "source").withColumn("family", F.lit("LEVEL_88_RETURN_CODE"))


def state_candidates(facts: DataFrame, tags: DataFrame, inside: DataFrame, tag: str = "return_code") -> DataFrame:
    """Literal facts in a decision on items without the tag; partial by nature."""
    bare = facts.where(F.col("literal").isNotNull()).join(tags.where(F.col("tag") == tag).select(F.col("item").alias("target")), "target", "left_anti")
    return bare.join(inside, "statement_id").withColumn("support", F.lit("PARTIAL"))


def calculation_candidates(effects: DataFrame, inside: DataFrame) -> DataFrame:
    """Computing effects with their decision, if any."""
    return effects.where(F.col("kind") == "COMPUTE").join(inside, "statement_id", "left")


def transitions(entries: DataFrame, exits: DataFrame, keys: list[str], tags: DataFrame) -> DataFrame:
    """(keys, entry, exit) of state items whose literal changes on the way through."""
    state = tags.where(F.col("tag").isin("state", "status", "status_flag")).select(F.col("item").alias(keys[-1])).distinct()
    a = entries.select(*keys, F.col("literal").alias("entry"))
    b = exits.select(*keys, F.col("literal").alias("exit"))
    return a.join(b, keys).where(F.col("entry") != F.col("exit")).join(state, keys[-1], "left_semi")


# --- merging ----------------------------------------------------------------


def merge_evidence(df: DataFrame, id_col: str, arrays: list[str]) -> DataFrame:
    """One row per id with the sorted union of each evidence array."""
    return df.groupBy(id_col).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays])


def corroborate(df: DataFrame, keys: list[str], family: str, absorbing: str, absorbed: str, id_col: str) -> DataFrame:
    """``df`` less the rows that a partner absorbs: within the keys (evidence
    among them) the n-th row of one family absorbs the n-th of the other."""
    w = Window.partitionBy(*keys, family).orderBy(id_col)
    n = df.withColumn("n_", F.row_number().over(w))
    by = n.where(F.col(family) == absorbing).select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col("n_").alias("m_"))
    same = F.col("n_") == F.col("m_")
    for i, k in enumerate(keys):
        same = same & n[k].eqNullSafe(by[f"k{i}_"])
    return n.join(by, same & (n[family] == absorbed), "left_anti").drop("n_")


def upsert(new: DataFrame, baseline: DataFrame, key: str, id_col: str, evidence: str) -> DataFrame:
    """(key, id, evidence, origin): baseline rows keep their id and gain evidence; a new key takes its smallest id."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    a = new.groupBy(key).agg(F.min(id_col).alias("new_id"), union(evidence).alias("new_ev"))
    b = baseline.groupBy(key).agg(F.min(id_col).alias("old_id"), union(evidence).alias("old_ev"))
    none = F.expr("cast(array() as array<string>)")
    both = F.array_sort(F.array_union(F.coalesce("old_ev", none), F.coalesce("new_ev", none)))
    origin = F.when(F.col("old_id").isNull(), "NEW").when(F.col("new_id").isNull(), "BASELINE").otherwise("MERGED")
    return a.join(b, key, "full_outer").select(key, F.coalesce("old_id", "new_id").alias(id_col), both.alias(evidence), origin.alias("origin"))


def settled_keys(df: DataFrame, legacy: str, new: str, baseline: DataFrame) -> DataFrame:
    """``df`` with ``key``: the legacy key if none of its members' new keys is in
    the baseline and all members share one, else the new key."""
    known = baseline.select(F.col(new).alias("k_")).distinct().withColumn("in_", F.lit(True))
    m = df.join(known, F.col(new) == F.col("k_"), "left")
    per = m.groupBy(F.col(legacy).alias("l_")).agg((F.count_distinct(new) == 1).alias("one_"), F.coalesce(F.bool_or("in_"), F.lit(False)).alias("any_"))
    out = df.join(per, F.col(legacy) == F.col("l_"), "left")
    return out.select(*[df[c] for c in df.columns], F.when(F.col("one_") & ~F.col("any_"), F.col(legacy)).otherwise(F.col(new)).alias("key"))


def without_ghosts(df: DataFrame, keys: list[str], refined: Column, ghost: Column) -> DataFrame:
    """``df`` less ghost rows that share their keys with a refined row."""
    r = df.where(refined).select(*keys).distinct()
    return df.where(~F.coalesce(ghost, F.lit(False))).unionByName(df.where(ghost).join(r, keys, "left_anti"))


def unify(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All sources with the same columns and their name; a column a source lacks is null."""
    out = None
    for name, df in sources.items():
        part = df.select(*[c for c in columns if c in df.columns]).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- comparison -------------------------------------------------------------


def relations(refs: DataFrame, scope: str, id_col: str, target: str, literal: str, conflicts: DataFrame | Column) -> DataFrame:
    """(a, b, relation) of pairs that share a scope and a target.

    EXACT_MATCH with an equal literal, else RELATED; CONFLICT where the pair is
    in ``conflicts`` (a, b), or where that is a condition on a and b and holds.
    References of a scope that share nothing have no row: NO_RELATION is what
    is not listed.
    """
    # Few bytes in, many pairs out: the number of tasks is given, as Spark would take one for so little to read.
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = refs.select(scope, target, F.col(id_col).alias("a"), F.col(literal).alias("la")).repartition(n, scope, target)
    b = refs.select(scope, target, F.col(id_col).alias("b"), F.col(literal).alias("lb"))
    p = a.join(b.hint("shuffle_hash"), [scope, target]).where(F.col("a") < F.col("b"))
    if isinstance(conflicts, Column):
        p = p.withColumn("c_", conflicts)
    else:
        c = conflicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("c_", F.lit(True))
        p = p.join(c, ["a", "b"], "left")
    return p.select("a", "b", F.when(F.col("c_"), "CONFLICT").when(F.col("la").eqNullSafe(F.col("lb")), "EXACT_MATCH").otherwise("RELATED").alias("relation"))


def to_baseline(rows: DataFrame, baseline: DataFrame | None, exact: list[str], related: list[str], id_col: str, blocked: Column | None = None) -> DataFrame:
    """``rows`` with (status, match): MATCHED by the exact keys, else RELATED by
    the related ones, else NOT_FOUND; NOT_EVALUATED without a baseline.
    The smallest id matches. Blocked rows are left out."""
    r = rows.where(~F.coalesce(blocked, F.lit(False))) if blocked is not None else rows
    if baseline is None:
        return r.withColumn("status", F.lit("NOT_EVALUATED")).withColumn("match", F.lit(None).cast("string"))
    x = baseline.groupBy(*exact).agg(F.min(id_col).alias("x_"))
    y = baseline.groupBy(*related).agg(F.min(id_col).alias("y_"))
    out = r.join(x, exact, "left").join(y, related, "left")
    status = F.when(F.col("x_").isNotNull(), "MATCHED").when(F.col("y_").isNotNull(), "RELATED").otherwise("NOT_FOUND")
    return out.select(*[F.col(c) for c in rows.columns], status.alias("status"), F.coalesce("x_", "y_").alias("match"))


def differential(left: DataFrame, right: DataFrame, anchors: list[str], fallback: list[str], value: str, id_col: str = "id") -> DataFrame:
    """(left_id, right_id, outcome): EXACT, CONFLICTING or RELATED for anchored
    pairs by their values (RELATED if one is null), NOT_COMPARABLE for pairs of
    the fallback alone, LEFT_ONLY and ADDITIVE for the rest."""
    m = anchored(left, right, anchors, fallback, id_col)
    a = left.select(F.col(id_col).alias("left_id"), F.col(value).alias("va"))
    b = right.select(F.col(id_col).alias("right_id"), F.col(value).alias("vb"))
    out = m.join(a, "left_id", "left").join(b, "right_id", "left")
    outcome = (
        F.when(F.col("level") == "FALLBACK", "NOT_COMPARABLE").when(F.col("level") == "LEFT_ONLY", "LEFT_ONLY").when(F.col("level") == "RIGHT_ONLY", "ADDITIVE")
        .when(F.col("va").eqNullSafe(F.col("vb")), "EXACT").when(F.col("va").isNull() | F.col("vb").isNull(), "RELATED").otherwise("CONFLICTING")
    )
    return out.select("left_id", "right_id", outcome.alias("outcome"))


def complete_baseline(expected: DataFrame, found: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, defect): MISSING, EXTRA or ALTERED rows against the baseline."""
    pack = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    a = expected.select(key, pack.alias("a_"))
    b = found.select(key, pack.alias("b_"))
    out = a.join(b, key, "full_outer")
    return out.select(key, F.when(F.col("b_").isNull(), "MISSING").when(F.col("a_").isNull(), "EXTRA").when(F.col("a_") != F.col("b_"), "ALTERED").alias("defect")).where("defect is not null")


# --- promotion --------------------------------------------------------------


def assess(refs: DataFrame, criteria: dict[str, Column], order: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """``refs`` with a column per criterion (PASS, FAIL, or NOT_EVALUATED for
    null) and a disposition: the name beside the first criterion that fails."""
    out = refs
    for name, c in criteria.items():
        out = out.withColumn(name, F.when(c.isNull(), "NOT_EVALUATED").when(c, "PASS").otherwise("FAIL"))
    return out.withColumn("disposition", ladder(*[(F.col(n) == "FAIL", d) for n, d in order], otherwise=otherwise))


def active_decisions(decisions: DataFrame, item: str, id_col: str, supersedes: str) -> tuple[DataFrame, DataFrame]:
    """One decision per item and the rejected rest.

    A single decision stands; of two, the one that alone names the other
    stands; in any other case all of the item's decisions are rejected.
    """
    per = decisions.groupBy(item).agg(F.count("*").alias("n_"), F.collect_set(id_col).alias("ids_"))
    d = decisions.join(per.select(item, "n_", "ids_"), item)
    names_other = F.coalesce(F.array_contains("ids_", F.col(supersedes)) & (F.col(supersedes) != F.col(id_col)), F.lit(False))
    d = d.withColumn("names_", names_other)
    m = d.groupBy(item).agg(F.count_if("names_").alias("m_"))
    d = d.join(m, item)
    stands = (F.col("n_") == 1) | ((F.col("n_") == 2) & (F.col("m_") == 1) & F.col("names_"))
    keep = [F.col(c) for c in decisions.columns]
    return d.where(stands).select(*keep), d.where(~stands & ~((F.col("n_") == 2) & (F.col("m_") == 1))).select(*keep)


def group_disposition(groups: DataFrame, missing: Column, blocking: Column, gates_pass: Column, eligible: Column, warning: Column) -> DataFrame:
    """NOT_EVALUATED before BLOCKED before QUALIFIED (with warnings) before REVIEW_REQUIRED."""
    ok = gates_pass & eligible
    return groups.withColumn("disposition", ladder((missing, "NOT_EVALUATED"), (blocking, "BLOCKED"), (ok & warning, "QUALIFIED_WITH_WARNINGS"), (ok, "QUALIFIED"), otherwise="REVIEW_REQUIRED"))


# --- validation -------------------------------------------------------------


def match_expectations(expected: DataFrame, rows: DataFrame, scope: list[str], wildcards: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Expectations with (found, matched), and the in-scope rows that meet none.

    ``expected``: expectation_id, the scope, the wildcards (null meets all,
    text is compared trimmed) and min_count.
    """
    e = expected.select("expectation_id", "min_count", *[F.col(c).alias(f"e_{c}") for c in [*scope, *wildcards]])
    on = F.lit(True)
    for c in scope:
        on = on & (F.col(f"e_{c}") == rows[c])
    fits = on
    for c in wildcards:
        fits = fits & (F.col(f"e_{c}").isNull() | F.coalesce(F.trim(F.col(f"e_{c}")) == F.trim(rows[c]), F.lit(False)))
    hits = e.join(rows, fits).select("expectation_id", id_col)
    per = hits.groupBy("expectation_id").agg(F.count_distinct(id_col).alias("n_"))
    out = expected.join(per, "expectation_id", "left").withColumn("found", F.coalesce("n_", F.lit(0))).drop("n_").withColumn("matched", F.col("found") >= F.col("min_count"))
    in_scope = rows.join(e, on, "left_semi")
    return out, in_scope.join(hits.select(id_col).distinct(), id_col, "left_anti")


def threshold_gates(criteria: DataFrame, metrics: DataFrame, complete: Column | None = None) -> DataFrame:
    """(metric, value, threshold, outcome): a metric that is missing or null
    FAILED; NOT_EVALUATED where coverage is not complete."""
    out = criteria.join(metrics, "metric", "left")
    passed = F.when(F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)), "PASSED").otherwise("FAILED")
    if complete is not None:
        passed = F.when(~F.coalesce(complete, F.lit(False)), "NOT_EVALUATED").otherwise(passed)
    return out.select("metric", "value", "threshold", passed.alias("outcome"))


def unsupported_tokens(claims: DataFrame, evidence: DataFrame, key: str, claim_id: str, text: str, source: str) -> DataFrame:
    """(key, claim, token): numbers and ISO dates in a claim that its package's evidence does not hold."""
    from strandgraph.functions.scalar import iso_dates, numbers

    tokens = lambda c: F.array_distinct(F.concat(iso_dates(c), numbers(F.regexp_replace(c, r"\b\d{4}-\d{2}-\d{2}\b", " "))))
    held = evidence.select(key, F.explode(tokens(F.col(source))).alias("token")).distinct()
    return claims.select(key, claim_id, F.explode(tokens(F.col(text))).alias("token")).join(held, [key, "token"], "left_anti").select(key, claim_id, "token")


def suspicious(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Rows whose text holds one of the patterns, with the first that it holds."""
    hit = F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(p)) for p in patterns])
    return df.withColumn("pattern", hit).where("pattern is not null")


def resolve_aliases(claims: DataFrame, catalogue: DataFrame, alias_array: str, claim_id: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims' aliases as catalogue rows, and those that the catalogue lacks."""
    each = claims.select(*keys, claim_id, F.explode(alias_array).alias("alias"))
    return each.join(catalogue, [*keys, "alias"]), each.join(catalogue, [*keys, "alias"], "left_anti")


def anchored_claims(claims: DataFrame, approved: DataFrame, keys: list[str], alias_array: str) -> DataFrame:
    """Claims whose aliases lack an approved one gain all approved ones of their key."""
    ok = approved.groupBy(*keys).agg(F.array_sort(F.collect_set("alias")).alias("ok_"))
    out = claims.join(ok, keys, "left")
    lacks = ~F.coalesce(F.arrays_overlap(F.col(alias_array), F.col("ok_")), F.lit(False)) & F.col("ok_").isNotNull()
    return out.withColumn("repaired", lacks).withColumn(alias_array, F.when(lacks, F.array_union(alias_array, "ok_")).otherwise(F.col(alias_array))).drop("ok_")
