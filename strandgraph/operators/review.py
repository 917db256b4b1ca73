"""Review, grouping and activation of candidates from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.joins import anchored


def run_detectors(detectors: dict[str, DataFrame], columns: list[str], baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(detector, columns, in_baseline) of all registered detectors' rows."""
    parts = [d.select(F.lit(name).alias("detector"), *columns) for name, d in sorted(detectors.items())]
    known = baseline.select(*keys).distinct().withColumn("in_baseline", F.lit(True))
    return reduce(DataFrame.union, parts).join(known, keys, "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))


def productised(rows: DataFrame, tag: str, allowed: list[str], support: str) -> DataFrame:
    """Rows with an allowed tag and support that is not blocked, with the product's confidence."""
    return rows.where(F.col(tag).isin(allowed) & (F.col(support) != "BLOCKED")).withColumn("confidence", F.when(F.col(support) == "DETERMINISTIC", 1.0).otherwise(0.5))


def review_items(assessments: DataFrame, eligibility: str, actions: dict[str, str], otherwise: str = "MANUAL_REVIEW") -> DataFrame:
    """``assessments`` with the review's action, by their eligibility."""
    ladder = [F.when(F.col(eligibility) == k, v) for k, v in actions.items()]
    return assessments.withColumn("action", F.coalesce(*ladder, F.lit(otherwise)))


def resolve_references(refs: DataFrame, sources: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """``refs`` with ``resolution``: RESOLVED if the source has the keys with
    equal identity fields (nulls equal), IDENTITY_MISMATCH if it has the keys,
    else NOT_FOUND; AMBIGUOUS if the source repeats the keys."""
    s = sources.groupBy(*keys).agg(F.count("*").alias("n_"), *[F.first(c).alias(f"s_{c}") for c in identity])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in identity])
    status = F.when(F.col("n_").isNull(), "NOT_FOUND").when(F.col("n_") > 1, "AMBIGUOUS").when(same, "RESOLVED").otherwise("IDENTITY_MISMATCH")
    return refs.join(s, keys, "left").select(*[refs[c] if c not in keys else F.col(c) for c in refs.columns], status.alias("resolution"))


def group_to_baseline(members: DataFrame, group: str, conflicts: Column, exact: Column, related: Column) -> DataFrame:
    """(group, comparison): CONFLICTS before EXACT before RELATED before NOT_IN_BASELINE, by any member."""
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return members.groupBy(group).agg(F.when(some(conflicts), "CONFLICTS").when(some(exact), "EXACT").when(some(related), "RELATED").otherwise("NOT_IN_BASELINE").alias("comparison"))


def gate_status(findings: dict[str, DataFrame], key: str, blocking: list[str]) -> DataFrame:
    """(gate, status, findings) of every gate: its distinct findings decide.

    FAILED with a finding of a blocking gate, WARNING with another's, PASSED
    with none. ``findings`` are (key) rows per gate.
    """
    spark = next(iter(findings.values())).sparkSession
    gates = spark.createDataFrame([(g, g in blocking) for g in findings], "gate string, blocks boolean")
    counted = reduce(DataFrame.union, [d.select(F.lit(g).alias("gate"), F.col(key).cast("string").alias("k_")) for g, d in findings.items()]).groupBy("gate").agg(F.count_distinct("k_").alias("findings"))
    out = gates.join(counted, "gate", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return out.select("gate", F.when(F.col("findings") == 0, "PASSED").when(F.col("blocks"), "FAILED").otherwise("WARNING").alias("status"), "findings")


def binding_defects(sources: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, defect): expected sources that are MISSING, and fields (hash, version, run) that differ."""
    e = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields])
    j = e.join(sources.select(key, *fields, F.lit(True).alias("here_")), key, "left")
    wrong = [F.when(F.col("here_") & ~F.col(f).eqNullSafe(F.col(f"e_{f}")), F.lit(f"{f.upper()}_MISMATCH")) for f in fields]
    return j.select(key, F.explode(F.array_compact(F.array(F.when(F.col("here_").isNull(), "MISSING"), *wrong))).alias("defect"))


def recomputed_groups(groups: DataFrame, members: DataFrame, group: str, count: str, digest: str, id_col: str) -> DataFrame:
    """(group, defect): groups whose stored size or member digest is not what their members give."""
    ids = F.array_join(F.array_sort(F.collect_set(F.col(id_col).cast("string"))), ",")
    now = members.groupBy(group).agg(F.count_distinct(id_col).alias("n_"), F.sha2(ids, 256).alias("d_"))
    j = groups.join(now, group, "full")
    defects = F.array_compact(F.array(
        F.when(F.col(count).isNull(), "UNKNOWN_GROUP"), F.when(F.col("n_").isNull(), "EMPTY_GROUP"),
        F.when(F.col(count) != F.col("n_"), "SIZE"), F.when((F.col(count) == F.col("n_")) & (F.col(digest) != F.col("d_")), "MEMBERS"),
    ))
    return j.select(group, F.explode(defects).alias("defect"))


def traceability(members: DataFrame, group: str, evidence: Column, provenance: Column, decision: Column) -> DataFrame:
    """(group, evidence, provenance, decision): whether all members have each; a group has one member at least."""
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return members.groupBy(group).agg(every(evidence).alias("evidence"), every(provenance).alias("provenance"), every(decision).alias("decision"))


def activation_outcome(left: DataFrame, right: DataFrame, anchors: list[str], fallback: list[str], value: str, evaluated: Column, id_col: str = "id") -> DataFrame:
    """(left_id, right_id, outcome) of two lanes.

    Anchored pairs are EXACT with equal values, NOT_COMPARABLE where a value
    is null, else CONFLICTING; fallback pairs are RELATED; rows of one side
    alone are LEFT_ONLY or ADDITIVE. ``evaluated`` (over value of the right
    side as ``rv``) turns pairs that were not into NOT_EVALUATED.
    """
    l, r = (d.select(F.col(id_col).alias(f"{s}_id"), F.col(value).alias(f"{s[0]}v")) for d, s in ((left, "left"), (right, "right")))
    j = anchored(left, right, anchors, fallback, id_col).join(l, "left_id", "left").join(r, "right_id", "left")
    pair = F.when(~evaluated, "NOT_EVALUATED").when(F.col("level") == "FALLBACK", "RELATED").when(F.col("lv").isNull() | F.col("rv").isNull(), "NOT_COMPARABLE").when(F.col("lv") == F.col("rv"), "EXACT").otherwise("CONFLICTING")
    return j.select("left_id", "right_id", F.when(F.col("level") == "LEFT_ONLY", "LEFT_ONLY").when(F.col("level") == "RIGHT_ONLY", "ADDITIVE").otherwise(pair).alias("outcome"))


def best_surface(items: DataFrame, surfaces: list[tuple[str, DataFrame]], key: str, text: str) -> DataFrame:
    """(key, text, surface) of every item: the first of the surfaces, in order, that has a text."""
    tagged = [d.select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("s"), F.col(text).alias("t")).alias("x_")).where(F.col("x_.t").isNotNull()) for i, (name, d) in enumerate(surfaces)]
    best = reduce(DataFrame.union, tagged).groupBy(key).agg(F.min("x_").alias("x_"))
    return items.select(key).join(best, key, "left").select(key, F.col("x_.t").alias(text), F.coalesce("x_.s", F.lit("NONE")).alias("surface"))


def lane(mode: Column, picked: Column, baseline: Column, candidate: Column, valid: Column) -> Column:
    """The lane that answers: the old one unless the mode, the pick and the checks all speak for the new one.

    OFF and SHADOW answer from the old lane; CANARY from the new one for what
    is picked, ON for all, each only where the new lane is there and valid.
    """
    new = candidate & valid & ((mode == "ON") | ((mode == "CANARY") & picked))
    return F.when(F.coalesce(new, F.lit(False)), "UNIFIED").when(baseline, "V1").otherwise("NONE")
