"""Joins with an outcome per row: three-way, ordinal, as-of, anchored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def three_way(left: DataFrame, right: DataFrame, keys: list[str], value: str, names: tuple[str, str] = ("LEFT_ONLY", "RIGHT_ONLY")) -> DataFrame:
    """(keys, left_value, right_value, status): SAME, DIFFERENT, or on one side alone."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(1).alias("l_"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(1).alias("r_"))
    status = F.when(F.col("r_").isNull(), names[0]).when(F.col("l_").isNull(), names[1]).when(F.col("left_value").eqNullSafe(F.col("right_value")), "SAME").otherwise("DIFFERENT")
    return a.join(b, keys, "full_outer").select(*keys, "left_value", "right_value", status.alias("status"))


def ordinal_zip(actuals: DataFrame, formals: DataFrame, keys: list[str], ordinal: str, resolved: DataFrame | None = None) -> DataFrame:
    """(keys, ordinal, binding): actuals and formals by position.

    BOUND on both sides, EXTRA_ACTUAL or MISSING_ACTUAL on one. Keys outside
    ``resolved`` have no formals to compare with: FORMAL_UNRESOLVED.
    """
    a, f = actuals.select(*keys, ordinal, F.lit(1).alias("a_")), formals.select(*keys, ordinal, F.lit(1).alias("f_"))
    if resolved is not None:
        known = resolved.select(*keys).distinct().withColumn("k_", F.lit(1))
        f = f.join(known.drop("k_"), keys, "left_semi")
    else:
        known = None
    out = a.join(f, [*keys, ordinal], "full_outer")
    binding = F.when(F.col("a_").isNull(), "MISSING_ACTUAL").when(F.col("f_").isNull(), "EXTRA_ACTUAL").otherwise("BOUND")
    if known is not None:
        out = out.join(known, keys, "left")
        binding = F.when(F.col("k_").isNull(), "FORMAL_UNRESOLVED").otherwise(binding)
    return out.select(*keys, ordinal, binding.alias("binding"))


def latest_before(rows: DataFrame, is_fact: Column, value: Column, partition: list[str], order: list[str], name: str = "latest") -> DataFrame:
    """``rows`` with the value of the nearest earlier row that is a fact. The
    nearest fact wins even if its value is null."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_fact, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


def latest_unless_barred(rows: DataFrame, is_fact: Column, is_barrier: Column, value: Column, partition: list[str], order: list[str]) -> DataFrame:
    """``rows`` with (nearest, proof): the value of the nearest earlier fact.

    PROVEN if that fact is nearer than any barrier, AMBIGUOUS if a barrier is
    nearer (a row that is both counts as a barrier), NOT_AVAILABLE if there is
    neither; nearest is null unless proven.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(is_fact | is_barrier, F.struct(is_barrier.alias("b"), value.alias("v")))
    out = rows.withColumn("seen_", F.last(seen, ignorenulls=True).over(w))
    proof = F.when(F.col("seen_").isNull(), "NOT_AVAILABLE").when(F.col("seen_.b"), "AMBIGUOUS").otherwise("PROVEN")
    return out.withColumn("proof", proof).withColumn("nearest", F.when(F.col("proof") == "PROVEN", F.col("seen_.v"))).drop("seen_")


def contained(required: Column, available: Column) -> Column:
    """Whether a set of requirements is not empty and all are available."""
    return (F.size(required) > 0) & (F.size(F.array_except(required, available)) == 0)


def anchored(left: DataFrame, right: DataFrame, anchors: list[str], fallback: list[str], id_col: str = "id") -> DataFrame:
    """(left_id, right_id, level): matched by all ``anchors``; what neither side
    matched that way by ``fallback``; the rest alone. Of several partners the
    smallest ids meet."""

    def meet(a: DataFrame, b: DataFrame, keys: list[str], level: str) -> DataFrame:
        x = a.groupBy(*keys).agg(F.min(id_col).alias("left_id"))
        y = b.groupBy(*keys).agg(F.min(id_col).alias("right_id"))
        return x.join(y, keys).select("left_id", "right_id", F.lit(level).alias("level"))

    full = meet(left, right, anchors, "ANCHOR")
    both = left.select(*anchors).distinct().join(right.select(*anchors).distinct(), anchors, "left_semi")
    a, b = left.join(both, anchors, "left_anti"), right.join(both, anchors, "left_anti")
    loose = meet(a, b, fallback, "FALLBACK")
    shared = a.select(*fallback).distinct().join(b.select(*fallback).distinct(), fallback, "left_semi")
    none = F.lit(None)
    only_a = a.join(shared, fallback, "left_anti").select(F.col(id_col).alias("left_id"), none.cast(right.schema[id_col].dataType).alias("right_id"), F.lit("LEFT_ONLY").alias("level"))
    only_b = b.join(shared, fallback, "left_anti").select(none.cast(left.schema[id_col].dataType).alias("left_id"), F.col(id_col).alias("right_id"), F.lit("RIGHT_ONLY").alias("level"))
    return full.unionByName(loose).unionByName(only_a).unionByName(only_b)


def allowed_endpoints(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """Edges (type, src_labels, dst_labels) that no signature (type, src_label, dst_label) allows."""
    s = signatures.select(F.col("type").alias("t_"), "src_label", "dst_label")
    fits = (F.col("type") == F.col("t_")) & F.array_contains("src_labels", F.col("src_label")) & F.array_contains("dst_labels", F.col("dst_label"))
    return edges.join(s, fits, "left_anti")
