"""Integrity checks. Each gives the rows that violate it; none is the good case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ["code", "severity", "entity", "detail"]
SEVERITIES = ["WARNING", "ERROR"]


def issue(rows: DataFrame, code: str, entity: Column, detail: Column | None = None, severity: str = "ERROR") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.trim(column) == ""))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; a null key is an orphan too."""
    p = parents.select(F.col(parent_key).alias("p_")).distinct()
    return children.join(p, F.col(child_key) == F.col("p_"), "left_anti")


def outside_catalogue(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values that are not allowed; null is no value and not reported."""
    return df.where(~F.col(column).isin(allowed))


def lacks_label(nodes: DataFrame, label: str, needs: str, labels: str = "labels") -> DataFrame:
    return nodes.where(F.array_contains(labels, label) & ~F.array_contains(labels, needs))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differing(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, versions): one key with several contents, nulls compared as values."""
    packed = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(F.count_distinct(packed).alias("versions")).where("versions > 1")


def dangling(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges of which an end is no node, with the side."""
    a = orphans(edges, nodes, src, node).withColumn("side", F.lit("src"))
    return a.unionByName(orphans(edges, nodes, dst, node).withColumn("side", F.lit("dst")))


def all_issues(*issues: DataFrame) -> DataFrame:
    """The distinct issues of all checks, ordered; an unknown severity is an error."""
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    known = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce("severity", F.lit("null")))))
    return out.withColumn("severity", known).dropDuplicates(ISSUE).orderBy(*ISSUE)


def enforce(violations: DataFrame, what: str) -> None:
    """An error that names a few of the violations, if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))
