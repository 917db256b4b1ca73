"""Ordinals, islands, contiguity, priority picks, pages and hard caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, partition: list[str], order: list[str], name: str = "ordinal", start: int = 1) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) + (start - 1))


def primary(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def runs(df: DataFrame, partition: list[str], order: list[str], kind: str, breaks: Column | None = None, name: str = "run") -> DataFrame:
    """Number of the run a row is in; a run starts where the kind changes or ``breaks`` holds."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = ~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | (F.row_number().over(w) == 1)
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    return df.withColumn("new_", new.cast("int")).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def last_in_partition(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``df`` with is_last and the partition's n."""
    w = Window.partitionBy(*partition)
    return df.withColumn("n", F.count("*").over(w)).withColumn("is_last", F.row_number().over(w.orderBy(*order)) == F.col("n"))


def contiguity(df: DataFrame, partition: list[str], seq: str, first: int = 1) -> DataFrame:
    """(partition, n, contiguous): numbers go up by one from ``first``."""
    w = Window.partitionBy(*partition).orderBy(seq)
    ok = F.col(seq) == F.coalesce(F.lag(seq).over(w) + 1, F.lit(first))
    return df.withColumn("ok_", ok).groupBy(*partition).agg(F.count("*").alias("n"), F.bool_and("ok_").alias("contiguous"))


def collision_ordinal(df: DataFrame, digest: Column, order: list[str], name: str = "collision") -> DataFrame:
    """0, 1, 2... among rows of equal digest."""
    d = df.withColumn("digest", digest)
    return d.withColumn(name, F.row_number().over(Window.partitionBy("digest").orderBy(*order)) - 1)


def by_priority(df: DataFrame, keys: list[str], status: str, priority: list[str], id_col: str) -> DataFrame:
    """One row per key: the status that comes first in ``priority``, then the greatest id. Other statuses do not stand."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(status))
    return primary(df.where(F.col(status).isin(priority)), keys, [rank, F.col(id_col).desc()])


def aliases(pairs: DataFrame, group: list[str], columns: list[str], prefix: str = "E") -> DataFrame:
    """Distinct pairs per group, numbered E001, E002... in sorted order."""
    d = pairs.select(*group, *columns).distinct()
    w = Window.partitionBy(*group).orderBy(*columns)
    return d.withColumn("alias", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in ``order`` with the total before paging; top-k per task, never a full sort."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def at_most(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """``df`` itself; an error if it has more than ``n`` rows. Nothing is cut."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"more than {n} {what}")
    return df


def preview(df: DataFrame, keys: list[str], id_col: str, n: int = 5) -> DataFrame:
    """(keys, n, ids): the count and the ``n`` smallest ids."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    first = df.withColumn("r_", F.row_number().over(w)).withColumn("n_", F.count("*").over(Window.partitionBy(*keys))).where(F.col("r_") <= n)
    return first.groupBy(*keys).agg(F.max("n_").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))


def out_of_order(df: DataFrame, partition: list[str], order: list[str], value: str, id_col: str, was: str | None = None) -> DataFrame:
    """Rows whose value is below that of the row before, with that row's id as
    ``before``. With ``was``, the row before counts with that column instead."""
    w = Window.partitionBy(*partition).orderBy(*[F.asc_nulls_last(c) for c in order])
    out = df.withColumn("v_", F.lag(was or value).over(w)).withColumn("before", F.lag(id_col).over(w))
    return out.where(F.col(value) < F.col("v_")).drop("v_")
