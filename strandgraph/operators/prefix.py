"""Prefix sums over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.store import stash


def running(df: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """``df``, written, with ``before``: the sum of column ``n`` over the rows with smaller ``keys``.

    Rows are sorted in ranges; sums within a range and one total a range (as
    many as there are partitions) give the prefix sums, so no task sees all
    rows. Rows with equal keys have one range, and their sum of smaller keys.
    """
    held = stash(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    totals = held.groupBy("part").agg(F.sum(n).alias("all"))
    ahead = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))
    upto = Window.partitionBy("part").orderBy(*keys)
    equal = Window.partitionBy("part", *keys)
    before = F.col("ahead") + F.sum(n).over(upto) - F.sum(n).over(equal)
    return held.join(F.broadcast(ahead), "part").withColumn("before", before).drop("part", "ahead")
