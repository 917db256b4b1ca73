"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.store import drop_stash, stash


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u")
    return (
        moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest
    node that can be reached.

    Alternating large-star and small-star rounds. A round moves each edge at
    most once per operation, so work stays linear in the edges; minima combine
    before the shuffle and the joins back are ones that AQE can split, so a hub
    costs no single task its whole neighbourhood. Edges with a null end are
    dropped; a self-loop yields the node alone. Rounds end when the edge set
    no longer changes, with every node linked to its component's minimum.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    now = stash(e.where("u <> v").distinct(), "edges")
    loops = stash(loops, "loops")
    mark, first = None, True
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        then = stash(_small_star(_large_star(now)), "edges")
        if not first:
            drop_stash(now)
        now, first = then, False
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return nodes.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
