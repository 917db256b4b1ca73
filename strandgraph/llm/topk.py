"""Exact top-k inner products by a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.store import stash

#: The most pivots: what a task holds of them is bounded by it.
PIVOTS = 2048
#: Vectors that are compared with all pivots, or queries with a block, at once.
STEP = 256


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component, as whole numbers.

    Vectors that are null, empty, or hold null or non-finite components are
    left out. ``row`` numbers rows in order of vec_id, null last; it is fixed
    once the table is written.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where("size(x) > 0")
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~odd).select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return v.orderBy(F.col("vec_id").asc_nulls_last(), "v").withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v")


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: through floats where these are exact, else as integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


@dataclass
class Pivots:
    """Pivots of each vector length, numbered through: (number of the first, rows)."""

    of: dict[int, tuple[int, np.ndarray]]

    def __len__(self) -> int:
        return sum(len(p) for _, p in self.of.values())

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        """Rows of one length, STEP at most, with the pivots of that length."""
        lengths = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            some = batch if (lengths == n).all() else batch.take(pa.array(np.flatnonzero(lengths == n)))
            for at in range(0, len(some), STEP):
                yield some.slice(at, STEP), *self.of[int(n)]


def _assign(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, first, p in pivots.blocks(batch):
                x = _matrix(b["v"])
                d2 = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T
                g = d2.argmin(axis=1)
                far = np.sqrt(np.maximum(d2[np.arange(len(x)), g], 0)) + 1e-3
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row", "vec_id", "v")), pa.array((g + first).astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(axis=1)) + 1e-3)], ["row", "vec_id", "v", "g", "far", "norm"])

    return run


def _solve(k: int):
    """Best k of a block of a group's vectors for each of a part of its queries; rows stand in order of vec_id."""

    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if data.empty or queries.empty:
            return pd.DataFrame({"query": [], "row": [], "score": []}).astype("int64")
        data = data.sort_values("row", kind="stable")
        ids, x = data["row"].to_numpy(), _matrix(data["v"])
        out = []
        for at in range(0, len(queries), STEP):
            part = queries.iloc[at : at + STEP]
            asked = part["row"].to_numpy()
            s = _scores(_matrix(part["v"]), x)
            own = asked[:, None] == ids
            s[own] = np.iinfo(np.int64).min
            n = min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            row, col = np.nonzero((s >= np.maximum(edge, part["least"].to_numpy())[:, None]) & ~own)
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[rank < k], col[rank < k]
            out.append(pd.DataFrame({"query": asked[row], "row": ids[col], "score": s[row, col]}))
        return pd.concat(out)

    return run


def _reach(pivots: Pivots, counts: np.ndarray, radius: np.ndarray, norm: np.ndarray):
    """(query row, g): the groups that may hold one of a query's best, but for its own.

    A group's vectors lie within ``radius`` of its pivot and have at most
    length ``norm``. With c the pivot, q.x is at most q.c + |q| radius, and at
    most (|q|^2 + norm^2 - d^2) / 2 where d bounds |q - x| from below by the
    distance to the pivot less the radius and by the distance to the plane
    between the query's pivot and the group's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, first, p in pivots.blocks(batch):
                mine = slice(first, first + len(p))
                norms, far, most = (p**2).sum(axis=1), radius[mine], norm[mine]
                q, home, least = _matrix(b["v"]), b["g"].to_numpy() - first, b["least"].to_numpy()
                length2, each = (q**2).sum(axis=1)[:, None], np.arange(len(q))
                dots = q @ p.T
                d2 = np.maximum(length2 + norms - 2 * dots, 0)
                apart = np.sqrt(np.maximum(norms[home][:, None] + norms - 2 * p[home] @ p.T, 1e-12))
                plane = (d2 - d2[each, home][:, None]) / (2 * apart)
                lower = np.maximum(np.maximum(np.sqrt(d2) - far, plane) - 1e-3, 0)
                bound = np.minimum(dots + np.sqrt(length2) * far, (length2 + most**2 - lower**2) / 2)
                take = (counts[mine] > 0) & (bound + 1 >= least[:, None])
                take[each, home] = False
                row, g = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b["row"].take(pa.array(row)), pa.array((g + first).astype(np.int32))], ["row", "g"])

    return run


def deal(data: DataFrame, sent: DataFrame, counts: np.ndarray, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Data and queries of each group, dealt into a grid of blocks and parts.

    A group of n vectors that is asked by q queries is ceil(n / block_rows)
    blocks by ceil(q / query_rows) parts, so no task holds more than about one
    block and one part. Queries go to the blocks of the groups that they reach
    alone, and vectors to the parts of their group alone; groups that nobody
    asks stay behind.
    """
    asked = np.zeros(len(counts), np.int64)
    for r in sent.groupBy("g").count().collect():  # a row per pivot at most
        asked[r.g] = r["count"]
    blocks, parts = np.maximum(1, -(-counts // block_rows)), -(-asked // query_rows)
    per = lambda n: F.get(F.array(*[F.lit(int(x)) for x in n]), F.col("g"))
    cells = lambda n: F.explode(F.sequence(F.lit(0), per(n) - 1))
    some = F.col("g").isin([int(g) for g in np.flatnonzero(asked)])
    data = data.where(some).select("g", F.pmod(F.xxhash64("row"), per(blocks)).cast("int").alias("block"), cells(parts).alias("part"), "row", "v")
    sent = sent.select("g", cells(blocks).alias("block"), F.pmod(F.xxhash64(F.lit(1), "row"), per(parts)).cast("int").alias("part"), "row", "v", "least")
    return data, sent


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, pivots: int | None = None, block_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each
    asked-for vector with all others, ties to the smaller id.

    ``asked`` is a condition on vec_id. Vectors and queries are grouped by the
    nearest of ``pivots`` vectors (those of least id hash: a bounded sample
    that only shapes the groups; by default as many as the root of the number
    of vectors of the same length, 16 to PIVOTS). A first join, inside the query's own group,
    gives a score that its k-th best must reach. Group summaries (count,
    radius, greatest length: a row per pivot) then bound what any vector of a
    group can score, and a query is sent only to groups that may reach it; see
    ``deal``. A hot pivot is many tasks.

    Left out are vectors that are null, empty, or hold null or non-finite
    components. Vectors of one length are scored among themselves: each length
    has pivots of its own, and one search does all. Rows are told apart even where ids
    repeat: each is a candidate for all others, and a query of its own with
    ranks of its own. A null id is a candidate, after all others in ties, and
    asks where ``asked`` says so. Fewer than k others give all. Other columns
    are not read.
    """
    v = stash(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    many = {r.n: r["count"] for r in v.groupBy(F.size("v").alias("n")).count().collect()}  # a row a length
    by_hash = Window.partitionBy("n").orderBy(F.xxhash64("vec_id", "row"), "row")
    seeds = v.select("v", "vec_id", "row", F.size("v").alias("n")).withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= (pivots or PIVOTS))
    held: dict[int, list] = {}
    for r in seeds.select("n", "rank", "v").collect():  # PIVOTS a length at most
        if r.rank <= (pivots or max(16, isqrt(many[r.n]))):
            held.setdefault(r.n, []).append(r.v)
    of, first = {}, 0
    for n, rows in sorted(held.items()):
        of[n] = (first, np.unique(np.array(rows, np.float64), axis=0))
        first += len(of[n][1])
    p = Pivots(of)
    v = stash(v.mapInArrow(_assign(p), "row long, vec_id long, v array<long>, g int, far double, norm double"), "groups")
    counts, radius, norm = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p))
    for r in v.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect():
        counts[r.g], radius[r.g], norm[r.g] = r.n, r.far, r.norm
    questions = v.where(asked).select("row", "vec_id", "v", "g")

    def search(sent: DataFrame) -> DataFrame:
        data, queries = deal(v, sent, counts, block_rows, query_rows)
        keys = ["g", "block", "part"]
        return data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_solve(k), "query long, row long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    lowest = F.lit(-(1 << 62)).cast("long")
    near = stash(ranked(search(questions.select("row", "v", "g", lowest.alias("least")))), "near")
    least = near.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("least"))
    rest = stash(questions.join(least, "row", "left").select("row", "v", "g", F.coalesce("least", lowest).alias("least")), "questions")
    reached = rest.mapInArrow(_reach(p, counts, radius, norm), "row long, g int")
    reached = stash(reached.join(rest.drop("g"), "row"), "reached")
    found = ranked(search(reached).unionByName(near.select("query", "row", "score")))
    ids = v.select("row", "vec_id")
    found = found.join(ids, "row").join(questions.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return found.select("query_id", "rank", "vec_id", "score")
