"""Product codes of vectors by Lloyd rounds, nearest entries found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import salted_join
from strandgraph.store import stash

#: Whole components are held within this bound, so that squared distances fit 64 bits.
BOUND = 1 << 27
#: Part vectors whose annuli are evaluated together.
TILE = 128
#: Entries on each side of a vector's norm that give the first distance.
NEAR = 4


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, x, label) of rows whose vector is not null and holds finite numbers only."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("x").isNotNull() & ~odd)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x * float(scale)), -BOUND, BOUND).astype(np.int64)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part: equal parts, or leading ones longer by one component."""
    ends = np.cumsum([length // parts + (i < length % parts) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _squares(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole rows: through floats where these are exact, else as integers."""
    most = max(np.abs(p).max(initial=0), np.abs(c).max(initial=0), 1)
    dots = (p.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if float(most) ** 2 * p.shape[1] < 2.0**52 else p @ c.T
    return (p**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * dots


def nearest_entries(p: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row (ties to the lower), its squared
    distance, and how many distances were evaluated for annuli.

    Entries are sorted by norm. Those next to a row's own norm give a first
    distance d; an entry within d lies in the annulus of norms from |p| - d to
    |p| + d, which is found by binary search and evaluated exactly, its ends
    included. Rows are taken in order of norm, so the annuli of a tile are one
    stretch of the sorted entries.
    """
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    length = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(length, kind="stable")
    c, length = entries[order], length[order]
    own = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    rows = np.argsort(own, kind="stable")
    code, error, evaluated = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), 0
    for at in range(0, len(rows), TILE):
        r = rows[at : at + TILE]
        x, norm = p[r], own[r]
        low = max(0, int(np.searchsorted(length, norm[0])) - NEAR)
        high = min(len(c), max(int(np.searchsorted(length, norm[-1])) + NEAR, low + 1))
        reach = np.sqrt(_squares(x, c[low:high]).min(axis=1).astype(np.float64))
        slack = 1e-9 * (norm + reach + 1) + 1e-6  # of the float norms
        first = np.searchsorted(length, norm - reach - slack, "left")
        last = np.searchsorted(length, norm + reach + slack, "right")
        low, high = int(first.min()), int(last.max())
        d2 = _squares(x, c[low:high])
        places = np.arange(low, high)
        d2[(places < first[:, None]) | (places >= last[:, None])] = np.iinfo(np.int64).max
        evaluated += int((last - first).sum())
        best = d2.min(axis=1)
        code[r] = np.where(d2 == best[:, None], order[low:high], len(c)).min(axis=1)
        error[r] = best
    return code, error, evaluated


@dataclass
class Codebooks:
    """The entries of vectors of each length, as rows of whole numbers: part by part side by side."""

    parts: int
    scale: int
    entries: dict[int, np.ndarray]

    def blocks(self, column: pa.Array, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the column, whole components) of the vectors of one length, at most ``step`` at once."""
        lengths = np.diff(column.offsets.to_numpy())
        flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
        for n in np.unique(lengths):
            some = np.flatnonzero(lengths == n)
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                yield rows, whole(flat[starts[rows][:, None] + np.arange(n)], self.scale)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a row per vector, a column per part) and squared distances summed over parts."""
        entries, codes, error = self.entries[x.shape[1]], [], np.zeros(len(x), np.int64)
        for begin, end in cuts(x.shape[1], self.parts):
            code, e, _ = nearest_entries(x[:, begin:end], entries[:, begin:end])
            codes.append(code)
            error += e
        return np.stack(codes, axis=1), error

    def digest(self, length: int) -> str:
        entries = self.entries[length]
        numbers = [str(v) for begin, end in cuts(length, self.parts) for v in entries[:, begin:end].ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def first_codebooks(v: DataFrame, parts: int, size: int, scale: int) -> Codebooks:
    """The ``size`` vectors of smallest id of each length (equal ids by components, null ids last)."""
    first = Window.partitionBy("n").orderBy(F.col("vec_id").asc_nulls_last(), "x")
    rows = v.select("vec_id", "x", F.size("x").alias("n")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    found: dict[int, list] = {}
    for r in rows.orderBy("n", "rank").select("n", "x").collect():  # at most ``size`` rows a length
        found.setdefault(r.n, []).append(r.x)
    return Codebooks(parts, scale, {n: whole(np.array(x, np.float64).reshape(len(x), n), scale) for n, x in found.items()})


def improved(v: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, then each entry to the floored mean of its parts.

    A task sums its vectors by length, entry and component before anything is
    shuffled; unused entries stay.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros_like(e) for n, e in books.entries.items()}
        counts = {n: np.zeros((len(e), books.parts), np.int64) for n, e in books.entries.items()}
        for batch in batches:
            for _, x in books.blocks(batch["x"]):
                n = x.shape[1]
                codes, _ = books.assign(x)
                for part, (begin, end) in enumerate(cuts(n, books.parts)):
                    order = np.argsort(codes[:, part], kind="stable")
                    used, at, many = np.unique(codes[order, part], return_index=True, return_counts=True)
                    sums[n][used, begin:end] += np.add.reduceat(x[order, begin:end], at, axis=0)
                    counts[n][used, part] += many
        for n in books.entries:
            cells = np.concatenate([sums[n], counts[n]], axis=1)
            at = np.flatnonzero(cells.ravel() != 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(cells.ravel()[at])], ["n", "cell", "s"])

    new = {n: e.copy() for n, e in books.entries.items()}
    totals = {n: np.zeros((len(e), n + books.parts), np.int64) for n, e in new.items()}
    summed = v.select("x").mapInArrow(partial, "n long, cell long, s long").groupBy("n", "cell").agg(F.sum("s").alias("s"))
    for r in summed.collect():  # as many rows as the codebooks have components and parts
        totals[r.n].ravel()[r.cell] = r.s
    for n, t in totals.items():
        for part, (begin, end) in enumerate(cuts(n, books.parts)):
            used = t[:, n + part] > 0
            new[n][used, begin:end] = t[used, begin:end] // t[used, n + part][:, None]
    return Codebooks(books.parts, books.scale, new)


def train_codebooks(v: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of (vec_id, x) after ``rounds`` rounds over all rows."""
    books = first_codebooks(v, parts, size, scale)
    for _ in range(rounds if books.entries else 0):
        books = improved(v, books)
    return books


def encoded(v: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, length, code, error) of each row of (vec_id, x, label)."""
    kind = v.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in books.blocks(batch["x"]):
                codes, error = books.assign(x)
                take = pa.array(rows)
                hexes = [bytes(c).hex() for c in codes.astype(np.uint8)]
                columns = [batch["vec_id"].take(take), batch["label"].take(take), pa.array(np.full(len(rows), x.shape[1])), pa.array(hexes, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "length", "code", "error"])

    return v.mapInArrow(run, f"vec_id long, label {kind.simpleString()}, length long, code string, error long")


def _digests(books: Codebooks) -> Column:
    out = F.lit(None).cast("string")
    for n in books.entries:
        out = F.when(F.col("length") == n, F.lit(books.digest(n))).otherwise(out)
    return out


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per kept row.

    Components become floor(scale * x). A vector is cut into ``parts`` parts;
    each part has a codebook of ``size`` entries (256 at most, two hex digits
    each) that starts as that part of the vectors of least id and is moved
    ``rounds`` times to the floored means of the parts that are nearest to it.
    Every round reads all vectors; tasks hold the codebooks and a block of
    vectors, and what they send is a sum per component of the codebooks.
    label_error sums the errors of a label: partial sums first, and rows of a
    common label are dealt over many tasks to get it back.

    Left out are rows whose vector is null or holds null or non-finite
    components. Vectors of another length have codebooks of their own (one
    pass for all lengths); where the length is no multiple of ``parts``, the
    leading parts are one component longer. An empty vector has code 0 in
    every part and error 0. Components beyond BOUND (2^27) count as BOUND.
    Null ids are kept and come last; rows that repeat an id are rows of their
    own. Null labels share one sum. Other columns are not read.
    """
    if not 1 <= size <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    v = kept_vectors(vectors, id_col, vector_col, label_col)
    books = train_codebooks(v, parts, size, rounds, scale)
    out = stash(encoded(v, books), "codes")
    named = [F.col("label").isNull().alias("l_null"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l_name")]
    sums = stash(out.groupBy(*named).agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(2**63 - 1)).cast("long").alias("label_error")), "labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    joined = salted_join(out.withColumns({"l_null": named[0], "l_name": named[1]}), sums, ["l_null", "l_name"], ["vec_id", "code"], total)
    return joined.select("vec_id", "label", "code", "error", "label_error", _digests(books).alias("codebooks_sha256"))
