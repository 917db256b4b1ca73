"""Repeated word spans by compaction of the de Bruijn graph of word windows.

Every window of ``k`` words is an edge. Windows whose least ``m``-word hash is
the same are neighbours on one path, so a document is cut into runs of
consecutive windows with one such hash (its anchor). Equal windows have equal
anchors. A run that occurs whole more than once compacts to a single path: its
first occurrence stays and the others go, without looking at its windows. Only
anchors with several different runs branch, and only the first occurrences of
those runs are opened into windows. So is a run that holds the same window twice.

Every later run or window carries the coordinates of an earlier one. Where the
next one continues at the next coordinates of the same source, both are one
path; paths compact to their full length. A path goes only where the words at
its place and at its source's place have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import ordered, salted_join
from strandgraph.llm.words import STEP, chunks, mix, space_words, window_hashes, word_hashes
from strandgraph.store import stash

#: What a run's row says: to be compared, surely a later copy, surely to be
#: opened, or only a sign that its anchor branches.
RUN, COPY, OPEN, SIGN = 0, 1, 2, 3
#: Added for a run that holds a window twice.
LOOP = 4

_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width, out = 1, x
    while 2 * width <= size:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """Least m-word hash in each window of k words."""
    return _sliding_min(mix(window_hashes(h, m)), k - m + 1)


def _runs(h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window, number of windows, and whether it
    holds a window that its text has twice, of each run."""
    a = _anchors(h, k, m)
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    counts = np.diff(np.append(starts, len(a)))
    w = mix(window_hashes(h, k, _OTHER))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(counts.max()), STEP, np.uint64))
        inner = np.arange(len(a)) - np.repeat(starts, counts)
        content = np.add.reduceat(w * powers[inner], starts)
    loops = np.zeros(len(starts), bool)
    values, at, often = np.unique(w, return_inverse=True, return_counts=True)
    if len(values) < len(w):
        loops = np.logical_or.reduceat(often[at] > 1, starts)
    return a[starts], mix(content ^ counts.astype(np.uint64)), starts, counts, loops


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut(k: int, m: int, wide: int):
    """Documents to rows of runs. Within a chunk of texts, repeats of a run are
    already told to be copies, and an anchor with over ``wide`` different runs
    is told to branch, so a frequent passage brings few rows to one group. A
    copy has its source's document and start in ``key`` and ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            parts = []
            for ord_, text in zip(b["ord"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = space_words(text)
                if len(words) >= k:
                    a, s, start, n, loops = _runs(word_hashes(words), k, m)
                    parts.append((a, s, np.full(len(a), ord_, np.int64), start, n * 8 + loops * LOOP))
            if not parts:
                continue
            a, s, o, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, o, s, a))
            a, s, o, start, n = (x[order] for x in (a, s, o, start, n))
            once = np.concatenate(([True], (o[1:] != o[:-1]) | (start[1:] != start[:-1]) | (a[1:] != a[:-1])))
            a, s, o, start, n = (x[once] for x in (a, s, o, start, n))  # a repeated row is the same document
            new_a = np.concatenate(([True], a[1:] != a[:-1]))
            first = new_a | np.concatenate(([True], s[1:] != s[:-1]))
            kind = np.where(first, RUN, COPY)
            of = np.cumsum(new_a) - 1
            broad = np.bincount(of[first], minlength=of[-1] + 1) > wide
            kind[first & broad[of]] = OPEN
            alone = mix(o.view(np.uint64) * STEP ^ start.astype(np.uint64))
            source = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))  # a copy says where its chunk's first stands
            key = np.where(kind == RUN, a, np.where(kind == COPY, o[source].view(np.uint64), alone))
            s = np.where(kind == COPY, start[source].astype(np.uint64), s)
            signs = np.flatnonzero(new_a & broad[of])
            pick = np.concatenate((np.arange(len(a)), signs))
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate((key, a[signs]))), _signed(s[pick]), pa.array(o[pick]), pa.array(start[pick].astype(np.int64)),
                    pa.array((n[pick] + np.concatenate((kind, np.full(len(signs), SIGN)))).astype(np.int64)),
                ],
                ["key", "s", "ord", "start", "nk"],
            )

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, z): texts compressed before they are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches, "text"):
            z = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["ord"], b["doc_id"], pa.array(z, pa.binary())], ["ord", "doc_id", "z"])

    return docs.mapInArrow(run, f"ord long, doc_id {kind}, z binary")


def _unpack(z: bytes | None) -> list[bytes]:
    return [] if z is None else zstandard.ZstdDecompressor().decompress(z).split()


#: Windows that are told apart at once, but for a single text that has more.
OPEN_WINDOWS = 1 << 20


def _by_windows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` cut where its runs hold about OPEN_WINDOWS windows."""
    ends = np.cumsum([int(r.values.field("n").to_numpy().sum()) for r in b["runs"]])
    begin = 0
    while begin < len(b):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + OPEN_WINDOWS, "right")))
        yield b.slice(begin, end - begin)
        begin = end


def _open(k: int, m: int):
    """Runs to be opened, to rows of (anchor, window hash, ord, start); of equal
    windows in a batch only the first is kept open, others are copies, with
    their source's document and start in ``key`` and ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _by_windows(b):
                rows = []
                for ord_, z, runs in zip(part["ord"].to_pylist(), part["z"].to_pylist(), part["runs"], strict=True):
                    h = word_hashes(_unpack(z))
                    a, w = _anchors(h, k, m), mix(window_hashes(h, k, _OTHER))
                    start = runs.values.field("start").to_numpy()
                    n = runs.values.field("n").to_numpy()
                    where = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    rows.append((a[where], w[where], np.full(len(where), ord_, np.int64), where))
                a, w, o, where = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.lexsort((where, o, w, a))
                a, w, o, where = (x[order] for x in (a, w, o, where))
                once = np.concatenate(([True], (o[1:] != o[:-1]) | (where[1:] != where[:-1])))
                a, w, o, where = (x[once] for x in (a, w, o, where))
                first = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])))
                source = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                key = np.where(first, a, o[source].view(np.uint64))
                w = np.where(first, w, where[source].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(w), pa.array(o), pa.array(where.astype(np.int64)), pa.array(first)], ["key", "w", "ord", "start", "first"])

    return run


def _digest(words: list[bytes], start: int, n: int, k: int) -> bytes:
    """Of the words that ``n`` windows from ``start`` cover."""
    return hashlib.blake2b(b" ".join(words[start : start + n + k - 1]), digest_size=16).digest()


def _digests(k: int):
    """Digests of the words of each source path of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ord_, z, paths in zip(b["ord"].to_pylist(), b["z"].to_pylist(), b["paths"], strict=True):
                words = _unpack(z)
                start, n = (paths.values.field(c) for c in ("source_start", "length"))
                found = [_digest(words, i, j, k) for i, j in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ord_] * len(n), pa.int64()), start, n, pa.array(found, pa.binary()), paths.values.field("n")],
                    ["source_ord", "source_start", "length", "digest", "n"],
                )

    return run


def _compacted(spans: DataFrame) -> DataFrame:
    """(ord, start, length, source_ord, source_start): spans that go on at the same
    distance from the same source document, as one path each; lengths in windows."""
    shift, end = F.col("source_start") - F.col("start"), F.col("start") + F.col("n")
    path = ["ord", "source_ord", "shift"]
    by_start = Window.partitionBy(*path).orderBy("start", "n")
    spans = spans.withColumn("shift", shift).withColumn("end", end)
    begins = F.col("start") > F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = spans.withColumn("begins", begins.cast("int")).withColumn("path", F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    paths = spans.groupBy(*path, "path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return paths.select("ord", "start", (F.col("end") - F.col("start")).alias("length"), "source_ord", (F.col("start") + F.col("shift")).alias("source_start"))


def _with_digests(paths: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``paths`` (written) with the digest of the words at their source's place.

    Paths of one source are counted before they are shuffled, and each source
    is digested once; sources with many copies are dealt over salts.
    """
    keys = ["source_ord", "source_start", "length"]
    per_source = paths.groupBy(*keys).agg(F.count("*").alias("n"))
    per_text = per_source.groupBy("source_ord").agg(F.collect_list(F.struct("source_start", "length", "n")).alias("paths"))
    asked = texts.join(per_text, F.col("ord") == F.col("source_ord")).select("ord", "z", "paths")
    known = asked.mapInArrow(_digests(k), "source_ord long, source_start long, length long, digest binary, n long")
    known = stash(known.dropDuplicates(keys), "digests")  # rows that repeat wholly are one source
    return salted_join(paths, known, keys, ["ord", "start"], known.agg(F.sum("n")).first()[0] or 0)


def _finish(k: int, texts: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, z, runs in zip(b["doc_id"].to_pylist(), b["z"].to_pylist(), b["runs"], strict=True):
                words, gone = _unpack(z), 0
                n_words = len(words)
                if runs.is_valid:
                    edges = np.zeros(n_words + 1, np.int64)
                    for start, n, digest in zip(*(runs.values.field(c).to_pylist() for c in ("start", "length", "digest")), strict=True):
                        if _digest(words, start, n, k) == digest:
                            edges[start] += 1
                            edges[start + n + k - 1] -= 1
                    out_of = np.cumsum(edges[:-1]) > 0
                    gone = int(out_of.sum())
                    words = [words[i] for i in np.flatnonzero(~out_of).tolist()]
                kept = b" ".join(words)
                out.append((doc_id, n_words, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if texts else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), *([pa.array(cols[4], pa.string())] if texts else [])],
                ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 8, wide: int = 32, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row.

    A word goes if it lies in a window of ``k`` words whose sequence also
    starts earlier: in a smaller doc_id, or before it in the same document.
    Windows are judged on the input. Anchors have ``m`` <= ``k`` words.

    Runs and windows are taken for equal where their anchor and content hashes,
    64 bits each over different polynomials, are both equal; coordinates
    (document, start) then decide which came first. Later ones compact to paths
    along their source, and a path's words go only if a 128-bit BLAKE2 digest of
    them is that of the words at the source's coordinates.

    Null text has no words; fewer than ``k`` words are never removed. Null ids
    come last. Rows with equal id and text are one document and get equal
    results; rows with equal id and other text are documents in the order of
    their text hash. Other columns are not read. An empty table gives no rows.
    """
    d = ordered(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.select("ord", "text").mapInArrow(_cut(k, m, wide), "key long, s long, ord long, start long, nk long")
    rows = rows.withColumn("kind", F.col("nk").bitwiseAND(3)).withColumn("alone", F.col("kind").isin(COPY, OPEN))
    group = Window.partitionBy("key", "alone")
    earliest = group.partitionBy("key", "alone", "s").orderBy("ord", "start")
    copied = F.col("kind") == COPY
    branches = (F.min("s").over(group) != F.max("s").over(group)) | (F.max("kind").over(group) == SIGN)
    later = (F.col("ord") != F.col("o1")) | (F.col("start") != F.col("s1"))
    rows = rows.withColumn("branches", branches).withColumn("o1", F.first("ord").over(earliest)).withColumn("s1", F.first("start").over(earliest)).withColumn("later", later)
    gone = copied | ((F.col("kind") == RUN) & F.col("later"))
    opened = (F.col("kind") == OPEN) | ((F.col("kind") == RUN) & ~F.col("later") & (F.col("branches") | (F.col("nk").bitwiseAND(LOOP) > 0)))
    found = rows.where(F.col("kind") != SIGN).where(gone | opened)
    source = [F.when(copied, F.col(c)).otherwise(F.col(first)).alias(name) for c, first, name in (("key", "o1", "source_ord"), ("s", "s1", "source_start"))]
    found = stash(found.select("ord", "start", F.shiftright("nk", 3).alias("n"), *source, gone.alias("gone")), "runs")

    texts_by_ord = _packed(d)
    to_open = found.where("not gone").select("ord", "start", "n").distinct().groupBy("ord").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    opened_docs = texts_by_ord.select(F.col("ord").alias("o_"), "z").join(to_open, F.col("o_") == F.col("ord")).select("ord", "z", "runs")
    windows = opened_docs.mapInArrow(_open(k, m), "key long, w long, ord long, start long, first boolean")
    by_window = Window.partitionBy("key", "w", "first").orderBy("ord", "start")
    windows = windows.withColumn("o1", F.first("ord").over(by_window)).withColumn("s1", F.first("start").over(by_window))
    copies = windows.where("not first or o1 <> ord or s1 <> start").select(
        "ord", "start", F.lit(1).cast("long").alias("n"),
        F.when(F.col("first"), F.col("o1")).otherwise(F.col("key")).alias("source_ord"), F.when(F.col("first"), F.col("s1")).otherwise(F.col("w")).alias("source_start"),
    )
    spans = found.where("gone").drop("gone").union(copies)
    paths = stash(_compacted(spans), "paths")
    spans = _with_digests(paths, texts_by_ord, k).groupBy("ord").agg(F.collect_list(F.struct("start", "length", "digest")).alias("runs"))
    all_docs = texts_by_ord.select(F.col("ord").alias("o_"), "doc_id", "z").join(spans, F.col("o_") == F.col("ord"), "left").select("doc_id", "z", "runs")
    return all_docs.mapInArrow(_finish(k, texts, kind), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
