"""SimHash fingerprints and near-duplicate components by covering LSH.

Masks come from a Hadamard code: bit i gets a nonzero label m(i) of r+1 bits,
and table v keeps the bits with an odd number of ones in m(i) & v. Any r
differing bits have labels that some nonzero v misses all together, so every
pair within radius r agrees under that mask: 2^(r+1)-1 tables, no pair lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.rows import fresh, numbered, unique_ids
from strandgraph.llm.words import chunks, space_words
from strandgraph.operators.components import connected_components
from strandgraph.store import stash

BITS = 64
SEED = 42


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits, as a signed long; 0 without words."""
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - shingle] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) per row. Null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fps = [fingerprint(space_words(t, lower=True), shingle) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps, pa.int64())], ["doc_id", "fp"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks of 64 bits, as signed longs."""
    labels = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(BITS)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def covering_links(fps: DataFrame, radius: int = 2, crowd: int = 64) -> DataFrame:
    """(a, b) links that join exactly the fingerprints within ``radius`` bits.

    ``fps``: distinct fingerprints (fp long). Buckets of at most ``crowd`` are
    compared pair by pair. A crowded bucket is linked without pairs where the
    radius is 2: two fingerprints are within 2 bits just when a common point
    is within 1 bit of both, so each member names itself and its neighbours at
    one bit outside the mask, and whoever names the same point is linked to
    the smallest; at most 65 fingerprints can name a point. For other radii
    crowded buckets are compared in pairs too.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks(radius))])
    keys = fps.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), F.col("x.m").alias("m"), "fp")
    sizes = keys.groupBy("t", "key").count().where("count > 1")
    held = stash(keys.join(sizes, ["t", "key"]), "buckets")
    few = held if radius != 2 else held.where(F.col("count") <= crowd)
    pairs = (
        few.select("t", "key", F.col("fp").alias("a"))
        .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
    )
    if radius != 2:
        return pairs.distinct()
    flips = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(BITS)])
    near = held.where(F.col("count") > crowd).select(
        "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.filter(flips, lambda f: f.bitwiseAND(F.col("m")) == 0))).alias("f")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("point")).distinct()
    stars = near.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def components(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``rows`` (doc_id, fp)."""
    firsts = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    links = covering_links(firsts.select("fp"), radius)
    groups = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "component")
    member = stash(firsts.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c")), "members")
    least = member.groupBy("c").agg(F.min("first").alias("component_id"))
    return member.join(least, "c").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row.

    component_id is the smallest doc_id that links of ``radius`` bits or fewer
    reach, the row's own included. Wordless texts share fingerprint zero. A
    null id takes part and yields to any other; a component of null ids alone
    has a null component_id. Repeated rows repeat in the result. An empty
    table gives no rows; other columns are not read.
    """
    rows = stash(simhash(docs, id_col, text_col, shingle), "fingerprints")
    return rows.join(components(rows, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that come first in their near-duplicate group.

    Order and identity of rows are those of ``rows.numbered``: of rows with an
    equal id and equal text one stays too. All columns pass through. Those
    that go are looked up, not those that stay: they are fewer, so texts are
    often not shuffled.
    """
    name = fresh(docs, "ord")
    numbers = numbered(docs, id_col, text_col, name)
    rows = stash(simhash(numbers, name, text_col, shingle), "fingerprints")
    group = components(rows, radius)
    gone = rows.join(group, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias("ord")).distinct()
    gone = stash(gone, "near-copies")
    kept = numbers.join(gone, numbers[name] == gone["ord"], "left_anti")
    return (kept if unique_ids(docs, id_col) else kept.dropDuplicates([name])).select(*docs.columns)
