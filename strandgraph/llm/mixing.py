"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import fresh, numbered, unique_ids
from strandgraph.store import stash


#: Buckets whose counts are summed in one window.
SHELF = 64

#: Rows of one id, source and size that one row stands for, at most, when they are written out.
BLOCK = 4096


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but 0x20 and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``limit`` times its source's
    size and the excess is shared again by weight until none is above. That is
    one water level: sources are capped in order of size over weight, and the
    level is what is left after them over the weight that is left. The table
    holds a row per source, so its windows see sources, not documents.
    """
    ring = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(ring, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    w = w.withColumn("level", (F.lit(share) * F.col("total") - F.lit(limit) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    w = w.withColumn("capped", F.lit(limit) * F.col("source_size") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.lit(limit) * F.col("source_size")).otherwise(level * F.col("weight"))
    return w.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: list[int] | None = None, share: float = 1.5, limit: float = 2.0, seed: int = 7, spread: int = 4096,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row.

    Every document of a source expects target / source_size copies. Documents
    stand in order of (size, md5 of id, id); the prefix sum of expectations
    plus one offset per source, drawn from a digest of seed and source, emits
    a copy at each integer it crosses. So a document gets the expectation
    rounded down or up, never over ``limit`` copies, and neighbours in size
    stand in for each other: words taken stay within about one longest
    document of the target. Reruns agree.

    Prefix sums never gather a source: counts per (source, size, digest
    bucket) combine before their shuffle, bucket offsets add up within a shelf
    of SHELF buckets, shelf offsets within a size and size offsets within a
    source, and only the ids of one bucket are ranked together (``spread``
    buckets a size). Rows that share id, source and size stand next to each
    other and are counted before they are shuffled: one null or common id in
    a third of all rows is one row of its bucket, and is written out again in
    blocks of BLOCK rows that are dealt over the tasks.

    Null text counts as size 0; a source of size 0 has target 0 and takes
    nothing; null is a source of its own. Rows of one id, source and size are
    told apart by rank alone, so their multiset of results is still fixed.
    """
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights or [5, 2, 1], share, limit)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    targets = stash(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", unit), "targets")
    rows = rows.groupBy("source", "size", "doc_id").agg(F.count("*").alias("repeats"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("bucket", (F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * F.lit(spread) / F.lit(1 << 16)).cast("int"))
    counts = rows.groupBy("source", "size", "bucket").agg(F.sum("repeats").alias("n"))
    before = lambda n, by, *order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stash(counts.withColumn("shelf", F.floor(F.col("bucket") / SHELF)), "buckets")
    shelves = counts.groupBy("source", "size", "shelf").agg(F.sum("n").alias("m"))
    shelves = shelves.select(F.col("source").alias("s_"), F.col("size").alias("z_"), F.col("shelf").alias("f_"), before("m", ["source", "size"], "shelf").alias("shelf_before"))
    counts = counts.withColumn("inner_before", before("n", ["source", "size", "shelf"], "bucket"))
    counts = counts.join(shelves, F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("z_")) & (F.col("shelf") == F.col("f_")))
    counts = stash(counts.select("source", "size", "bucket", "n", (F.col("shelf_before") + F.col("inner_before")).alias("bucket_before")), "buckets")
    per_size = counts.groupBy("source", "size").agg(F.sum("n").alias("m"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("size_before", F.coalesce(F.sum("m").over(in_source), F.lit(0)))
    ranked = rows.withColumn("ahead", before("repeats", ["source", "size", "bucket"], "h", "doc_id"))
    starts = counts.alias("c").join(per_size.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
    starts = starts.select(F.col("c.source").alias("s_"), F.col("c.size").alias("z_"), F.col("c.bucket").alias("b_"), (F.col("bucket_before") + F.col("size_before")).alias("before"))
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("z_")) & (F.col("bucket") == F.col("b_")))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("repeats") - 1) / BLOCK))
    ranked = ranked.select("doc_id", "source", "size", "repeats", (F.col("before") + F.col("ahead")).alias("ahead"), F.explode(blocks).alias("block")).repartition("doc_id", "size", "block")
    within = F.sequence(F.col("block") * BLOCK + 1, F.least("repeats", (F.col("block") + 1) * BLOCK))
    ranked = ranked.select("doc_id", "source", "size", "ahead", F.explode(within).alias("number")).select("doc_id", "source", "size", (F.col("ahead") + F.col("number")).alias("rank"))
    named = targets.select(F.col("source").alias("s_"), "source_size", "target", "rate", "offset")
    out = ranked.join(named, F.col("source").eqNullSafe(F.col("s_")))
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, and copy_no (from 1).

    Rows that share id and text are one document here: their copies add up and
    one of the rows stands for all.
    """
    number, copy = fresh(docs, "ord"), fresh(docs, "copy_no")
    rows = numbered(docs, id_col, text_col, number)
    mixed = mix_sources(rows, number, text_col, source_col, **how).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("copies"))
    mixed = stash(mixed.select(F.col("doc_id").alias("m_ord"), "copies"), "copies")
    one = rows if unique_ids(docs, id_col) else rows.dropDuplicates([number])
    joined = one.join(mixed, one[number] == mixed["m_ord"])
    return joined.select(*[one[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), mixed["copies"].cast("int"))).alias(copy))
