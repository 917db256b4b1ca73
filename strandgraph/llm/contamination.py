"""Benchmark passages in training texts by a positional inverted index.

The index is a table of postings (term, document, position). Of each test
window the rarest terms, by their count over all training texts, are looked
up; their posting lists are shifted by the terms' places in the window and
intersected. Where all lists meet, the words that stand there are compared
with the window's: equal ones are an exact phrase, others stand at the right
distances only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import ordered, salted_join
from strandgraph.llm.words import chunks, plain_words, word_hashes
from strandgraph.store import stash

#: Rows of a table that is sent to all tasks, at most.
HELD = 1 << 20


def test_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, phrase, terms) per window: its words joined by blanks, and their hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 200_000):
            out = []
            for item, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = plain_words(text)
                n, h = min(size, len(words)), word_hashes(words).view(np.int64).tolist()
                out += [(item, b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass"), h[i : i + n]) for i in range(len(words) - n + 1)] if n else []
            for at in range(0, len(out), 4096):
                cols = list(zip(*out[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64()))], ["item_id", "phrase", "terms"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "item_id string, phrase string, terms array<long>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk's texts in a row, and the number of words of each."""
    words, counts = [], []
    for t in b["text"].to_pylist():
        w = plain_words(t)
        words += w
        counts.append(len(w))
    return word_hashes(words).view(np.int64), np.array(counts, np.int64)


class Wanted:
    """A filter of at most HELD entries that lets all wanted terms pass.

    Of more terms it holds leading bits, as many as HELD entries tell apart:
    some other terms pass too, and the join that follows drops them.
    """

    def __init__(self, terms: DataFrame) -> None:
        """``terms``: distinct (term long)."""
        bits = 64 if terms.limit(HELD + 1).count() <= HELD else HELD.bit_length() - 1
        self.shift = 64 - bits
        found = terms.select(F.shiftright("term", self.shift).alias("x")).distinct().collect()
        self.some = np.sort(np.array([r.x for r in found], np.int64))

    def where(self, h: np.ndarray) -> np.ndarray:
        x = h >> np.int64(self.shift) if self.shift else h
        if not len(self.some):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.some, x), len(self.some) - 1)
        return np.flatnonzero(self.some[at] == x)


def term_counts(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """(term, n): how often terms that pass the filter occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4_000_000):
            h = _flat(b)[0]
            term, n = np.unique(h[wanted.where(h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """(ord, term, pos, n_words) of each place of a term that passes the filter,
    and a row without a term per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            h, n = _flat(b)
            begins = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(n)), n)
            at = wanted.where(h)
            who, ord_ = owner[at], b["ord"].to_numpy()
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ord_), nothing, nothing, pa.array(n)], ["ord", "term", "pos", "n_words"])
            yield pa.RecordBatch.from_arrays([pa.array(ord_[who]), pa.array(h[at]), pa.array(at - begins[who]), pa.array(n[who])], ["ord", "term", "pos", "n_words"])

    return docs.select("ord", "text").mapInArrow(run, "ord long, term long, pos long, n_words long")


def _compared(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (ord, phrase, start, length) with ``exact``: whether the phrase's very words stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            for i, text in enumerate(b["text"].to_pylist()):
                words, spots = plain_words(text), b["places"][i].values
                start, length, phrase = (spots.field(c) for c in ("start", "length", "phrase"))
                exact = [b" ".join(words[a : a + n]) == p.encode("utf-8", "surrogatepass") for a, n, p in zip(start.to_pylist(), length.to_pylist(), phrase.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([b["ord"][i].as_py()] * len(exact), pa.int64()), phrase, start, length, pa.array(exact)], ["ord", "phrase", "start", "length", "exact"])

    lists = places.groupBy("ord").agg(F.collect_list(F.struct("start", "length", "phrase")).alias("places"))
    some = docs.select(F.col("ord").alias("o_"), "text").join(lists, F.col("o_") == F.col("ord")).dropDuplicates(["ord"]).select("ord", "text", "places")
    return some.mapInArrow(run, "ord long, phrase string, start long, length long, exact boolean")


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    size: int = 13, rarest: int = 3, share: int = 20,
) -> DataFrame:
    """(doc_id, ord, n_words, n_hit, n_items, items_sha256, contaminated, n_near, passages) per row.

    A test window is ``size`` consecutive words of an item, or all words of a
    shorter one. n_hit counts the words inside any exact occurrence of a
    window; n_items the items whose windows occur; passages lists the merged
    word spans [start, end). n_near counts places where the ``rarest`` terms
    of a window stand as in the window while other words differ (proximity
    matches); they do not count as hits. contaminated: n_hit > 0 and ``share``
    * n_hit >= n_words.

    Texts are read twice for the index, once to count terms and once to make
    the postings of the windows' rarest terms, however large the benchmark is;
    texts in which such lists meet are read again to compare the words. Terms
    are filtered by a table of HELD entries at most (see ``Wanted``). Postings
    meet the windows in a join by term whose common terms are dealt over salts.

    Null text has no words. Items with a null id count as one item, which
    items_sha256 does not name. Equal windows of many items count for each.
    Null ids and rows with one id are kept apart as ``rows.numbered`` tells;
    rows that repeat wholly repeat in the result. An empty benchmark hits
    nothing. Other columns are not read.
    """
    d = ordered(docs, id_col, text_col)
    windows = stash(test_windows(benchmark, item_id_col, item_text_col, size), "test-windows")
    distinct = windows.groupBy("phrase").agg(F.first("terms").alias("terms"))
    distinct = stash(distinct.withColumn("window", F.monotonically_increasing_id()), "distinct-windows")
    terms = stash(windows.select(F.explode("terms").alias("term")).groupBy("term").count().select("term", F.col("count").alias("uses")), "terms")
    counts = stash(terms.join(term_counts(d, Wanted(terms.select("term"))), "term"), "term-counts")
    plan = stash(_plan(distinct.drop("phrase"), counts, rarest), "plan")
    leads = plan.select("term").distinct()
    rows = stash(postings(d, Wanted(leads)), "postings")
    words_of = rows.where("term is null").select("ord", "n_words").distinct()

    met = _meet(rows.where("term is not null"), plan, counts)
    start = F.col("pos") - F.col("place")
    met = met.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    met = met.groupBy("ord", "window", "start", "lists").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("bits")).where(F.bit_count("bits") == F.col("lists"))
    met = met.select("ord", "window", "start").join(distinct.select("window", "phrase", F.size("terms").cast("long").alias("length")), "window")
    found = stash(_compared(d, met.select("ord", "phrase", "start", "length")), "places")

    exact = found.where("exact")
    items = exact.select("ord", "phrase").distinct().join(windows.select("item_id", "phrase").distinct(), "phrase").select("ord", "item_id").distinct()
    items = items.groupBy("ord").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    spans = exact.select("ord", "start", (F.col("start") + F.col("length")).alias("end")).groupBy("ord", "start").agg(F.max("end").alias("end"))
    by_start = Window.partitionBy("ord").orderBy("start")
    opens = F.col("start") > F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = spans.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(by_start))
    spans = spans.groupBy("ord", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    near = found.where("not exact").groupBy("ord").agg(F.count("*").alias("n_near"))
    ids = d.select(F.col("ord").alias("o_"), "doc_id")
    out = ids.join(words_of, F.col("o_") == F.col("ord")).drop("ord").withColumnRenamed("o_", "ord")
    for part in (items, spans, near):
        out = out.join(part, "ord", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "passages", "ord",
    )


def _plan(distinct: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """(term, window, place, length, rank, lists) of the rarest terms of each
    window. Windows with a word that no text has occur nowhere and go.

    The counts of the benchmark's own terms are sent to all tasks where they
    are HELD at most; else they meet the windows in a salted join, as nearly
    every window has the commonest words.
    """
    places = distinct.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    if counts.count() <= HELD:
        known = places.join(F.broadcast(counts.select("term", "n")), "term")
    else:
        uses = counts.agg(F.sum("uses")).first()[0]
        known = salted_join(places, counts.select("term", F.col("n").alias("often"), F.col("uses").alias("n")), ["term"], ["window", "place"], uses).withColumnRenamed("often", "n")
    by_window = known.groupBy("window", "length").agg(F.sort_array(F.collect_list(F.struct("n", "term", "place"))).alias("all")).where("size(all) = length")
    ranked = by_window.select("window", "length", F.posexplode(F.slice("all", 1, rarest)).alias("rank", "x"))
    return ranked.select(F.col("x.term").alias("term"), "window", F.col("x.place").alias("place"), F.col("length").cast("long"), "rank", F.least("length", F.lit(rarest)).alias("lists"))


def _meet(rows: DataFrame, plan: DataFrame, counts: DataFrame) -> DataFrame:
    """Postings with the windows that ask for their term.

    A plan of HELD rows or fewer is sent to all tasks. A larger one is joined
    by term: windows of a term come as one list, and postings of common terms
    are dealt over salts.
    """
    if plan.count() <= HELD:
        return rows.join(F.broadcast(plan), "term")
    asked = plan.groupBy("term").agg(F.collect_list(F.struct("window", "place", "length", "rank", "lists")).alias("all"))
    asked = stash(asked.join(counts.select("term", "n"), "term"), "asked")
    total = asked.agg(F.sum("n")).first()[0]
    return salted_join(rows, asked, ["term"], ["ord", "pos"], total).select("ord", "pos", "n_words", F.inline("all"))
