"""Repeated line runs by a distributed suffix array, in DataFrame functions alone.

Lines become ids; prefix doubling ranks suffixes of the line-id sequences;
neighbours in the sorted order give longest common prefixes, and stretches of
the order whose common prefix is long enough are the repeated runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.rows import fresh, numbered, running, salted_join, text_hashes
from strandgraph.store import stash

#: Blanks at a line's ends do not count in comparing.
BLANKS = " \t\r\f\x0b"
#: A round makes the ranked prefix so many times as long: two doublings.
RADIX = 4


def line_sequences(docs: DataFrame, words: bool = False) -> DataFrame:
    """(ord, pos, line, chars, id1, id2) of every line that is not blank; with ``words`` also the line's number of words.

    ``line`` is the line's index in its text, ``pos`` its index among lines
    that are not blank; ids hash the line without blanks at its ends.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    kept = F.filter(lines, lambda x: x["t"] != "")
    d = docs.select("ord", F.posexplode(kept).alias("pos", "x"))
    more = [F.size(F.split("x.t", "[ \t\r\f\x0b]+")).alias("words")] if words else []
    id1, id2 = text_hashes(F.col("x.t"))
    return d.select("ord", "pos", F.col("x.line").alias("line"), F.length("x.t").alias("chars"), *more, id1.alias("id1"), id2.alias("id2"))


def suffix_array(lines: DataFrame) -> DataFrame:
    """(ord, pos, line, chars, left, ranks) of the suffixes that begin with a
    line which is elsewhere too; ``lines`` as ``line_sequences`` gives them.

    A line that stands once in the corpus, and the end of a text, part the
    sequences: no repeated run goes across. ``left`` is the number of lines up
    to there. ``ranks`` holds the suffix's rank by its first 1, 4, 16, ... lines:
    the number of suffixes before it in the order, plus 1. A round doubles the
    ranked prefix twice: it ranks a suffix by its own rank and those of the
    suffixes one, two and three prefixes further on (0 where the sequence has
    ended, so shorter ones come first). A suffix leaves when it is alone in its
    rank or ranked by all its lines, and its last rank is its place in the
    suffix array (suffixes that are equal to their ends share it). Rounds go
    on until none is left, so two for each factor of 16 in the longest run.
    """
    ids = lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).where("n > 1")
    ids = stash(running(ids, ["id1", "id2"], "n", "line-ids").withColumn("rank", F.col("before") + 1).drop("before"), "line-ranks")
    total = ids.agg(F.sum("n")).first()[0] or 0
    now = salted_join(lines, ids, ["id1", "id2"], ["ord", "pos"], total).drop("id1", "id2")
    in_run = Window.partitionBy("ord", F.col("pos") - F.col("nth"))
    now = now.withColumn("nth", F.row_number().over(Window.partitionBy("ord").orderBy("pos")))
    now = now.withColumn("left", F.max("pos").over(in_run) - F.col("pos") + 1).drop("nth")
    now = stash(now.withColumn("ranks", F.array("rank")).withColumn("n", F.lit(2)).drop("rank"), "suffixes")
    width, settled = 1, []
    while True:
        over = (F.col("left") < width) | (F.col("n") == 1)
        settled.append(now.where(over).drop("n"))
        active = now.where(~over).drop("n")
        total = active.count()
        if not total:
            return reduce(DataFrame.unionByName, settled)
        # Settled suffixes are looked up by place alone; a document's suffixes meet in one window.
        idle = [x.select("ord", "pos", F.element_at("ranks", -1).alias("key0")) for x in settled]
        ranked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [active.withColumn("key0", F.element_at("ranks", -1)), *idle])
        for i in range(1, RADIX):
            there = F.first("key0").over(Window.partitionBy("ord").orderBy("pos").rangeBetween(i * width, i * width))
            ranked = ranked.withColumn(f"key{i}", F.coalesce(F.when(F.col("left") > i * width, there), F.lit(0)))
        keys = [f"key{i}" for i in range(RADIX)]
        tuples = stash(ranked.where("ranks is not null"), "tuples")
        each = running(tuples.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", "counted-tuples")
        start = each.groupBy("key0").agg(F.min("before").alias("start"))
        each = each.join(start, "key0").select(*keys, "n", (F.col("key0") + F.col("before") - F.col("start")).alias("rank"), F.col("n").alias("members"))
        now = salted_join(tuples, each, keys, ["ord", "pos"], total).withColumn("ranks", F.concat("ranks", F.array("rank")))
        now, width = stash(now.drop(*keys, "rank").withColumnRenamed("members", "n"), "suffixes"), RADIX * width


def _agree(p: Column, q: Column) -> Column:
    """Lines that two suffixes surely share by their ranks: the largest width at which they are equal, or 0."""
    same = F.size(F.filter(F.zip_with(p, q, lambda x, y: x == y), lambda e: e))
    return F.when(same > 0, F.pow(F.lit(RADIX), same - 1)).otherwise(0).cast("long")


def prefix_lengths(suffixes: DataFrame, enough: int | None = None) -> DataFrame:
    """(rank, place, n, left, lcp) per different suffix, in the order of the
    suffix array: ``place`` counts from 0, ``n`` suffixes are equal to it, and
    ``lcp`` is the number of lines it shares with the one before.

    Ranks by 1, 2, 4, ... lines are compared: the largest width at which two
    neighbours agree is passed over in both, and what follows is compared in
    turn, with smaller widths each time, so rounds are at most as many as
    there are widths. Prefixes that reach ``enough`` are not measured further.
    """
    spot = F.struct("ord", "pos", "left", "ranks")
    each = suffixes.withColumn("rank", F.element_at("ranks", -1)).groupBy("rank").agg(F.min(spot).alias("x"), F.count("*").alias("n"))
    each = running(each.withColumn("one", F.lit(1)), ["rank"], "one", "classes").withColumnRenamed("before", "place").drop("one")
    each = stash(each, "places")
    todo = each.select("place", "x").join(each.select((F.col("place") + 1).alias("place"), F.col("x").alias("y")), "place")
    where = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("ord", "pos")]
    todo = todo.select("place", _agree(F.col("x.ranks"), F.col("y.ranks")).alias("lcp"), F.least("x.left", "y.left", *([] if enough is None else [F.lit(enough)])).alias("least"), *where)
    todo = stash(todo.withColumn("more", F.col("lcp") > 0), "neighbours")

    def on(s: str) -> DataFrame:
        return suffixes.select(F.col("ord").alias(f"{s}_ord"), F.col("pos").alias(f"{s}_at"), F.col("ranks").alias(f"{s}_ranks"))

    done = []
    while True:
        going = F.col("more") & (F.col("lcp") < F.col("least"))
        done.append(todo.where(~going).select("place", "lcp"))
        todo = todo.where(going)
        if todo.isEmpty():
            break
        step = todo.withColumn("x_at", F.col("x_pos") + F.col("lcp")).withColumn("y_at", F.col("y_pos") + F.col("lcp"))
        step = step.join(on("x"), ["x_ord", "x_at"]).join(on("y"), ["y_ord", "y_at"]).withColumn("further", _agree(F.col("x_ranks"), F.col("y_ranks")))
        step = step.withColumn("more", F.col("further") > 0).withColumn("lcp", F.col("lcp") + F.col("further"))
        todo = stash(step.select(*todo.columns), "neighbours")
    lcp = reduce(DataFrame.unionByName, done)
    return each.select("rank", "place", "n", F.col("x.left").alias("left")).join(lcp, "place", "left").fillna(0, ["lcp"])


def _later(suffixes: DataFrame, spread: bool = False) -> DataFrame:
    """Suffixes that are not the first of their rank by (ord, pos); with ``spread`` also ``docs``, the number of documents that have the rank."""
    place = F.min(F.struct("ord", "pos")).alias("first")
    if spread:
        once = suffixes.groupBy("rank", "ord").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
        first = once.groupBy("rank").agg(place, F.sum("n").alias("n"), F.count("*").alias("docs"))
    else:
        first = suffixes.groupBy("rank").agg(place, F.count("*").alias("n"))
    first = stash(first, "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    return salted_join(suffixes, first.where("n > 1"), ["rank"], ["ord", "pos"], total).where((F.col("ord") != F.col("first.ord")) | (F.col("pos") != F.col("first.pos")))


def later_runs(suffixes: DataFrame, lengths: DataFrame, depth: int) -> DataFrame:
    """(ord, pos) of the suffixes whose first ``depth`` lines stand earlier too.

    They are the later members of the longest stretches of the suffix array
    within which every longest common prefix is ``depth`` or more.
    """
    deep = lengths.where(F.col("left") >= depth).withColumn("opens", (F.col("lcp") < depth).cast("int"))
    deep = running(deep, ["place"], "opens", "stretches").select(F.col("rank").alias("last"), "n", (F.col("before") + F.col("opens")).alias("stretch"))
    many = deep.groupBy("stretch").agg(F.sum("n").alias("all")).where("all > 1").select("stretch")
    deep = stash(deep.join(many, "stretch", "left_semi"), "runs")
    total = deep.agg(F.sum("n")).first()[0] or 0
    members = salted_join(suffixes.select("ord", "pos", F.element_at("ranks", -1).alias("last")), deep, ["last"], ["ord", "pos"], total)
    return _later(members.select("ord", "pos", F.col("stretch").alias("rank"))).select("ord", "pos")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """(doc_id, line, last_line, n_lines) per maximal repeated run of ``min_lines`` lines or more.

    From a place in a text, the longest run that stands anywhere else is the
    greater common prefix with its two neighbours in the suffix array; it is
    maximal unless the run from the line before ends there too. Lines count
    from 0 and include blank ones; ``n_lines`` does not. Runs may overlap.
    Null text has none; ids and rows are as in ``dedup_lines``.
    """
    rows = numbered(docs, id_col, text_col, fresh(docs, "ord"))
    rows = rows.select(F.col(rows.columns[-1]).alias("ord"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = stash(line_sequences(rows.select("ord", "text").distinct()), "lines")
    suffixes = suffix_array(lines)
    lengths = stash(prefix_lengths(suffixes), "prefix-lengths")
    after = lengths.select((F.col("place") - 1).alias("place"), F.col("lcp").alias("next"))
    longest = lengths.join(after, "place", "left").select(F.col("rank").alias("last"), F.greatest("lcp", F.coalesce("next", F.lit(0)), F.when(F.col("n") > 1, F.col("left")).otherwise(0)).alias("n_lines"), "n")
    longest = stash(longest, "longest")
    total = longest.agg(F.sum("n")).first()[0] or 0
    found = salted_join(suffixes.select("ord", "pos", F.element_at("ranks", -1).alias("last")), longest, ["last"], ["ord", "pos"], total)
    end = F.col("pos") + F.col("n_lines")
    found = found.withColumn("end", end).withColumn("held", F.coalesce(F.max("end").over(Window.partitionBy("ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    found = found.where((F.col("end") > F.col("held")) & (F.col("n_lines") >= min_lines)).select("ord", "pos", (F.col("end") - 1).alias("to"), "n_lines")
    at = lines.select("ord", "pos", "line")
    found = found.join(at, ["ord", "pos"]).join(at.select("ord", F.col("pos").alias("to"), F.col("line").alias("last_line")), ["ord", "to"])
    return rows.select("ord", "doc_id").join(found, "ord").select("doc_id", "line", "last_line", "n_lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 100, min_docs: int | None = None, min_words: int = 3) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from the text, and
    n_lines, n_removed and n_left (lines that are not blank and stay).

    A run repeats if the same lines stand in the same order elsewhere; it is
    cut where a smaller id, or an earlier place in the same document, has it
    too, if it has ``min_lines`` lines or is one line of ``min_chars``
    characters. With ``min_docs``, it is cut also if it is one line of
    ``min_words`` words that stands in so many different documents, however
    short: boilerplate shows by its spread. Every suffix in a stretch of the
    suffix array with a common prefix of ``min_lines`` or more, but for the
    stretch's first by place, loses that many lines; the suffixes of a maximal
    run cover it together. Runs are judged on the input. Lines end at a line
    feed; blanks at a line's ends do not count in comparing; blank lines are
    passed over and stay.

    Null text stays null and has no lines. Null ids come last; rows with equal
    id and text are one document and keep equal text; rows with an equal id
    alone are kept apart. A text may hold any number of lines: work is linear
    in them. Other columns pass through; where one has the name of a result
    column, the result takes a longer one (``n_lines_``).
    """
    ord_ = fresh(docs, "ord")
    rows = numbered(docs, id_col, text_col, ord_)
    lines = stash(line_sequences(rows.select(F.col(ord_).alias("ord"), F.col(text_col).alias("text")), min_docs is not None), "lines")
    suffixes = suffix_array(lines)
    alone = suffixes.withColumn("rank", F.element_at("ranks", 1))
    long = F.col("chars") >= min_chars
    if min_docs is None:
        single = _later(alone.where(long)).select("ord", "line")
    else:
        single = _later(alone.where(long | (F.col("words") >= min_words)), spread=True).where(long | (F.col("docs") >= min_docs)).select("ord", "line")
    deep = later_runs(suffixes, prefix_lengths(suffixes, min_lines), min_lines).select("ord", F.explode(F.sequence("pos", F.col("pos") + min_lines - 1)).alias("pos"))
    covered = lines.select("ord", "pos", "line").join(deep.distinct(), ["ord", "pos"]).select("ord", "line")
    gone = single.union(covered).groupBy("ord").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("ord").alias("o_"), F.col("gone").alias("g_"))
    out = rows.join(gone, F.col(ord_) == F.col("o_"), "left")
    # The generated column is split once a row; inside a lambda it would be split for every line.
    cut = fresh(docs, "cut")
    out = out.withColumn(cut, F.explode(F.array(F.split(rows[text_col], "\n"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("g_"))
    text = F.when(F.col("g_").isNull(), rows[text_col]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(cut), i)), "\n"))
    n_removed = F.when(F.col("g_").isNull(), 0).otherwise(F.size("g_"))
    filled = F.size(F.filter(cut, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return out.select(
        *[text.alias(c) if c == text_col else rows[c] for c in docs.columns],
        F.when(rows[text_col].isNull(), 0).otherwise(F.size(cut)).cast("long").alias(fresh(docs, "n_lines")),
        n_removed.cast("long").alias(fresh(docs, "n_removed")),
        F.when(rows[text_col].isNull(), 0).otherwise(filled - n_removed).cast("long").alias(fresh(docs, "n_left")),
    )
