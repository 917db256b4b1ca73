"""Repair of conversation structure by cheapest edits, found with bucket-queue shortest paths.

Roles have to read ``(s?(ua)+)?`` by their initials. A place is (rows done,
state); keeping, reroling or deleting the next row and inserting a turn are
arcs with small whole costs. Distances to the end come from Dial's bucket
queue; the audit walks arcs whose cost is the difference of the distances of
their ends, always the one with the least letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from strandgraph.store import stash

SPACE = " \t\n\x0b\x0c\r"
#: Characters of a text by which rows of one turn and role stand in order, before its hashes.
PREFIX = 32
#: About how many rows are edited at once.
PART_ROWS = 1_000_000

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
#: The state after a kept row, by its initial; an empty role has none and changes nothing.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {q: q for q in STATES}}
#: The one state that a turn of a free role can lead to: user, but assistant after user.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
END = {0: 0, 3: 0}
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Faults of a row, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, next state) by state, letters rising."""
    if fault in (BLANK, DUPLICATE):
        return [[("D", DELETE, q)] for q in STATES]
    more = CUT if fault == TRUNCATED else 0
    out = []
    for q in STATES:
        kept = STEP.get(initial, {}).get(q)
        keep = [("K", more, kept)] if kept is not None else []
        out.append([("D", DELETE, q), *keep, ("R", RENAME + more, NEXT[q])])
    return out


_ARCS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "", "?") for f in range(4)}
#: By row kind and next state: (state before, cost).
_BACK = {k: [[(q, cost) for q in STATES for _, cost, t in arcs[q] if t == to] for to in STATES] for k, arcs in _ARCS.items()}
_INSERT_BACK = [[q for q in STATES if NEXT[q] == to] for to in STATES]


def distances(kinds: list[tuple[str, int]], exits: dict[int, int], final: bool) -> list[int | None]:
    """Least cost from place i * 4 + state to the exits, which stand after the
    last row with costs of their own; None where there is no way.

    Dial's queue: a ring of one bucket per cost up to the greatest, in which
    places wait by distance. Turns may be inserted after the last row only
    where the conversation is ``final``ly over.
    """
    n, base = len(kinds), min(exits.values())
    ring = max(RENAME + CUT, DELETE, INSERT, max(exits.values()) - base) + 1
    dist: list[int | None] = [None] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(ring)]
    waiting = len(exits)
    for q, cost in exits.items():
        dist[4 * n + q] = cost - base
        buckets[(cost - base) % ring].append(4 * n + q)
    d = 0
    while waiting:
        bucket = buckets[d % ring]
        while bucket:
            place = bucket.pop()
            waiting -= 1
            if dist[place] != d:
                continue
            i, to = divmod(place, 4)
            before = [(4 * i - 4 + q, cost) for q, cost in _BACK[kinds[i - 1]][to]] if i else []
            if i < n or final:
                before += [(4 * i + q, INSERT) for q in _INSERT_BACK[to]]
            for p, cost in before:
                if dist[p] is None or d + cost < dist[p]:
                    dist[p] = d + cost
                    buckets[(d + cost) % ring].append(p)
                    waiting += 1
        d += 1
    return [None if x is None else x + base for x in dist]


def walk(kinds: list[tuple[str, int]], dist: list[int | None], state: int, final: bool) -> tuple[list[tuple[str, str, int]], str]:
    """(inserted before, letter, state after) of each row, and what is inserted
    after the last: tight arcs from the first place, least letter first."""
    out, i, n, inserted = [], 0, len(kinds), ""
    while i < n or (final and dist[4 * i + state]):
        here = dist[4 * i + state]
        ways = [(*a, 1) for a in _ARCS[kinds[i]][state]] if i < n else []
        for letter, cost, to, rows in sorted([*ways, ("I", INSERT, NEXT[state], 0)]):
            there = dist[4 * (i + rows) + to]
            if there is not None and there + cost == here:
                break
        if rows:
            out.append((inserted, letter, to))
            inserted = ""
        else:
            inserted += ROLE[to][0]
        state, i = to, i + rows
    return out, inserted


def _kinds(table: pa.Table) -> list[tuple[str, int]]:
    known = {"s", "u", "a", ""}
    return [(i if i in known else "?", f) for i, f in zip(table["initial"].to_pylist(), table["fault"].to_pylist(), strict=True)]


def _pieces(table: pa.Table) -> Iterator[tuple[int, int]]:
    """First and end row of each conversation in a part."""
    ids, begin = table["conv"].to_pylist(), 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[begin]:
            yield begin, i
            begin = i


def _edges(table: pa.Table) -> pa.Table:
    """The first and last piece of a part: least costs through it, entry by
    exit, and to the end where the conversation ends with it."""
    table = table.sort_by("seq")
    kinds, pieces = _kinds(table), list(_pieces(table))
    rows = []
    for begin, end in dict.fromkeys([pieces[0], pieces[-1]]):
        some = kinds[begin:end]
        through = [distances(some, {q: 0}, False)[:4] for q in STATES]
        rows.append((table["part"][begin].as_py(), begin == 0, end == len(kinds), table["conv"][begin].as_py(), sum(through, []), distances(some, END, True)[:4]))
    columns = list(zip(*rows, strict=True))
    kinds_ = [pa.int64(), pa.bool_(), pa.bool_(), table.schema.field("conv").type, pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], ["part", "first", "last", "conv", "through", "ends"])


def _chains(edges: list) -> list[list]:
    """Runs of two or more pieces of one conversation in neighbouring parts."""
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, not e.first)):
        if chains and chains[-1][-1].last and e.first and chains[-1][-1].part != e.part and chains[-1][-1].conv == e.conv:
            chains[-1].append(e)
        else:
            chains.append([e])
    return [c for c in chains if len(c) > 1]


def _exits(chains: list[list]) -> dict[int, list]:
    """By part: the costs to the end from the states in which its last piece is
    left, where the conversation goes on in the next part."""
    found = {}
    for chain in chains:
        cost = chain[-1].ends
        for e in reversed(chain[:-1]):
            found[e.part] = cost
            to = [e.through[4 * q : 4 * q + 4] for q in STATES]  # by exit, then entry
            ways = [[to[x][q] + cost[x] for x in STATES if to[x][q] is not None and cost[x] is not None] for q in STATES]
            cost = [min(w) if w else None for w in ways]
    return found


#: Order of a conversation's rows.
KEYS = ["conv", "turn", "role", "prefix", "h1", "h2"]
_CARRIED = [*KEYS, "n", "initial", "fault", "part", "seq"]


def _edits(exits: dict[int, list], continued: set[int]) -> Callable[[pa.Table], pa.Table]:
    """Edits of all rows of a part; where its first piece goes on from the part
    before, for each state in which that may be entered."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        kinds, part = _kinds(table), table["part"][0].as_py()
        take, entry, before, letter, state, after, last = [], [], [], [], [], [], []
        for begin, end in _pieces(table):
            some = kinds[begin:end]
            final = not (end == len(kinds) and part in exits)
            dist = distances(some, END if final else {q: c for q, c in enumerate(exits[part]) if c is not None}, final)
            entries = STATES if begin == 0 and part in continued else [0]
            for q in entries:
                if dist[q] is None:
                    continue
                rows, rest = walk(some, dist, q, final)
                take += range(begin, end)
                entry += [q if len(entries) > 1 else -1] * len(rows)
                for into, column in zip((before, letter, state), zip(*rows, strict=True), strict=True):
                    into += column
                after += [""] * (len(rows) - 1) + [rest]
                last += [False] * (len(rows) - 1) + [begin == 0]
        out = table.select(_CARRIED).take(pa.array(take, pa.int64()))
        for name, column, kind in (("entry", entry, pa.int32()), ("before", before, pa.string()), ("letter", letter, pa.string()), ("state", state, pa.int32()), ("after", after, pa.string()), ("last", last, pa.bool_())):
            out = out.append_column(name, pa.array(column, kind))
        return out

    return run


def _hashes() -> list[Column]:
    return [F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), F.col("role"), F.col("text")).alias("h2")]


def row_edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of (conv, turn, role, text), without texts.

    Rows are known by hashes of role and text; copies of a row within a turn
    are counted before anything is shuffled. Rows are cut into ranges of
    (conv, turn, ...), so a conversation of any length is cut into pieces of
    neighbouring parts. A part gives the costs through its first and last
    piece by states; from these few numbers a part, the driver sums what the
    rest of a cut conversation costs. Then every part finds its edits alone,
    and those of the states that are not entered are dropped.
    """
    shown = F.rtrim("text", F.lit(SPACE))
    bare = F.length(shown) == 0
    cut = ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    small = turns.select("conv", "turn", "role", *_hashes(), bare.alias("bare"), cut.alias("cut"))
    small = small.groupBy(*KEYS, "bare", "cut").agg(F.count("*").alias("n"))
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // PART_ROWS))
    placed = small.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS)
    placed = stash(placed.withColumns({"part": F.spark_partition_id().cast("long"), "seq": F.monotonically_increasing_id()}), "turns")
    seen = placed.groupBy("conv", "h1", "h2").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    fault = F.when(F.col("bare"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    marked = placed.join(seen, "seq", "left").withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})
    marked = stash(marked.select(*_CARRIED), "marked")

    conv = marked.schema["conv"].dataType.simpleString()
    edges = marked.select("part", "seq", "conv", "initial", "fault").groupBy("part")
    edges = edges.applyInArrow(_edges, f"part long, first boolean, last boolean, conv {conv}, through array<long>, ends array<long>").collect()  # two rows a part
    chains = _chains(edges)
    exits, continued = _exits(chains), {e.part for c in chains for e in c[1:]}
    carried = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in _CARRIED)
    schema = f"{carried}, entry int, before string, letter string, state int, after string, last boolean"
    found = stash(marked.groupBy("part").applyInArrow(_edits(exits, continued), schema), "edits")

    way = {(r.part, r.entry): r.state for r in found.where("entry >= 0 and last").select("part", "entry", "state").collect()}  # four a part
    starts = {r.part: r.state for r in _leaving(found, chains)}
    entered = []
    for chain in chains:
        state = starts[chain[0].part]
        for e in chain[1:]:
            entered.append((e.part, state))
            state = way[e.part, state]
    spark = turns.sparkSession
    entered = F.broadcast(spark.createDataFrame(entered, "part long, entered int"))  # a row a part
    found = found.join(entered, "part", "left").where((F.col("entry") < 0) | (F.col("entry") == F.col("entered")))
    return found.withColumnRenamed("state", "became").drop("entered", "entry", "last", "part", "seq")


def _leaving(found: DataFrame, chains: list[list]) -> list:
    """The state in which each chain's first piece is left."""
    if not chains:
        return []
    ends = found.where((F.col("entry") < 0) & F.col("part").isin([c[0].part for c in chains]))
    return ends.groupBy("part").agg(F.max_by("state", "seq").alias("state")).collect()  # at most a row a part


def _told(row: dict, conv: dict) -> None:
    """Add a row's counts to its conversation's."""
    n, fault, turn, letter = row["n"], row["fault"], row["turn"], row["letter"]
    if turn is not None:
        conv["turns"] += turn != conv["most"]
        conv["least"] = turn if conv["least"] is None else conv["least"]
        conv["most"] = turn
    conv["blank"] += n if fault == BLANK else 0
    conv["duplicate"] += 0 if fault == BLANK else n if fault == DUPLICATE else n - 1
    conv["truncated"] += fault == TRUNCATED
    conv["illegal"] += (conv["initial"] is not None and conv["initial"] + row["initial"] not in ("su", "ua", "au")) + n - 1
    conv["initial"] = row["initial"]
    letters = "I" * len(row["before"]) + letter + "D" * (n - 1) + "I" * len(row["after"])
    conv["audit"].append(letters)
    rates = {"I": INSERT, "D": DELETE, "R": RENAME, "K": 0}
    conv["cost"] += sum(rates[c] * letters.count(c) for c in rates) + (CUT if fault == TRUNCATED and letter != "D" else 0)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """(conversation so far, role, text) of each turn of the repaired
    conversations, in order, and (conversation, None, None) at the end of each.

    An edit comes just before the rows with its text; only the first of copies
    is looked at. Nothing of a conversation is held but its counts and audit.
    """
    conv, due = None, None
    new = {"u": "user", "a": "assistant"}
    for batch in batches:
        for row in batch.to_pylist():
            if conv is None or row["conv"] != conv["conv"]:
                if conv is not None:
                    yield conv, None, None
                conv, due = dict(conv=row["conv"], audit=[], least=None, most=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, initial=None, cost=0), None
            if row["kind"] == EDIT:
                _told(row, conv)
                yield from ((conv, new[c], "") for c in row["before"])
                due = row if row["letter"] != "D" else None
                if due is None:
                    yield from ((conv, new[c], "") for c in row["after"])
            elif row["kind"] == TEXT and due is not None:
                yield conv, due["role"] if due["letter"] == "K" else ROLE[due["became"]], row["text"]
                yield from ((conv, new[c], "") for c in due["after"])
                due = None
    if conv is not None:
        yield conv, None, None


#: What a row of the stream is: the name of a conversation, an edit, or a text.
NAME, EDIT, TEXT = range(3)


def _stream(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Edits with their texts, all rows of a conversation in order in one task.

    A conversation's digest takes its turns one after the other, so this is as
    far as it can be cut; the sort spills, and the task holds no conversation.
    """
    edits = row_edits(turns).withColumn("kind", F.lit(EDIT))
    texts = turns.select("conv", "turn", "role", *_hashes(), F.lit(TEXT).alias("kind"), "text")
    names = ids.select("conv").distinct().withColumn("kind", F.lit(NAME))
    rows = edits.unionByName(texts, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    return rows.repartition("conv").sortWithinPartitions(*KEYS, "kind")


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *filled)


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the turns of the cheapest repair of each
    conversation, ``place`` from 0; rules as in ``repair_report``."""
    t = _named(turns, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, place = None, 0
            for conv, role, text in _repaired(batches):
                at, place = (at, place + 1) if conv is at else (conv, 0)
                if role is not None:
                    yield conv["conv"], place, role, text

        yield from _flushed(rows(), to_arrow_schema(shape))

    shape = StructType([StructField("conv_id", t.schema["conv"].dataType), *_fields("place long, role string, text string")])
    return _stream(t, t).mapInArrow(run, shape)


def repair_report(
    turns: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    A conversation's rows stand by turn (nulls first), then role, the first
    PREFIX characters of the text and its hashes. The first fault of a row
    counts: blank (nothing but 0x20 and 0x09 to 0x0D), duplicate (role and text
    seen earlier in the conversation, as two 64-bit hashes tell), truncated
    (does not end in ``.``, ``!`` or ``?``). illegal counts neighbours whose
    initials are not su, ua or au; gaps are the turns missing between the
    least and the greatest. The repair is the cheapest whose roles read
    ``(s?(ua)+)?`` by their initials: keep 0, rerole 3, delete 4 (the only way
    for blanks and duplicates), insert 3, and 3 more for a truncated row that
    stays; ``audit`` holds the initials of the edits in order, of equally cheap
    ones the least. The digest is of the repaired ``role:text`` lines.

    Edits come from ``row_edits``, which cuts long conversations. Texts are
    shuffled once, to stream each conversation through its digest.

    Null roles and texts are one space. A null conversation id is a
    conversation of its own. An empty role has no initial and can be kept
    anywhere. Turns are whole numbers. Conversations of ``ids`` (conv_col)
    without a row here get zeros, an empty audit and the digest of nothing.
    Other columns are not read.
    """
    t = _named(turns, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            digest, lines = hashlib.sha256(), 0
            for conv, role, text in _repaired(batches):
                if role is not None:
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines += 1
                    continue
                gaps = conv["most"] - conv["least"] + 1 - conv["turns"] if conv["turns"] else 0
                yield conv["conv"], gaps, *(conv[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(conv["audit"]), digest.hexdigest()
                digest, lines = hashlib.sha256(), 0

        yield from _flushed(rows(), to_arrow_schema(shape))

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    shape = StructType([StructField("conv_id", t.schema["conv"].dataType), *_fields(counts)])
    return _stream(t, t if ids is None else ids.select(F.col(conv_col).alias("conv"))).mapInArrow(run, shape)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns with faults made by a checksum of their ids.

    crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes ``.!?`` out of it, 3 repeats it, 4 gives it the role user. Nulls are
    one space in ids, roles and texts.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled(text_col), ".!?", "")).otherwise(filled(text_col))
    role = F.when(kind == 4, "user").otherwise(filled(role_col))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = turns.where(kind != 0).select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(times).alias("copy"))
    return out.drop("copy")
