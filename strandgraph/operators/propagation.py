"""Literals followed through the statements of a paragraph, with branches, as joins and windows.

A region is a paragraph's top level or one branch of a decision; each is a
straight run of statements. What is known in a region starts from what is
known where its decision stands, so a name is looked up in its own region
first, then where the decision stands in the region above, and so on. Writes,
the ends of decisions and barriers are events of a region; every lookup is the
last event before it, and chains of copies end by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.effects import BRANCHING, statement_effects
from strandgraph.store import dealt, stash

G = ["program", "paragraph"]
_HERE = [*G, "region"]

#: What an effect does: gives a name a value, copies one, makes a name unknown, or makes all names unknown.
MOVE_TYPE = "array<struct<sub:int, act:string, name:string, source:string, literal:string, status:string, reason:string>>"

#: The regions above a paragraph's top level.
_TOP = "cast(array() as array<struct<region:string, seq:int>>)"


def _move(act: str, name: Column | None = None, source: Column | None = None, literal: Column | None = None, status: str | None = None, reason: Column | str | None = None, sub: Column | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return F.struct(
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"), F.lit(act).alias("act"), text(name).alias("name"), text(source).alias("source"), text(literal).alias("literal"), text(status).alias("status"), text(reason).alias("reason")
    )


def shapeless(a: Column) -> Column:
    """An argument without anything to tell it by: not omitted, of unknown mode, no name and no literal."""
    return ~F.coalesce(a["omitted"], F.lit(False)) & (F.coalesce(a["mode"], F.lit("UNKNOWN")) == "UNKNOWN") & a["name"].isNull() & a["literal"].isNull()


def _moves() -> Column:
    """The moves of an effect, by its kind."""
    k, t = F.col("kind"), F.col("target")
    sure = (F.col("support") == "DETERMINISTIC") & t.isNotNull()
    some = lambda m: F.when(t.isNotNull(), F.array(m)).otherwise(F.expr(f"cast(array() as {MOVE_TYPE})"))
    forget = lambda status, reason: some(_move("KILL", t, None, None, status, reason))
    bar = lambda reason: F.array(_move("BAR", reason=reason))
    open_to = F.filter("arguments", lambda a: ~F.coalesce(a["omitted"], F.lit(False)) & a["name"].isNotNull() & ~F.coalesce(a["mode"], F.lit("UNKNOWN")).isin("CONTENT", "VALUE"))
    names = F.coalesce(F.array_distinct(F.transform(open_to, lambda a: a["name"])), F.expr("cast(array() as array<string>)"))
    told = lambda x, i: _move("KILL", x, None, None, "INVALIDATED", "CALL_BOUNDARY", i)
    back = F.when(F.col("returning").isNotNull(), F.array(told(F.col("returning"), F.lit(-1)))).otherwise(F.expr(f"cast(array() as {MOVE_TYPE})"))
    call = F.when(F.coalesce(F.exists("arguments", shapeless), F.lit(False)), bar("CALL_BOUNDARY")).otherwise(F.concat(F.transform(names, told), back))
    return (
        F.when(k == "ASSIGN_LITERAL", F.when(sure & F.col("literal").isNotNull(), F.array(_move("GIVE", t, None, F.col("literal"), "DIRECT"))).otherwise(forget("PARTIAL", "UNKNOWN_SIDE_EFFECT")))
        .when(k == "SET_CONDITION", F.when(t.isNotNull() & F.col("literal").isNotNull(), F.array(_move("GIVE", t, None, F.col("literal"), "CONDITION"))).otherwise(forget("BLOCKED", F.coalesce("note", F.lit("MULTIPLE_CONDITION_VALUES")))))
        .when(k == "UNSET_CONDITION", forget("BLOCKED", "CONDITION_FALSE_VALUE_UNDETERMINED"))
        .when(k == "COPY", F.when(sure, F.array(_move("COPY", t, F.col("source")))).otherwise(forget("UNRESOLVED_COPY", "UNKNOWN_SIDE_EFFECT")))
        .when(k == "COMPUTE", forget("INVALIDATED", "COMPUTED_VALUE")).when(k == "SET_VALUE", forget("INVALIDATED", "UNKNOWN_SIDE_EFFECT"))
        .when(k == "SQL_WRITE", forget("INVALIDATED", "SQL_HOST_DIRECTION_UNKNOWN"))
        .when(k == "CALL", call).when(k == "JUMP", bar("CONTROL_FLOW_BOUNDARY")).when(k == "PERFORM", bar("LOOP_OR_PERFORM_BOUNDARY"))
        .when(k == "UNKNOWN", bar("UNSUPPORTED_STATEMENT")).when(k == "PRESERVED", bar("UNKNOWN_SIDE_EFFECT"))
    )


def symbol_table(items: DataFrame) -> DataFrame:
    """(program, name, key, ambiguous) from (program, qualified, simple): a
    qualified name is itself, a simple one the only item of that name; of
    several it is ambiguous and stays as it is."""
    whole = items.select("program", F.col("qualified").alias("name"), F.col("qualified").alias("key"), F.lit(False).alias("ambiguous"), F.lit(0).alias("after"))
    short = items.groupBy("program", F.col("simple").alias("name")).agg(F.count("*").alias("n"), F.min("qualified").alias("one"))
    short = short.select("program", "name", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("name")).alias("key"), (F.col("n") > 1).alias("ambiguous"), F.lit(1).alias("after"))
    best = whole.union(short).where("name is not null").groupBy("program", "name").agg(F.min(F.struct("after", "key", "ambiguous")).alias("s"))
    return best.select("program", "name", "s.key", "s.ambiguous")


def _resolved(moves: DataFrame, items: DataFrame | None) -> DataFrame:
    """``moves`` with the identities ``key`` and ``from_key`` of name and source; ambiguous ones are blocked."""
    if items is None:
        return moves.withColumns({"key": F.col("name"), "from_key": F.col("source"), "seen": F.col("name")})
    table = stash(symbol_table(items), "symbols")
    a = table.select(F.col("program").alias("pa_"), F.col("name").alias("na_"), F.col("key").alias("ka_"), F.col("ambiguous").alias("aa_"))
    b = table.select(F.col("program").alias("pb_"), F.col("name").alias("nb_"), F.col("key").alias("kb_"), F.col("ambiguous").alias("ab_"))
    m = moves.join(a, (F.col("program") == F.col("pa_")) & (F.col("name") == F.col("na_")), "left").join(b, (F.col("program") == F.col("pb_")) & (F.col("source") == F.col("nb_")), "left")
    unclear = F.coalesce("aa_", F.lit(False)) & F.col("act").isin("GIVE", "COPY") & F.coalesce(F.col("status") != "CONDITION", F.lit(True))
    dim = F.coalesce("ab_", F.lit(False)) & (F.col("act") == "COPY")
    out = m.withColumns({"key": F.coalesce("ka_", "name"), "from_key": F.coalesce("kb_", "source"), "seen": F.when(dim & ~unclear, F.col("source")).otherwise(F.col("name")), "blocked": unclear | dim})
    changed = {"act": F.lit("KILL"), "status": F.lit("BLOCKED"), "reason": F.lit("AMBIGUOUS_SYMBOL"), "literal": F.lit(None).cast("string")}
    out = out.withColumns({c: F.when(F.col("blocked"), v).otherwise(F.col(c)) for c, v in changed.items()})
    return out.drop("pa_", "na_", "ka_", "aa_", "pb_", "nb_", "kb_", "ab_", "blocked")


def _numbered(statements: DataFrame) -> DataFrame:
    """``statements``, written, with ``seq``, their place in the paragraph, ``run``,
    the branch among those of their parent, and ``whole``: all of the parent's children have a branch.

    A branch starts where the branch kind changes or a condition is named.
    """
    s = statements.withColumn("seq", F.row_number().over(Window.partitionBy(*G).orderBy("pos", "statement_id")))
    siblings = Window.partitionBy(*G, "parent_id").orderBy("seq")
    new = F.coalesce((F.col("branch_kind") != F.lag("branch_kind").over(siblings)) | F.col("branch_condition").isNotNull(), F.lit(True))
    whole = F.min(F.col("branch_kind").isNotNull()).over(Window.partitionBy(*G, "parent_id"))
    s = s.withColumn("new", new.cast("int"))
    return stash(s.withColumns({"run": F.sum("new").over(siblings) - 1, "whole": whole}).drop("new", "branch_condition"), "statements")


def regions(s: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(program, paragraph, parent_id, run, region, above) of the branches that run, and (program,
    paragraph, statement_id, seq, region, above) of decisions whose branches cannot be told; None without any.

    ``s`` are numbered statements. ``region`` is a branch's path below the
    top level, whose own is empty; ``above`` lists (region, seq) of the
    decisions it lies in. Children of other statements than decisions do not
    run here. Regions are numbered level by level of nesting; a level handles
    all paragraphs at once, and reads decisions and branches alone.
    """
    below = s.where("parent_id is not null")
    runs = stash(below.groupBy(*G, "parent_id", "run").agg(F.min("branch_kind").alias("branch_kind"), F.bool_and("whole").alias("whole")), "runs")
    if runs.isEmpty():
        return None
    decides = F.col("kind").isin(BRANCHING)
    nested = not below.where(decides).isEmpty()
    now = s.where("parent_id is null").where(decides).select(*G, F.col("statement_id").alias("parent_id"), "seq", F.lit("").alias("region"), F.expr(_TOP).alias("above"))
    found, vague = [], []
    while True:
        inner = stash(now.join(runs, [*G, "parent_id"]), "branches")
        vague.append(inner.where("not whole").select(*G, F.col("parent_id").alias("statement_id"), "seq", "region", "above").distinct())
        path = F.concat("region", F.lit("::"), F.concat_ws("::", F.col("parent_id"), F.col("branch_kind"), F.col("run").cast("string")))
        inside = inner.where("whole").select(*G, "parent_id", "run", path.alias("region"), F.concat(F.array(F.struct("region", "seq")), "above").alias("above"))
        found.append(inside)
        if not nested or inner.isEmpty():
            break
        now = below.where(decides).join(inside, [*G, "parent_id", "run"]).select(*G, F.col("statement_id").alias("parent_id"), "seq", "region", "above")
    return reduce(DataFrame.union, found), reduce(DataFrame.union, vague)


def _at(seq: Column, ordinal: Column | int, sub: Column | int) -> Column:
    number = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(seq.cast("int").alias("seq"), number(ordinal).alias("ordinal"), number(sub).alias("sub"))


def _placed_moves(statements: DataFrame, effects: DataFrame | None, items: DataFrame | None) -> DataFrame:
    """Moves with (region, above, at, key, from_key, seen, eid), written; a decision whose branches cannot be told is a BAR.

    Without ``effects`` the statements' own are taken from the rows that hold
    them, so only the moves of branches are joined, with their regions.
    """
    place = ["seq", "parent_id", "run"]
    if effects is None:
        s = _numbered(statements)
        e = statement_effects(s, keep=place)
    else:
        s, e = _numbered(statements.select(*G, "statement_id", "pos", "parent_id", "kind", "branch_kind", "branch_condition")), effects
    for name, kind in (("arguments", "array<struct<name:string, mode:string, literal:string, omitted:boolean>>"), ("returning", "string"), ("note", "string")):
        if name not in e.columns:
            e = e.withColumn(name, F.lit(None).cast(kind))
    own = [] if effects is not None else place
    moves = e.select(*G, "statement_id", "ordinal", *own, F.explode(_moves()).alias("m")).select(*G, "statement_id", "ordinal", *own, "m.*")
    moves = moves.where("act = 'BAR' or name is not null")
    if items is not None:
        moves = _resolved(moves, items)
    if effects is not None:
        moves = moves.join(s.select(*G, "statement_id", *place), [*G, "statement_id"])
    if effects is not None or items is not None:
        # Names of one call that are one item are forgotten once.
        twice = Window.partitionBy(*G, "statement_id", "ordinal", "name" if items is None else "key", F.col("sub") < 0).orderBy("sub")
        moves = moves.withColumn("nth", F.when(F.col("reason") == "CALL_BOUNDARY", F.row_number().over(twice)).otherwise(1)).where("nth = 1").drop("nth")
    moves = moves.withColumn("at", _at(F.col("seq"), F.col("ordinal"), F.when(F.col("sub") < 0, 1 << 30).otherwise(F.col("sub")))).drop("seq", "ordinal", "sub")
    placed = moves.where("parent_id is null").drop("parent_id", "run").withColumns({"region": F.lit(""), "above": F.expr(_TOP)})
    inside = regions(s)
    if inside is not None:
        branches, vague = inside
        placed = placed.unionByName(moves.where("parent_id is not null").join(branches, [*G, "parent_id", "run"]).drop("parent_id", "run"))
        barred = vague.withColumns({"act": F.lit("BAR"), "reason": F.lit("UNDETERMINED_BRANCHES"), "at": _at(F.col("seq"), 0, 0)}).drop("seq")
        placed = placed.unionByName(barred, allowMissingColumns=True)
    held = stash(placed.withColumn("eid", F.monotonically_increasing_id()), "moves")
    return held if items is not None else _resolved(held, None)


def _above(a: Column, ordinal: int) -> Column:
    """Where a decision stands in the region above: 0, or less for what comes before its end."""
    return _at(a["seq"], ordinal, 0)


def _events(moves: DataFrame) -> DataFrame:
    """(program, paragraph, region, key, at, w) of writes, in their own region and as ends of the decisions above."""
    return moves.select(*G, F.explode(_happenings(False)).alias("h")).select(*G, "h.*").where("w is not null").select(*_HERE, "key", "at", "w")


def _happenings(barred: bool) -> Column:
    """What a move is in its region and in those above: ``w`` a write (its literal,
    or the copy that it is, or neither), or ``node`` and ``level`` a question for
    the last write of a name. A copy asks in its own region and where each
    decision above stands, a WANT in the regions above alone. With ``barred``
    writes hold where they are, and ``bar`` is a barrier.
    """
    place = "struct<seq:int,ordinal:int,sub:int>"
    kind = f"struct<literal:string,to:bigint{',at:' + place if barred else ''}>"
    more = f",bar:{place}" if barred else ""
    null = lambda c, as_: (F.lit(None) if c is None else c).cast(as_)
    row = lambda region, at, key=None, w=None, node=None, level=None, bar=None: F.struct(
        region.alias("region"), null(key, "string").alias("key"), at.alias("at"), null(w, kind).alias("w"), null(node, "long").alias("node"), null(level, "int").alias("level"), *([null(bar, place).alias("bar")] if barred else [])
    )
    none = F.expr(f"cast(array() as array<struct<region:string,key:string,at:{place},w:{kind},node:bigint,level:int{more}>>)")
    if_ = lambda condition, rows: F.when(condition, rows).otherwise(none)
    act, region, key, asked, at, eid, above = (F.col(c) for c in ("act", "region", "key", "from_key", "at", "eid", "above"))
    write = lambda where, literal=None, to=None: F.struct(null(literal, "string"), null(to, "long"), *([where] if barred else []))
    given = write(at, F.when(act == "GIVE", F.col("literal")), F.when(act == "COPY", eid))
    writes = F.concat(F.array(row(region, at, key, given)), F.transform(above, lambda a: row(a["region"], _above(a, 0), key, write(_above(a, 0)))))
    asks = F.transform(above, lambda a, i: row(a["region"], _above(a, -2), asked, None, eid, i + 1))
    bars = [if_(act == "BAR", F.concat(F.array(row(region, at, bar=at)), F.transform(above, lambda a: row(a["region"], _above(a, 0), bar=_above(a, 0)))))] if barred else []
    return F.concat(if_(act.isin("GIVE", "COPY", "KILL"), writes), if_(act == "COPY", F.array(row(region, at, asked, None, eid, F.lit(0)))), if_(act.isin("COPY", "WANT"), asks), *bars)


def _pointers(moves: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(node, to, literal, steps) of copies, by ``eid``, and of names ``wanted`` (program,
    paragraph, region, above, key, node) where a region begins: a literal, or the
    copy to go on with; no row where nothing is known.

    A name is known by the last write in the nearest region that has one or a
    barrier. Moves are shuffled once, by paragraph, before they are taken
    apart; windows and groups below stay within it. ``wanted`` is None if
    there are no barriers.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = moves.select(*_HERE, "above", "key", "from_key", "at", "act", "literal", "eid")
    if wanted is not None:
        rows = rows.unionByName(wanted.select(*_HERE, "above", F.col("key").alias("from_key"), F.lit("WANT").alias("act"), F.col("node").alias("eid")), allowMissingColumns=True)
    rows = dealt(rows, *G).select(*G, F.explode(_happenings(wanted is not None)).alias("h")).select(*G, "h.*")
    own = F.col("last").isNotNull()
    stops = own
    if wanted is not None:
        barred = F.last("bar", ignorenulls=True).over(before(Window.partitionBy(*_HERE).orderBy("at")))
        rows = rows.withColumn("barred", barred).where("bar is null").drop("bar")
        own = own & (F.col("barred").isNull() | (F.col("last.at") > F.col("barred")))
        stops = own | F.col("barred").isNotNull()
    # A copy asks before it writes.
    last = F.last("w", ignorenulls=True).over(before(Window.partitionBy(*_HERE, "key").orderBy("at", F.asc_nulls_last("level"))))
    q = rows.withColumn("last", last).where("node is not null").where(stops)
    nearest = q.groupBy(*G, "node").agg(F.min(F.struct("level", F.when(own, F.col("last.to")).alias("to"), F.when(own, F.col("last.literal")).alias("literal"))).alias("s"))
    return nearest.where("s.to is not null or s.literal is not null").select("node", "s.to", "s.literal", F.lit(1).cast("long").alias("steps"))


def _doubled(now: DataFrame) -> DataFrame:
    """Pointers followed to their ends: (node, literal, steps), steps the sum on the way."""
    now = stash(now, "pointers")
    going = F.col("to").isNotNull() & F.col("literal").isNull()
    while not now.where(going).isEmpty():
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to_"), F.col("literal").alias("literal_"), F.col("steps").alias("steps_"))
        moved = now.where(going).join(ahead, "to", "left").select("node", F.col("to_").alias("to"), F.col("literal_").alias("literal"), (F.col("steps") + F.coalesce("steps_", F.lit(0))).alias("steps"))
        now = stash(now.where(~going).unionByName(moved), "pointers")
    return now.select("node", "literal", "steps")


def propagate(statements: DataFrame, effects: DataFrame | None = None, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts and barriers of literals followed through each paragraph.

    Facts are (program, paragraph, region, statement_id, at, status, target,
    key, literal, steps): DIRECT and CONDITION give a literal, PROPAGATED
    copies one, UNRESOLVED_COPY has none to copy, BLOCKED and INVALIDATED make
    a name unknown. Barriers are (program, paragraph, region, statement_id,
    at, reason, affected, clears): one that clears makes every name known
    there unknown, each with an INVALIDATED fact, and lists them; the others
    list the names of their effect. A call clears only if an argument has no
    shape; else it forgets what it passes by reference or in an unknown mode
    and what it returns to, and without such a name it is no barrier.

    A branch starts from what is known at its decision; after the decision
    any name that a branch wrote is unknown, and all are if a branch has a
    barrier. A decision with a child of no branch clears without facts.

    A known value lives from its write to the next event of its name or
    barrier of its region, so each value meets one barrier at most in its own
    region, and one in each branch that inherits it. ``items`` (program,
    qualified, simple) resolves names; without it names are as they are
    written. Null targets and names are left out. Without ``effects`` they
    are those of the statements, without declared conditions, which saves a join.
    """
    moves = _placed_moves(statements, effects, items)
    direct = moves.where("act = 'BAR'").select(*_HERE, "above", "at", "statement_id", "reason")
    barred = not direct.isEmpty()
    inherited = None
    if barred:
        up = direct.select(*G, F.explode("above").alias("a")).select(*G, "a.region", _above(F.col("a"), 0).alias("at"))
        bars = stash(direct.select(*_HERE, "at").union(up).distinct(), "bars")
        firsts = bars.groupBy(*_HERE).agg(F.min("at").alias("bar"))
        first_own = direct.join(firsts, _HERE).where("at = bar")
        # What regions with a barrier inherit: names given or copied before it further up.
        outer = first_own.select(*_HERE, "above", F.explode("above").alias("a")).select(*_HERE, "above", F.col("a.region").alias("r_"), F.col("a.seq").alias("s_"))
        given = moves.where("act in ('GIVE', 'COPY')").select(*G, F.col("region").alias("r_"), "key", F.col("at.seq").alias("seq"))
        inherited = outer.join(given, [*G, "r_"]).where("seq < s_").groupBy(*_HERE, "key").agg(F.first("above").alias("above"))
        inherited = stash(inherited.withColumn("node", -1 - F.monotonically_increasing_id()), "inherited")
    value = _doubled(_pointers(moves, inherited)).where("literal is not null")

    whole = F.concat(F.concat_ws("::", F.col("program"), F.col("paragraph"), F.lit("root")), F.col("region"))
    copied = moves.where("act = 'COPY'").drop("literal").join(value.withColumnRenamed("node", "eid"), "eid", "left")
    copied = copied.withColumn("status", F.when(F.col("literal").isNotNull(), "PROPAGATED").otherwise("UNRESOLVED_COPY")).withColumn("steps", F.when(F.col("literal").isNotNull(), F.col("steps") + 1).otherwise(0).cast("long"))
    plain = moves.where("act in ('GIVE', 'KILL')").withColumn("steps", F.when(F.col("act") == "GIVE", 1).otherwise(0).cast("long"))
    fact = [*_HERE, "statement_id", "at", "status", F.col("name").alias("target"), "key", "literal", "steps"]
    facts = copied.select(*fact).unionByName(plain.select(*fact))

    single = moves.where("act = 'KILL' and reason is not null").withColumn("part", F.when(F.col("reason").isin("COMPUTED_VALUE", "AMBIGUOUS_SYMBOL"), F.col("at.ordinal")).otherwise(-1))
    single = single.groupBy(*_HERE, "statement_id", "reason", "part").agg(F.min("at").alias("at"), F.array_sort(F.collect_set("seen")).alias("affected")).withColumn("clears", F.lit(False))
    barrier = [*_HERE, "statement_id", "at", "reason", "affected", "clears"]
    barriers = single.select(*barrier)
    if barred:
        lost = _lost(moves, direct, bars, firsts, inherited, value)
        null = F.lit(None).cast("string")
        gone = lost.where("reason <> 'UNDETERMINED_BRANCHES'").select(*_HERE, "statement_id", "at", F.lit("INVALIDATED").alias("status"), F.col("key").alias("target"), "key", null.alias("literal"), F.lit(0).cast("long").alias("steps"))
        listed = lost.groupBy(*_HERE, "statement_id", "at").agg(F.array_sort(F.collect_set("key")).alias("affected"))
        clears = direct.drop("above").join(listed, [*_HERE, "statement_id", "at"], "left").withColumn("affected", F.coalesce("affected", F.expr("cast(array() as array<string>)")))
        clears = clears.withColumns({"reason": F.when(F.col("reason") == "UNDETERMINED_BRANCHES", "CONTROL_FLOW_BOUNDARY").otherwise(F.col("reason")), "clears": F.lit(True)})
        facts, barriers = facts.unionByName(gone), clears.select(*barrier).unionByName(barriers)
    return facts.withColumn("region", whole), barriers.withColumn("region", whole)


def _lost(moves: DataFrame, direct: DataFrame, bars: DataFrame, firsts: DataFrame, inherited: DataFrame, value: DataFrame) -> DataFrame:
    """(program, paragraph, region, statement_id, at, reason, key) of values that meet a
    barrier, of the region's own writes and inherited ones; reads regions with barriers alone."""
    events = _events(moves).join(firsts.select(*_HERE), _HERE, "left_semi")
    ends = events.withColumn("next", F.lead("at").over(Window.partitionBy(*_HERE, "key").orderBy("at"))).where("w.literal is not null or w.to is not null")
    known = value.select(F.col("node").alias("node_"))
    alive = ends.join(known, F.col("w.to") == F.col("node_"), "left").where("w.literal is not null or node_ is not null").select(*_HERE, "key", "at", "next")
    ahead = Window.partitionBy(*_HERE).orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    met = alive.unionByName(bars.withColumn("bar", F.col("at")), allowMissingColumns=True).withColumn("bar", F.first("bar", ignorenulls=True).over(ahead))
    met = met.where("key is not null and bar is not null and (next is null or bar < next)").select(*_HERE, "key", "bar")
    begun = events.groupBy(*_HERE, "key").agg(F.min("at").alias("first"))
    taken = inherited.join(value, "node", "left_semi").select(*_HERE, "key").join(firsts, _HERE).join(begun, [*_HERE, "key"], "left")
    met = met.unionByName(taken.where("first is null or bar < first").select(*_HERE, "key", "bar")).withColumnRenamed("bar", "at")
    return stash(direct.join(met, [*_HERE, "at"]).select(*_HERE, "statement_id", "at", "reason", "key"), "lost")


def numbered_facts(facts: DataFrame) -> DataFrame:
    """``facts`` with (fact_id, ordinal): their number among those of the same
    region, name, statement and status, in order."""
    same = Window.partitionBy(*_HERE, "target", "statement_id", "status").orderBy("at", "key")
    out = facts.withColumn("ordinal", (F.row_number().over(same) - 1).cast("long"))
    return out.withColumn("fact_id", F.concat_ws("::", F.lit("fact"), "program", "paragraph", "region", "target", "statement_id", "status", F.col("ordinal").cast("string")))


def numbered_barriers(barriers: DataFrame) -> DataFrame:
    """``barriers`` with (barrier_id, ordinal), numbered as facts are."""
    same = Window.partitionBy(*_HERE, "statement_id", "reason").orderBy("at", "affected")
    out = barriers.withColumn("ordinal", (F.row_number().over(same) - 1).cast("long"))
    return out.withColumn("barrier_id", F.concat_ws("::", F.lit("barrier"), "program", "paragraph", "region", "statement_id", "reason", F.col("ordinal").cast("string")))


def branching_constants(statements: DataFrame, effects: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(program, paragraph, statement_id, ordinal, status, target, literal, steps)
    of the facts of ``propagate``, numbered within their paragraph."""
    facts, _ = propagate(statements, effects, items)
    order = Window.partitionBy(*G).orderBy("at", "key", "region")
    return facts.select(*G, "statement_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "status", "target", "literal", "steps")
