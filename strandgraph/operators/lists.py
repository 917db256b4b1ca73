"""Linked lists and trees ranked by pointer doubling.

Every round doubles the length of the jumps that a row stands for, so a list
of n links takes about log2(n) rounds, each a few joins of narrow tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.store import stash_dealt as stash


def walk_from(heads: DataFrame, links: DataFrame, keys: list[str], node: str = "node", following: str = "following") -> DataFrame:
    """(keys, node, rank): the nodes on the way from each head, each once, with
    the number of links to it.

    ``heads`` has the keys and ``node``; ``links`` the keys, ``node`` and
    ``following``, the next node or null. Round k adds to every marked node
    the one 2^k links on; the walk has ended when a round adds none. So what
    no head leads to is never marked, and a way that comes back to a marked
    node stops there. Heads and next nodes without a row are not on the way.
    """
    jump = stash(links.select(*keys, F.col(node).alias("node"), F.col(following).alias("to")).where("node is not null").groupBy(*keys, "node").agg(F.min("to").alias("to")), "jumps")
    there = jump.select(*keys, "node")
    marked = heads.select(*keys, F.col(node).alias("node")).distinct().join(there, [*keys, "node"], "left_semi")
    marked, length = stash(marked.withColumn("rank", F.lit(0).cast("long")), "marks"), 1
    while True:
        ahead = marked.join(jump, [*keys, "node"]).select(*keys, F.col("to").alias("node"), (F.col("rank") + length).alias("rank"))
        new = ahead.join(there, [*keys, "node"], "left_semi").join(marked, [*keys, "node"], "left_anti")
        new = stash(new.groupBy(*keys, "node").agg(F.min("rank").alias("rank")), "marks")
        if new.isEmpty():
            return marked
        marked = stash(marked.unionByName(new), "marks")
        on = jump.select(*keys, F.col("node").alias("to"), F.col("to").alias("to_"))
        jump, length = stash(jump.join(on, [*keys, "to"]).select(*keys, "node", F.col("to_").alias("to")).where("to is not null"), "jumps"), 2 * length


def chain_status(pointers: DataFrame, events: DataFrame, group: str, head: str, event: str, previous: str, seq: str | None = None, active: str | None = None, becomes: str | None = None) -> DataFrame:
    """(group, status, length, stopped_at, issues): each group's chain from the
    event that its pointer names, by ``previous``.

    CYCLIC if the walk comes back to an event it has passed, BROKEN if it names
    one that does not exist, EMPTY if there is no pointer or it names nothing;
    else VALID. ``stopped_at`` is the event at which the first two stopped,
    ``length`` the events passed. Events that the pointer does not lead to
    are orphans and play no part. With ``seq`` a chain that is whole is BROKEN
    too if numbers do not fall by one a link or do not end at 1; with
    ``active`` (of the pointer) and ``becomes`` (of events), if the head's is
    not the active one. ``issues`` names all that was found.
    """
    e = events.where(F.col(event).isNotNull())
    more = [c for c in (previous, seq, becomes) if c is not None]
    one = e.groupBy(group, F.col(event).alias("node")).agg(F.min(F.struct(*[F.col(c) for c in more])).alias("e")).select(group, "node", *[f"e.{c}" for c in more])
    one = stash(one, "events")
    p = pointers.groupBy(group).agg(F.min(F.struct(F.col(head).alias("node"), *([F.col(active).alias("active")] if active else []))).alias("p")).select(group, "p.*")
    p = stash(p, "pointers")
    passed = walk_from(p.where("node is not null"), one, [group], "node", previous).join(one, [group, "node"])
    passed = passed.withColumn("rank_", F.struct("rank", "node"))
    before = Window.partitionBy(group).orderBy("rank")
    if seq is not None:
        step = F.lag(seq).over(before)
        passed = passed.withColumn("uneven", (step.isNotNull() & (F.col(seq) != step - 1)).cast("int"))
    own = [F.count("*").alias("length"), F.max_by(previous, "rank").alias("last"), *([F.max_by(seq, "rank").alias("low"), F.max("uneven").alias("uneven")] if seq else []), *([F.min_by(becomes, "rank").alias("newest")] if becomes else [])]
    out = p.join(passed.groupBy(group).agg(*own), group, "left").withColumn("length", F.coalesce("length", F.lit(0)))
    stopped = F.when(F.col("length") == 0, F.col("node")).otherwise(F.col("last"))
    known = one.select(F.col(group).alias("g_"), F.col("node").alias("n_"))
    out = out.withColumn("stopped_at", stopped).join(known, (F.col(group) == F.col("g_")) & (F.col("stopped_at") == F.col("n_")), "left")
    cyclic, broken = F.col("n_").isNotNull(), F.col("stopped_at").isNotNull() & F.col("n_").isNull()
    issues = [F.when(cyclic, "EVENT_CHAIN_CYCLE"), F.when(broken, "EVENT_CHAIN_BROKEN"), F.when(F.col("node").isNull(), "EVENT_CHAIN_EMPTY")]
    if seq is not None:
        issues += [F.when(F.col("uneven") == 1, "EVENT_SEQUENCE_INVALID"), F.when(~cyclic & ~broken & (F.col("uneven") == 0) & (F.col("low") != 1), "EVENT_CHAIN_BROKEN")]
    whole = F.size(F.array_compact(F.array(*issues))) == 0
    if active is not None:
        issues.append(F.when(whole & ~F.col("newest").eqNullSafe(F.col("active")), "EVENT_POINTER_MISMATCH"))
    found = F.array_compact(F.array(*issues))
    status = F.when(cyclic, "CYCLIC").when(broken, "BROKEN").when(F.col("node").isNull(), "EMPTY").when(F.size(found) > 0, "BROKEN").otherwise("VALID")
    return out.select(group, status.alias("status"), "length", F.when(cyclic | broken, F.col("stopped_at")).alias("stopped_at"), found.alias("issues"))


#: Siblings that are linked in one window are those of one parent and bucket.
BUCKETS = 64


def tour(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, enter, leave, depth): nested-set numbers of a forest.

    A walk round each tree goes down into a node and up out of it; it is a
    linked list of two items a node, ranked by pointer doubling from its end.
    A node lies under another if its numbers lie between the other's. Roots
    have no parent or one without a row; a node that has several parents keeps
    the least. Nodes on a cycle, or below one, have no row. Siblings are
    linked within buckets, and buckets with one another, so a parent of very
    many children is no hot key. Numbers are whole and distinct within a
    tree; trees are told apart by ``root``.
    """
    t = tree.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
    rows = t.select(F.col("node").alias("p_"))
    t = t.join(rows, F.col("parent") == F.col("p_"), "left").select("node", F.col("p_").alias("parent"), F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).alias("bucket"))
    t = stash(t, "tree")
    below = t.where("parent is not null")
    within = Window.partitionBy("parent", "bucket").orderBy("node")
    linked = below.withColumn("next", F.lead("node").over(within))
    ends = stash(below.groupBy("parent", "bucket").agg(F.min("node").alias("first")), "ends")
    ahead = ends.withColumn("over", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket"))).select("parent", "bucket", "over")
    linked = linked.join(ahead, ["parent", "bucket"]).select("node", F.coalesce("next", "over").alias("next"))
    first = ends.groupBy(F.col("parent").alias("node")).agg(F.min_by("first", "bucket").alias("child"))
    n = t.join(first, "node", "left").join(linked, "node", "left")
    item = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    down = n.select(item("node", False).alias("item"), F.when(F.col("child").isNotNull(), item("child", False)).otherwise(item("node", True)).alias("to"), F.lit(1).cast("long").alias("depth"))
    on = F.when(F.col("next").isNotNull(), item("next", False)).when(F.col("parent").isNotNull(), item("parent", True))
    up = n.select(item("node", True).alias("item"), on.alias("to"), F.lit(-1).cast("long").alias("depth"))
    now = stash(down.union(up).withColumns({"steps": F.lit(1).cast("long"), "end": F.when(F.col("to").isNull(), F.col("item"))}), "tour")
    rounds = max(1, (2 * t.count()).bit_length())
    for _ in range(rounds):
        open_ = now.where("to is not null")
        if open_.isEmpty():
            break
        ahead = now.select(F.col("item").alias("to"), F.col("to").alias("to_"), F.col("steps").alias("steps_"), F.col("depth").alias("depth_"), F.col("end").alias("end_"))
        moved = open_.join(ahead, "to").select("item", F.col("to_").alias("to"), (F.col("depth") + F.col("depth_")).alias("depth"), (F.col("steps") + F.col("steps_")).alias("steps"), F.col("end_").alias("end"))
        now = stash(now.where("to is null").unionByName(moved), "tour")
    done = now.where("to is null").select(F.col("item.node").alias("node"), "item.up", "steps", "depth", F.col("end.node").alias("root"))
    # Ranks count from the end, so what is entered first has the greatest; depth sums what is still to come up.
    ends = done.groupBy("node").agg(F.max(F.when(~F.col("up"), -F.col("steps"))).alias("enter"), F.max(F.when(F.col("up"), -F.col("steps"))).alias("leave"), F.max(F.when(F.col("up"), -F.col("depth"))).alias("depth"), F.max("root").alias("root"))
    return ends.where("enter is not null and leave is not null").select("node", "root", "enter", "leave", (F.col("depth") - 1).alias("depth"))
