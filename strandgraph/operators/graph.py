"""Path patterns, bounded reachability and recursion over node and edge tables.

An edge table has a source and a target column; every operator takes their
names, so the same code runs on a property graph and on any pair of keys.
Loops cut lineage with tables in the shared folder and stop when a round adds
nothing; the driver sees counts alone.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.lists import tour
from strandgraph.operators.prefix import running
from strandgraph.store import stash_dealt as stash


def chain(start: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Fixed path: join each (table, left key, right key) in turn.

    Filters belong on ``start`` and the tables before they are passed, so they
    reach the scans; Catalyst then picks broadcast or shuffle per step.
    """
    out = start
    for table, left, right in steps:
        out = out.join(table, F.col(left) == F.col(right))
    return out


def reach(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", seed: str = "seed", backward: bool = True) -> DataFrame:
    """(seed, node, depth): nodes within 1..``depth`` edges of each seed, with the least depth.

    Backward follows edges from target to source. A seed that a cycle leads
    back to appears with the length of its shortest cycle. Nulls never match.
    """
    if not 1 <= depth <= 100:
        raise ValueError("depth must be from 1 to 100")
    come, go = (dst, src) if backward else (src, dst)
    e = stash(edges.select(F.col(come).alias("at"), F.col(go).alias("node")).where("at is not null and node is not null").distinct(), "edges")
    front = seeds.select(F.col(seed).alias("seed")).where("seed is not null").distinct().withColumn("at", F.col("seed"))
    found = None
    for d in range(1, depth + 1):
        new = front.join(e, "at").select("seed", "node").distinct()
        if found is not None:
            new = new.join(found, ["seed", "node"], "left_anti")
        new = stash(new.withColumn("depth", F.lit(d)), "front")
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            break
        front = new.select("seed", F.col("node").alias("at"))
    return found


def two_lane_slice(first: DataFrame, second: DataFrame, seeds: DataFrame, depth: int, names: tuple[str, str] = ("DATA_DEPENDENCY", "CONTROL_DEPENDENCY"), src: str = "src", dst: str = "dst", seed: str = "seed") -> DataFrame:
    """(seed, node, reason): nodes that reach the seed over either kind of edge
    alone. The seed itself is CANDIDATE, nodes of both lanes BOTH."""
    # One walk for both: a node of a lane is a pair, so lanes never mix.
    at = lambda lane, c: F.struct(F.lit(lane).alias("lane"), F.col(c).alias("node"))
    known = lambda e: e.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    lanes = [known(e).select(at(i, src).alias("src"), at(i, dst).alias("dst")) for i, e in enumerate((first, second))]
    starts = seeds.where(F.col(seed).isNotNull()).select(F.explode(F.array(at(0, seed), at(1, seed))).alias("seed"))
    found = reach(lanes[0].union(lanes[1]), starts, depth).select(F.col("seed.node").alias("seed"), "node.node", "node.lane")
    both = found.groupBy("seed", "node").agg(F.bool_or(F.col("lane") == 0).alias("a"), F.bool_or(F.col("lane") == 1).alias("b"))
    own = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node")).where("seed is not null").distinct()
    both = both.join(own.withColumn("own", F.lit(True)), ["seed", "node"], "full_outer")
    reason = F.when(F.col("own"), "CANDIDATE").when(F.col("a") & F.col("b"), "BOTH").when(F.col("a"), names[0]).otherwise(names[1])
    return both.select("seed", "node", reason.alias("reason"))


def mixed_slice(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", seed: str = "seed") -> DataFrame:
    """(seed, node): the seed and all that reaches it over edges of any kind."""
    own = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node")).where("seed is not null")
    return reach(edges, seeds, depth, src, dst, seed).select("seed", "node").union(own).distinct()


def scoped_effects(slice_: DataFrame, effects: DataFrame, home: DataFrame, node: str = "node", group: str = "program") -> DataFrame:
    """``effects`` (node, ...) of each seed with scope DIRECT at the seed,
    DEPENDENCY_SLICE elsewhere in its slice, and PROGRAM_CONTEXT in the rest
    of its group; ``home`` maps nodes to groups. approved is false for the last."""
    inside = slice_.join(effects, node).withColumn("scope", F.when(F.col(node) == F.col("seed"), "DIRECT").otherwise("DEPENDENCY_SLICE"))
    seeds = slice_.select("seed").distinct().join(home, F.col("seed") == home[node]).select("seed", group)
    around = seeds.join(home, group).select("seed", node).join(slice_.select("seed", node), ["seed", node], "left_anti").join(effects, node).withColumn("scope", F.lit("PROGRAM_CONTEXT"))
    return inside.unionByName(around).withColumn("approved", F.col("scope") != "PROGRAM_CONTEXT").distinct()


def collapse(sites: DataFrame, src: str, dst: str, site: str) -> DataFrame:
    """(src, dst, sites, recursive): one edge per pair with its sorted site ids."""
    sites = sites.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return sites.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.array_sort(F.collect_set(site)).alias("sites")).withColumn("recursive", F.col("src") == F.col("dst"))


def _inner(edges: DataFrame) -> DataFrame:
    """(node, before, after) of nodes with one edge in and one out."""
    ins = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.min("u").alias("before"))
    outs = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.min("v").alias("after"))
    return ins.join(outs, "node").where("n_in = 1 and n_out = 1").select("node", "before", "after")


def _path_ends(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, before, after) of ``inner`` with the first nodes outside of it on
    both sides, and (node, ring) of those on a ring without any, ring its
    greatest node. Pointers double, so a path of n nodes takes log2(n) rounds."""
    ids = inner.select(F.col("node").alias("n_"))
    seen = lambda df, side: df.join(ids, df[side] == F.col("n_"), "left").withColumn(f"open_{side}", F.col("n_").isNotNull()).drop("n_")
    now = stash(seen(seen(inner, "before"), "after").withColumn("ring", F.col("node")), "paths")
    for _ in range(max(1, inner.count().bit_length())):
        going = F.col("open_before") | F.col("open_after")
        if now.where(going).isEmpty():
            break
        back = now.select(F.col("node").alias("before"), F.col("before").alias("b_"), F.col("open_before").alias("ob_"))
        on = now.select(F.col("node").alias("after"), F.col("after").alias("a_"), F.col("open_after").alias("oa_"), F.col("ring").alias("r_"))
        moved = now.where(going).join(back, "before", "left").join(on, "after", "left")
        now = stash(now.where(~going).unionByName(moved.select(
            "node", F.coalesce("b_", "before").alias("before"), F.coalesce("a_", "after").alias("after"), F.coalesce("ob_", F.lit(False)).alias("open_before"), F.coalesce("oa_", F.lit(False)).alias("open_after"), F.greatest("ring", "r_").alias("ring"),
        )), "paths")
    return now.where("not open_before").select("node", "before", "after"), now.where("open_before").select("node", "ring")


#: Nodes on paths that are not worth folding: their paths are no longer than that.
FEW = 32
#: Nodes on the rim of a graph are taken off before it is coloured if they are one in so many.
MANY = 8


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of a directed graph; component is its largest member.

    Paths of nodes with one edge in and one out become one edge first, each
    time anew, so a long chain takes few rounds: what lies on a path is in the
    component of its ends if they share one, else alone. Then nodes without an
    edge in or out are components of their own, again and again while these
    are one in MANY at least. In what is left every node
    takes the largest node that reaches it as its colour; a node with its own
    colour is the root of a component, which is what leads back to the root
    within the colour. Those go and the rest starts again.
    """
    e = stash(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "edges")
    left = stash(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    e, done, folded = stash(e.where("u <> v"), "edges"), [], []
    while not left.isEmpty():
        inner, n = stash(_inner(e), "inner"), left.count()
        if inner.count() >= FEW:
            paths, rings = _path_ends(inner)
            done.append(rings.select("node", F.col("ring").alias("component")))
            folded.append(stash(paths, "folded"))
            left = stash(left.join(inner, "node", "left_anti"), "nodes")
            outer = e.join(inner, e["u"] == inner["node"], "left_anti")
            ends = folded[-1].select(F.col("node").alias("v"), F.col("after").alias("end"))
            e = stash(outer.join(ends, "v", "left").select("u", F.coalesce("end", "v").alias("v")).where("u <> v").distinct(), "edges")
        outs, ins = e.select(F.col("u").alias("node")).distinct(), e.select(F.col("v").alias("node")).distinct()
        core = stash(left.join(outs, "node", "left_semi").join(ins, "node", "left_semi"), "core")
        alone = left.join(core, "node", "left_anti")
        done.append(stash(alone.select("node", F.col("node").alias("component")), "alone"))
        within = lambda df, nodes: df.join(nodes, df["u"] == nodes["node"], "left_semi").join(nodes, df["v"] == nodes["node"], "left_semi")
        cut, left = stash(within(e, core), "edges"), core
        if MANY * done[-1].count() >= n:  # that may have opened new paths, and bared more such nodes
            e = cut
            continue
        colour = core.select("node", F.col("node").alias("colour"))
        while True:
            push = cut.join(colour, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "colour")
            new = stash(colour.union(push).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old")
            stop, colour = moved.isEmpty(), new
            if stop:
                break
        same = cut.join(colour.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v").where("cu = cv").select("u", "v")
        same = stash(same, "edges")
        found = front = stash(colour.where("node = colour"), "found")
        while not front.isEmpty():
            new = same.join(front, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "colour").distinct().join(found, "node", "left_anti")
            front = stash(new, "front")
            found = stash(found.union(front), "found")
        done.append(found.select("node", F.col("colour").alias("component")))
        left = stash(core.join(found, "node", "left_anti"), "nodes")
        e = stash(within(cut, left), "edges")
    if not done:
        return left.select("node", F.col("node").alias("component"))
    out = stash(reduce(DataFrame.union, done), "components")
    for paths in reversed(folded):
        ends = paths.join(out.select(F.col("node").alias("before"), F.col("component").alias("cb")), "before").join(out.select(F.col("node").alias("after"), F.col("component").alias("ca")), "after")
        out = stash(out.union(ends.select("node", F.when(F.col("cb") == F.col("ca"), F.col("cb")).otherwise(F.col("node")))), "components")
    if not folded:
        return out
    largest = out.groupBy("component").agg(F.max("node").alias("largest"))
    return out.join(largest, "component").select("node", F.col("largest").alias("component"))


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Components of two or more nodes as (component, members, edges), and the
    distinct edges as (src, dst, part_of_cycle). An edge is part of a cycle if
    both of its ends are in some such component, not always the same one."""
    comp = stash(strong_components(edges, src, dst), "components")
    big = comp.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).where("size(members) > 1")
    inside = comp.join(big.select("component"), "component", "left_semi")
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    a, b = inside.select(F.col("node").alias("src"), F.col("component").alias("ca")), inside.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    marked = e.join(a, "src", "left").join(b, "dst", "left")
    held = marked.where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    return big.join(held, "component"), marked.select("src", "dst", (F.col("ca").isNotNull() & F.col("cb").isNotNull()).alias("part_of_cycle"))


def levels(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", fold_every: int = 8) -> DataFrame:
    """(node, level): the longest path that leads to the node from one without
    an edge in; nodes on or behind a cycle have a null level.

    A round takes the nodes that nothing leads to any more and passes their
    levels on. At first, and every ``fold_every`` rounds, paths of nodes with
    one edge in and one out become one edge with their length, so chains take
    few rounds. A level on a path is the level where it begins plus the way,
    or what was passed to a node of the path plus the way from there if that
    is more; both come by pointer doubling.
    """
    e = stash(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct().withColumn("way", F.lit(1)), "edges")
    left = stash(nodes.select(F.col(node).alias("node")).distinct().withColumn("best", F.lit(0)), "nodes")
    done, folded, rounds = None, [], 0
    none = left.select("node").limit(0)
    circling = none
    while True:
        if rounds % fold_every == 0:
            inner = _inner(e).join(left, "node").select("node", F.col("before").alias("to"), "best")
            inner = stash(inner.join(e.select(F.col("v").alias("node"), "way"), "node"), "inner")
            if inner.count() >= FEW:
                begun, rings = _from_begin(inner)
                folded.append(stash(begun, "folded"))
                circling = circling.union(rings.select("node"))
                left = stash(left.join(inner, "node", "left_anti"), "nodes")
                last = folded[-1].select(F.col("node").alias("u"), F.col("to").alias("begin"), F.col("way").alias("before"), F.col("best").alias("passed"))
                tied = e.join(inner.select(F.col("node").alias("v")), "v", "left_anti").join(rings.select(F.col("node").alias("u")), "u", "left_anti").join(last, "u", "left")
                tied = stash(tied.select(F.coalesce("begin", "u").alias("u"), "v", (F.col("way") + F.coalesce("before", F.lit(0))).alias("way"), (F.col("passed") + F.col("way")).alias("passed")), "tied")
                left = _raised(left, tied.where("passed is not null").select(F.col("v").alias("node"), "passed"))
                # An edge of a path to its own begin is a cycle: it stays and holds its end up.
                e = stash(tied.groupBy("u", "v").agg(F.max("way").alias("way")), "edges")
        now = stash(left.join(e.select(F.col("v").alias("node")).distinct(), "node", "left_anti").select("node", F.col("best").alias("level")), "level")
        done = now if done is None else stash(done.union(now), "done")
        if now.isEmpty():
            break
        passed = e.join(now, e["u"] == now["node"]).select(F.col("v").alias("node"), (F.col("level") + F.col("way")).alias("passed"))
        left = _raised(left.join(now, "node", "left_anti"), passed)
        e = stash(e.join(now, e["u"] == now["node"], "left_anti"), "edges")
        rounds += 1
    out = done.union(left.select("node", F.lit(None).cast("int"))).union(circling.select("node", F.lit(None).cast("int")))
    for paths in reversed(folded):
        begin = out.select(F.col("node").alias("to"), "level")
        out = stash(out.union(paths.join(begin, "to", "left").select("node", F.when(F.col("level").isNotNull(), F.greatest(F.col("level") + F.col("way"), "best")))), "levels")
    return out


def _raised(left: DataFrame, passed: DataFrame) -> DataFrame:
    more = passed.groupBy("node").agg(F.max("passed").alias("passed"))
    return stash(left.join(more, "node", "left").select("node", F.greatest("best", F.coalesce("passed", F.lit(0))).alias("best")), "nodes")


def _from_begin(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, to, way, best) of ``inner``, whose ``to`` is the node before, with
    the first node outside of it instead, the way from there, and the most that
    was passed to the path up to the node plus the way; and the nodes of rings."""
    ids = inner.select(F.col("node").alias("n_"))
    now = stash(inner.join(ids, inner["to"] == F.col("n_"), "left").select("node", "to", "way", "best", F.col("n_").isNotNull().alias("open")), "paths")
    for _ in range(max(1, inner.count().bit_length())):
        if now.where("open").isEmpty():
            break
        back = now.select(F.col("node").alias("to"), F.col("to").alias("t_"), F.col("way").alias("w_"), F.col("best").alias("b_"), F.col("open").alias("o_"))
        moved = now.where("open").join(back, "to").select("node", F.col("t_").alias("to"), (F.col("way") + F.col("w_")).alias("way"), F.greatest(F.col("best"), F.col("b_") + F.col("way")).alias("best"), F.col("o_").alias("open"))
        now = stash(now.where("not open").unionByName(moved), "paths")
    return now.where("not open").drop("open"), now.where("open").select("node")


def ordered_calls(calls: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(group, node, position): topological order within each group, ties by
    name, nodes that a cycle holds up last by name. ``calls`` has a row with a
    null ``dst`` for a node without calls. A group is one package's graph."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf[src].dropna()) | set(pdf[dst].dropna()))
        after = {n: set() for n in names}
        for a, b in zip(pdf[src], pdf[dst], strict=True):
            if isinstance(a, str) and isinstance(b, str) and a != b:
                after[a].add(b)
        waits = {n: 0 for n in names}
        for bs in after.values():
            for b in bs:
                waits[b] += 1
        ready, out = [n for n in names if not waits[n]], []
        heapq.heapify(ready)
        while ready:
            out.append(heapq.heappop(ready))
            for b in after[out[-1]]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, b)
        out += [n for n in names if waits[n]]
        return pd.DataFrame({group: pdf[group].iloc[0], "node": out, "position": range(len(out))})

    kind = calls.schema[group].dataType.simpleString()
    return calls.select(group, src, dst).groupBy(group).applyInPandas(order, f"`{group}` {kind}, node string, position long")


def nearest_ancestor(tree: DataFrame, wanted: DataFrame, node: str = "node", parent: str = "parent", rounds: int = 64) -> DataFrame:
    """(node, ancestor, depth): the nearest of ``wanted`` (node) on the way up, the node itself included.

    Every node has one pointer, at first to its parent, which jumps over what
    its target has passed: steps double each round and stop at the first
    wanted node, so work is one row a node and round. Ways that end without
    one, or go round a cycle, give no row.
    """
    goal = wanted.select(F.col(node).alias("goal")).distinct()
    t = tree.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("to")).dropDuplicates(["node"])
    here = F.col("goal").isNotNull()
    t = t.join(goal, F.col("node") == F.col("goal"), "left").select("node", F.when(~here, F.col("to")).alias("to"), F.when(here, F.col("node")).alias("ancestor"), F.when(here, 0).otherwise(1).cast("long").alias("depth"))
    now = stash(t, "pointers")
    for _ in range(rounds):
        open_ = now.where("ancestor is null and to is not null")
        n = open_.count()
        if not n:
            break
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to_"), F.col("ancestor").alias("ancestor_"), F.col("depth").alias("depth_"))
        step = open_.join(ahead, "to", "left").select("node", F.col("to_").alias("to"), F.col("ancestor_").alias("ancestor"), (F.col("depth") + F.coalesce("depth_", F.lit(0))).alias("depth"))
        # A step of twice as many edges as there are nodes has gone round.
        step = step.withColumn("to", F.when(F.col("depth") <= 2 * F.lit(n), F.col("to")))
        now = stash(now.where("ancestor is not null or to is null").unionByName(step), "pointers")
    return now.where("ancestor is not null").select("node", "ancestor", "depth")


def pruned_descent(tree: DataFrame, roots: DataFrame, stop: Column, node: str = "node", parent: str = "parent", rounds: int = 1000) -> DataFrame:
    """(root, node, depth) below each root; a node for which ``stop`` holds is
    left out with all below it."""
    t = stash(tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(stop, F.lit(False)).alias("stop")), "tree")
    front, found = roots.select(F.col(node).alias("root"), F.col(node).alias("at")), None
    for d in range(1, rounds + 1):
        new = front.join(t, F.col("at") == F.col("parent")).where("not stop").select("root", "node", F.lit(d).alias("depth"))
        new = stash(new if found is None else new.join(found, ["root", "node"], "left_anti"), "front")
        found = new if found is None else found.union(new)
        if new.isEmpty():
            return found
        front = new.select("root", F.col("node").alias("at"))
    raise RuntimeError(f"descent did not end in {rounds} rounds")


def subtree_has(tree: DataFrame, flag: Column, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, found): whether ``flag`` holds for the node or anything below it.

    Nodes are numbered by a tour; the running number of marked nodes, in order
    of entering, is looked up where a node is entered and left. Nodes of a
    cyclic part are not numbered: their marks go up a level a round.
    """
    t = stash(tree.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"), F.max(F.coalesce(flag, F.lit(False))).alias("flag")), "tree")
    numbers = stash(tour(t), "tour")
    marks = numbers.join(t.where("flag").select("node"), "node", "left_semi")
    places = numbers.select("root", F.col("enter").alias("at"), F.lit(0).alias("mark"), "node", F.lit(True).alias("enters"))
    places = places.unionByName(numbers.select("root", F.col("leave").alias("at"), F.lit(0).alias("mark"), "node", F.lit(False).alias("enters")))
    places = places.unionByName(marks.select("root", F.col("enter").alias("at"), F.lit(1).alias("mark"), F.lit(None).cast(t.schema["node"].dataType).alias("node"), F.lit(True).alias("enters")))
    counted = running(places, ["root", "at", "mark"], "mark", "marks").where("node is not null")
    found = counted.groupBy("node").agg((F.max(F.when(~F.col("enters"), F.col("before"))) > F.max(F.when(F.col("enters"), F.col("before")))).alias("found"))
    found = stash(found, "found")
    rest = stash(t.join(found, "node", "left_anti"), "cyclic")
    marked = front = stash(rest.where("flag").select("node"), "marked")
    while not front.isEmpty():
        up = rest.join(front, "node", "left_semi").select(F.col("parent").alias("node")).where("node is not null").distinct()
        front = stash(up.join(rest, "node", "left_semi").join(marked, "node", "left_anti"), "marked")
        marked = marked.union(front)
    others = rest.select("node").join(marked.withColumn("found", F.lit(True)), "node", "left").select("node", F.coalesce("found", F.lit(False)).alias("found"))
    return found.unionByName(others)


def drift(expected: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): MISSING in what was loaded, EXTRA beyond what was expected."""
    missing = expected.select(*keys).exceptAll(loaded.select(*keys)).withColumn("side", F.lit("MISSING"))
    return missing.union(loaded.select(*keys).exceptAll(expected.select(*keys)).withColumn("side", F.lit("EXTRA")))


def grouped_consistency(members: DataFrame, edges: DataFrame, node: str, values: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, members, consistent): members joined by edges between
    members; consistent if each of ``values`` has one value, null being one."""
    from strandgraph.operators.components import connected_components

    ids = members.select(F.col(node).alias("n_")).distinct()
    e = edges.join(ids, F.col(src) == F.col("n_"), "left_semi").join(ids, F.col(dst) == F.col("n_"), "left_semi")
    comp = connected_components(e, src, dst)
    out = members.join(comp, F.col(node) == comp["node"], "left").withColumn("component", F.coalesce(F.col("component"), F.col(node)))
    one = [(F.count_distinct(F.struct(F.col(v).isNull(), F.coalesce(F.col(v).cast("string"), F.lit("")))) == 1) for v in values]
    same = one[0]
    for c in one[1:]:
        same = same & c
    return out.groupBy("component").agg(F.array_sort(F.collect_set(node)).alias("members"), same.alias("consistent"))


def leads_to(start: DataFrame, hops: list[tuple[DataFrame, str, str]], goal: DataFrame, last: str, goal_key: str) -> DataFrame:
    """``start`` rows from which the hops (table, left key, right key) lead to a
    ``goal``. Semi joins from the goal back, so no path multiplies rows."""
    held, key = goal, goal_key
    for i in range(len(hops) - 1, -1, -1):
        table, left, right = hops[i]
        ends = held.select(F.col(key).alias("k_")).distinct()
        held, key = table.join(ends, F.col(last) == F.col("k_"), "left_semi"), right
        last = left
    ends = held.select(F.col(key).alias("k_")).distinct()
    return start.join(ends, F.col(last) == F.col("k_"), "left_semi")


def under(pairs: DataFrame, tree: DataFrame, node: str = "node", above: str = "above", parent: str = "parent") -> DataFrame:
    """``pairs`` with ``under``: whether ``above`` is the node itself or on its way up.

    Nodes are numbered by a tour, so a pair is one comparison of ranges. Pairs
    with a node that a cycle leaves without numbers walk up a step a round and
    leave when they meet, when the way ends, or when it comes back.
    """
    t = stash(tree.select(F.col(node).alias("at"), F.col(parent).alias("up")).where("at is not null").groupBy("at").agg(F.min("up").alias("up")), "tree")
    numbers = stash(tour(t, "at", "up"), "tour")
    low = numbers.select(F.col("node").alias("n_"), F.col("root").alias("r_"), F.col("enter").alias("in_"))
    high = numbers.select(F.col("node").alias("a_"), F.col("root").alias("ar_"), F.col("enter").alias("from_"), F.col("leave").alias("to_"))
    out = pairs.join(low, F.col(node) == F.col("n_"), "left").join(high, F.col(above) == F.col("a_"), "left")
    inside = (F.col("r_") == F.col("ar_")) & F.col("in_").between(F.col("from_"), F.col("to_"))
    same = F.col(node) == F.col(above)
    out = out.withColumn("under", F.coalesce(inside | same, F.lit(False)))
    circling = stash(t.join(numbers, t["at"] == numbers["node"], "left_anti"), "cyclic")
    if circling.isEmpty():
        return out.select(*[pairs[c] for c in pairs.columns], "under")
    steps = circling.where("up is not null")
    front = stash(pairs.select(F.col(node).alias("n_"), F.col(above).alias("a_")).where("n_ is not null and a_ is not null").distinct().join(circling.select(F.col("at").alias("n_")), "n_", "left_semi").withColumn("at", F.col("n_")), "front")
    seen, met = front, None
    while not front.isEmpty():
        hit = front.where("at = a_").select("n_", "a_")
        met = hit if met is None else met.union(hit)
        new = front.where("at <> a_").join(steps, "at").select("n_", "a_", F.col("up").alias("at")).distinct()
        front = stash(new.join(seen, ["n_", "a_", "at"], "left_anti"), "front")
        seen = seen.union(front)
    out = out.select(*[pairs[c] for c in pairs.columns], "under")
    if met is None:
        return out
    met = met.distinct().withColumn("met_", F.lit(True))
    out = out.join(met, (F.col(node) == F.col("n_")) & (F.col(above) == F.col("a_")), "left")
    return out.select(*pairs.columns, (F.col("under") | F.coalesce("met_", F.lit(False))).alias("under"))


def generations(rows: DataFrame, group: str, newest_first: list[Column], confirmed: Column, fallback: Column) -> DataFrame:
    """``rows`` with their generation: ORPHAN if not confirmed, else ACTIVE for
    the newest, PREVIOUS for the next, then FALLBACK where one may be, else HISTORICAL."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*newest_first))
    g = F.when(~confirmed, "ORPHAN").when(F.col("place_") == 1, "ACTIVE").when(F.col("place_") == 2, "PREVIOUS").when(fallback, "FALLBACK").otherwise("HISTORICAL")
    return rows.withColumn("place_", place).withColumn("generation", g).drop("place_")
