"""Linked lists, tours and contracted paths against plain walks."""

import random

import pytest

from strandgraph.operators import graph as G
from strandgraph.operators import lists as L
from strandgraph.operators import prefix

EVENT = "run string, id string, previous string, seq int, becomes string"


def status(spark, events, pointers):
    e = spark.createDataFrame(events, EVENT)
    p = spark.createDataFrame(pointers, "run string, head string, active string")
    return {r.run: (r.status, r.length, r.stopped_at, r.issues) for r in L.chain_status(p, e, "run", "head", "id", "previous", "seq", "active", "becomes").collect()}


def test_chains_from_their_pointers(spark):
    cases = {
        "whole": ([("1", None, 1, "a"), ("2", "1", 2, "b"), ("3", "2", 3, "c")], ("3", "c"), ("VALID", 3, None, [])),
        "orphan": ([("1", None, 1, "a"), ("3", "1", 2, "c"), ("2", "1", 2, "x")], ("3", "c"), ("VALID", 2, None, [])),
        "orphan links into the chain": ([("1", None, 1, "a"), ("3", "1", 2, "c"), ("2", "3", 9, "x")], ("3", "c"), ("VALID", 2, None, [])),
        "cycle": ([("1", "3", 1, "a"), ("2", "1", 2, "b"), ("3", "2", 3, "c")], ("3", "c"), ("CYCLIC", 3, "3", ["EVENT_CHAIN_CYCLE"])),
        "cycle behind a tail": ([("1", "2", 1, "a"), ("2", "1", 2, "b"), ("3", "2", 3, "c")], ("3", "c"), ("CYCLIC", 3, "2", ["EVENT_CHAIN_CYCLE"])),
        "cycle of orphans": ([("1", None, 1, "a"), ("8", "9", 1, "b"), ("9", "8", 2, "c")], ("1", "a"), ("VALID", 1, None, [])),
        "broken": ([("2", "1", 2, "b"), ("3", "2", 3, "c")], ("3", "c"), ("BROKEN", 2, "1", ["EVENT_CHAIN_BROKEN"])),
        "head missing": ([("1", None, 1, "a")], ("7", "a"), ("BROKEN", 0, "7", ["EVENT_CHAIN_BROKEN"])),
        "no pointer value": ([("1", None, 1, "a")], (None, "a"), ("EMPTY", 0, None, ["EVENT_CHAIN_EMPTY"])),
        "number skipped": ([("1", None, 1, "a"), ("3", "1", 3, "c")], ("3", "c"), ("BROKEN", 2, None, ["EVENT_SEQUENCE_INVALID"])),
        "begins at two": ([("1", None, 2, "a"), ("3", "1", 3, "c")], ("3", "c"), ("BROKEN", 2, None, ["EVENT_CHAIN_BROKEN"])),
        "other generation": ([("1", None, 1, "a")], ("1", "z"), ("BROKEN", 1, None, ["EVENT_POINTER_MISMATCH"])),
        "event of another run": ([("5", "whole-1", 2, "a")], ("5", "a"), ("BROKEN", 1, "whole-1", ["EVENT_CHAIN_BROKEN"])),
        "links to itself": ([("1", "1", 1, "a")], ("1", "a"), ("CYCLIC", 1, "1", ["EVENT_CHAIN_CYCLE"])),
    }
    events = [(run, *e) for run, (es, _, _) in cases.items() for e in es] + [("whole", "whole-1", None, 1, "a")]
    got = status(spark, events, [(run, *p) for run, (_, p, _) in cases.items()])
    assert got == {run: want for run, (_, _, want) in cases.items()}
    assert status(spark, [], []) == {}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = L.stash
    monkeypatch.setattr(L, "stash", lambda df, name: rounds.append(name) or real(df, name))
    n = 100_000
    links = spark.range(n).selectExpr("'r' as run", "id as node", "case when id > 0 then id - 1 end as following")
    got = L.walk_from(spark.createDataFrame([("r", n - 1)], "run string, node long"), links, ["run"])
    row = got.selectExpr("count(*) as n", "max(rank) as m", "bool_and(node + rank = 99999) as right").first()
    assert (row.n, row.m, row.right) == (n, n - 1, True)
    assert rounds.count("jumps") <= 19


def forest(rng, n, cyclic=False):
    parents = {i: rng.choice([None, *range(max(0, i - 4), i), 0]) if i else None for i in range(n)}
    if cyclic:
        parents[n // 2] = n - 1  # may close a cycle
        parents.update({n: n + 1, n + 1: n, n + 2: n, n + 3: 999_999})
    return parents


def up(parents, i):
    way = []
    while i in parents and i not in way:
        way.append(i)
        i = parents[i]
    return way


@pytest.mark.parametrize("cyclic", [False, True])
def test_tours_and_what_they_answer(spark, cyclic):
    rng = random.Random(9)
    parents = forest(rng, 60, cyclic)
    flags = {i for i in parents if rng.random() < 0.1}
    tree = spark.createDataFrame([(i, p, i in flags) for i, p in parents.items()], "node long, parent long, flag boolean")
    ends = lambda i: parents.get(up(parents, i)[-1])
    whole = {i for i in parents if ends(i) not in up(parents, i)}
    numbers = {r.node: r for r in L.tour(tree).collect()}
    assert set(numbers) == whole
    for i in whole:
        assert numbers[i].depth == len(up(parents, i)) - 1 and numbers[i].root == up(parents, i)[-1]
        for j in whole:
            a, b = numbers[i], numbers[j]
            assert (a.root == b.root and b.enter <= a.enter <= b.leave) == (j in up(parents, i))
    got = {r.node: r.found for r in G.subtree_has(tree, tree.flag).collect()}
    assert got == {i: any(i in up(parents, j) for j in flags) for i in parents}
    pairs = [(i, j) for i in [*parents, 777_777, None] for j in (rng.choice(list(parents)), i, 999_999, None)]
    df = spark.createDataFrame(pairs, "node long, above long")
    want = {(i, j): i is not None and j is not None and (i == j or j in up(parents, i)) for i, j in pairs}
    assert {(r.node, r.above): r.under for r in G.under(df, tree).collect()} == want


def test_many_children_of_one_parent(spark):
    tree = spark.range(1, 5001).selectExpr("id as node", "case when id > 1 then 1 end as parent")
    got = L.tour(tree).selectExpr("count(*) as n", "count(distinct enter) as d", "max(depth) as m").first()
    assert tuple(got) == (5000, 5000, 1)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 30), rng.randint(0, 5)) for _ in range(500)]
    got = prefix.running(spark.createDataFrame(rows, "k int, n int"), ["k"], "n", "sums").collect()
    assert sorted((r.k, r.n, r.before) for r in got) == sorted((k, n, sum(m for j, m in rows if j < k)) for k, n in rows)


def components(edges):
    reach = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    return {n: max(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def longest(edges, nodes):
    edges, level, left = {e for e in edges if e[0] != e[1]}, {}, set(nodes)
    while ready := {n for n in left if not any(b == n and a in left for a, b in edges)}:
        level |= {n: max([level[a] + 1 for a, b in edges if b == n], default=0) for n in ready}
        left -= ready
    return level | dict.fromkeys(left)


def some_graphs():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    yield "chain", chain
    yield "ring", [*chain, (40, 0)]
    yield "ring with a tail and a chord", [*chain, (40, 0), (100, 3), (20, 101), (101, 102), (102, 20), (7, 30)]
    yield "two ways", [*chain, (0, 50), (50, 51), (51, 40), (40, 41), (60, 10), (61, 60), (5, 61)]
    yield "caterpillar", [*chain, *[(200 + i, i) for i in range(0, 40, 2)], *[(i, 300 + i) for i in range(0, 40, 3)]]
    yield "loops", [(1, 1), (1, 2), (2, 2), (3, 3)]
    for k in range(2):
        yield f"random {k}", [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.choice([20, 30, 40]))]
    yield "acyclic", [(a, b) for a, b in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)) if a < b]


@pytest.mark.parametrize(("name", "edges"), list(some_graphs()))
def test_components_and_levels(spark, name, edges, monkeypatch):
    monkeypatch.setattr(G, "FEW", 1)
    e = spark.createDataFrame(edges, "src int, dst int")
    got = {r.node: r.component for r in G.strong_components(e).collect()}
    assert got == components(edges)
    nodes = {x for p in edges for x in p} | {999}
    levels = G.levels(e, spark.createDataFrame([(n,) for n in nodes], "node int"), fold_every=2).collect()
    assert len(levels) == len(nodes) and {r.node: r.level for r in levels} == longest(edges, nodes)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = G.stash
    monkeypatch.setattr(G, "stash", lambda df, name: rounds.append(name) or real(df, name))
    n = 100_000
    e = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    assert G.strong_components(e).selectExpr("count(*) as n", "bool_and(node = component) as own").first()[:] == (n + 1, True)
    assert rounds.count("paths") + rounds.count("core") < 40
    rounds.clear()
    levels = G.levels(e, spark.range(n + 1).selectExpr("id as node"))
    assert levels.selectExpr("count(*) as n", "bool_and(node = level) as own").first()[:] == (n + 1, True)
    assert rounds.count("paths") + rounds.count("level") < 40
