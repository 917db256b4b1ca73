"""Small cases with hand-derived results; names refer to section D of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import aggregates as A
from strandgraph.operators import candidates as X
from strandgraph.operators import effects as E
from strandgraph.operators import graph as G
from strandgraph.operators import joins as J
from strandgraph.operators import propagation as N
from strandgraph.operators import resolve as R

EDGE = "src string, dst string"


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], EDGE)


def test_lanes_and_mixed_slices(spark):
    """D1, D2."""
    seed = spark.createDataFrame([("S",)], "seed string")
    data, control = edges(spark, "AB"), edges(spark, "BS")
    assert {(r.node, r.reason) for r in G.two_lane_slice(data, control, seed, 4).collect()} == {("S", "CANDIDATE"), ("B", "CONTROL_DEPENDENCY")}
    both = data.union(control)
    assert {r.node for r in G.mixed_slice(both, seed, 4).collect()} == {"S", "B", "A"}
    assert {r.node for r in G.mixed_slice(both, seed, 1).collect()} == {"S", "B"}


def test_both_lanes_and_a_loop_through_the_seed(spark):
    """D3, D4."""
    seed = spark.createDataFrame([("S",)], "seed string")
    got = G.two_lane_slice(edges(spark, "AS SA"), edges(spark, "AS"), seed, 4)
    assert sorted((r.node, r.reason) for r in got.collect()) == [("A", "BOTH"), ("S", "CANDIDATE")]


def test_depth_limit(spark):
    """D5."""
    got = G.reach(edges(spark, "54 43 32 21 1S"), spark.createDataFrame([("S",)], "seed string"), 4)
    assert {(r.node, r.depth) for r in got.collect()} == {("1", 1), ("2", 2), ("3", 3), ("4", 4)}


def test_cycles(spark):
    """D11, D12."""
    comps, marked = G.cycles(edges(spark, "AB BC CA AD DD"))
    assert [(r.members, len(r.edges)) for r in comps.collect()] == [(["A", "B", "C"], 3)]
    flags = {(r.src, r.dst): r.part_of_cycle for r in marked.collect()}
    assert not flags["A", "D"] and not flags["D", "D"] and flags["A", "B"]
    comps, marked = G.cycles(edges(spark, "AB BA CD DC AC"))
    assert comps.count() == 2 and {(r.src, r.dst): r.part_of_cycle for r in marked.collect()}["A", "C"]


def test_order_of_calls(spark):
    """D13, and a cycle that comes last."""
    calls = spark.createDataFrame([("g", "A", "B"), ("g", "C", None), ("h", "X", "Y"), ("h", "Y", "X"), ("h", "Z", "X")], "grp string, src string, dst string")
    got = sorted((r.grp, r.position, r.node) for r in G.ordered_calls(calls, "grp").collect())
    assert [n for g, _, n in got if g == "g"] == ["A", "B", "C"] and [n for g, _, n in got if g == "h"] == ["Z", "X", "Y"]


def test_groups_of_members(spark):
    """D14, D15."""
    members = spark.createDataFrame([("r1", "X"), ("r2", None), ("r3", "X"), ("r4", "Y")], "id string, target string")
    pairs = spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r4", "v1")], EDGE)
    got = {tuple(r.members): r.consistent for r in G.grouped_consistency(members, pairs, "id", ["target"]).collect()}
    assert got == {("r1", "r2", "r3"): False, ("r4",): True}


@pytest.mark.parametrize(("rows", "proof"), [("S", "PROVEN"), ("SC", "AMBIGUOUS"), ("B", "AMBIGUOUS"), ("M", "NOT_AVAILABLE"), ("SM", "PROVEN")])
def test_barriers(spark, rows, proof):
    """D16 to D18: S a statement of SQL, C a call, B both, M a move; D the decision."""
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(rows + "D")], "scope int, pos int, k string")
    k = F.col("k")
    got = J.latest_unless_barred(df, k.isin("S", "B"), k.isin("C", "B"), F.col("pos"), ["scope"], ["pos"])
    assert got.where("k = 'D'").first().proof == proof


def test_latest_fact_wins_though_null(spark):
    """D19."""
    df = spark.createDataFrame([(1, 1, "A", True), (1, 3, None, True), (1, 5, None, False)], "s int, pos int, v string, fact boolean")
    assert J.latest_before(df, F.col("fact"), F.col("v"), ["s"], ["pos"]).where("pos = 5").first().latest is None


def statements(spark, rows):
    schema = "program string, paragraph string, statement_id string, pos int, kind string, parent_id string, branch_kind string, branch_condition string, targets array<string>, sources array<string>, literals array<string>, condition_target string, condition_value boolean"
    full = [("P", "G", i, n, k, parent, branch, None, t, s, lit, None, None) for n, (i, k, parent, branch, t, s, lit) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def follow(spark, rows):
    s = statements(spark, rows)
    return [(r.statement_id, r.status, r.literal, r.steps) for r in N.branching_constants(s, E.statement_effects(s)).orderBy("ordinal").collect()]


def test_copies_and_branches(spark):
    """D20, D21."""
    assert follow(spark, [("1", "MOVE", None, None, ["X"], [], ["A"]), ("2", "MOVE", None, None, ["Y"], ["X"], [])]) == [("1", "DIRECT", "A", 1), ("2", "PROPAGATED", "A", 2)]
    rows = [("1", "MOVE", None, None, ["X"], [], ["A"]), ("2", "IF", None, None, [], [], []), ("3", "MOVE", "2", "THEN", ["X"], [], ["B"]), ("4", "MOVE", "2", "ELSE", ["X"], [], ["B"]), ("5", "MOVE", None, None, ["Y"], ["X"], [])]
    assert follow(spark, rows) == [("1", "DIRECT", "A", 1), ("3", "DIRECT", "B", 1), ("4", "DIRECT", "B", 1), ("5", "UNRESOLVED_COPY", None, 0)]


def test_names(spark):
    """D22, D23."""
    index = spark.createDataFrame([("P.X", "X", "1"), ("Q.X", "X", "2"), ("K", "Y", "3"), ("K", "K", "4")], "q string, s string, t string")
    tokens = spark.createDataFrame([("P.X",), ("X",), ("Z",), ("K",), (" y",), (None,)], "token string")
    got = {r.token: r.resolution for r in R.resolve_names(tokens, index, "token", [], "q", "s", "t").collect()}
    assert got == {"P.X": "QUALIFIED", "X": "AMBIGUOUS", "Z": "UNRESOLVED", "K": "AMBIGUOUS", " y": "SIMPLE", None: "UNRESOLVED"}


def test_lattice(spark):
    """D26."""
    rows = [([], "UNRESOLVED"), (["EXACT"], "EXACT"), (["UNRESOLVED"], "UNRESOLVED"), (["EXACT", "UNRESOLVED"], "PARTIAL")]
    df = spark.createDataFrame(rows, "s array<string>, want string")
    assert df.where(A.applicability(F.col("s")) != F.col("want")).count() == 0


def test_scores(spark):
    """D28."""
    df = spark.createDataFrame([(15, 0, 0), (0, 0, 0), (0, 1, 1)], "tp int, fp int, fn int")
    assert [tuple(r) for r in df.select(*A.scores(F.col("tp"), F.col("fp"), F.col("fn"))).collect()] == [(1, 1, 1), (None, None, None), (0, 0, 0)]


def test_literal_conflicts(spark):
    """D29."""
    rows = [("d1", "t1", "1", "a"), ("d1", "t1", "2", "b"), ("d2", "t1", "1", "c"), ("d2", "t1", "", "d"), ("d3", "t1", "1", "e"), ("d3", "t2", "2", "f")]
    got = A.value_conflicts(spark.createDataFrame(rows, "d string, t string, v string, id string"), [["d", "t"]], "v", "id").collect()
    assert [r["values"] for r in got] == [["1", "2"]]


def test_absorbed_pairs(spark):
    """D30."""
    rows = [("k", "e", "L", "1"), ("k", "e", "R", "2"), ("k", "e", "R", "3"), ("k", "f", "R", "4")]
    got = X.corroborate(spark.createDataFrame(rows, "k string, e string, f string, id string"), ["k", "e"], "f", "L", "R", "id")
    assert sorted(r.id for r in got.collect()) == ["1", "3", "4"]


def test_entry_facts(spark):
    """D32, D36."""
    rows = [("a", "known", "A"), ("b", "known", "A"), ("a", "two", "A"), ("b", "two", "B"), ("c", "two", "A"), ("a", "veto", "A"), ("b", "veto", None)]
    b = spark.createDataFrame([(caller, callee, "F", lit, None) for caller, callee, lit in rows], "caller string, callee string, formal string, literal string, via string")
    levels = spark.createDataFrame([("known", 1), ("two", 1), ("veto", 1)], "node string, level int")
    got = {r.program: (r.literal, r.conflicted) for r in E.entry_facts(b, levels).collect()}
    assert got == {"known": ("A", False), "two": (None, True), "veto": ("A", False)}


def test_exit_facts(spark):
    """D37."""
    df = spark.createDataFrame([("F", 1, "A"), ("F", 2, "B")], "f string, n int, v string")
    assert [r.status for r in E.exit_facts(df, ["f"], ["n"], "v").orderBy("n").collect()] == ["PROPAGATED", "INVALIDATED"]


def test_arguments(spark):
    """D38."""
    place = "call string, n int"
    a = spark.createDataFrame([("x", i) for i in range(3)] + [("y", 0)] + [("z", i) for i in range(3)], place)
    f = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("y", 1)], place)
    got = J.ordinal_zip(a, f, ["call"], "n", spark.createDataFrame([("x",), ("y",)], "call string")).groupBy("call", "binding").count().collect()
    assert {(r.call, r.binding): r["count"] for r in got} == {("x", "BOUND"): 2, ("x", "EXTRA_ACTUAL"): 1, ("y", "BOUND"): 1, ("y", "MISSING_ACTUAL"): 1, ("z", "FORMAL_UNRESOLVED"): 3}


def test_settled_keys(spark):
    """D39."""
    rows = [("L1", "n1"), ("L2", "n2"), ("L2", "n2"), ("L3", "n3"), ("L3", "n4"), ("L4", "n5")]
    got = X.settled_keys(spark.createDataFrame(rows, "old string, new string"), "old", "new", spark.createDataFrame([("n5",)], "new string"))
    assert sorted(r.key for r in got.collect()) == ["L1", "L2", "L2", "n3", "n4", "n5"]
