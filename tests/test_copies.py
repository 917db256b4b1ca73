"""What only larger or otherwise ordered tables show: results against SQL, and work that must not grow with groups."""

import time
from datetime import datetime

import duckdb
from compare import rows
from pyspark.sql import functions as F

from strandgraph.operators import candidates as X
from strandgraph.operators import context as K
from strandgraph.operators import graph as G
from strandgraph.operators import lists as L
from strandgraph.plans import all_queries, all_sql, dataflow, files
from strandgraph.store import stash_dealt


def against_sql(spark, folder, name, **tables):
    """The query's rows over ``tables`` and those of its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(all_queries()[name](spark, str(folder)).toPandas()), rows(con.sql(all_sql()[name]).df())


def test_many_accesses_that_ask_the_same(spark):
    """Ten thousand accesses of four thousand entries: the entries are compared once, not for each access."""
    entries = spark.range(4000).select(F.lit("t").alias("tab"), F.col("id").alias("entry"), F.create_map(F.lit("A"), (F.col("id") % 2000).cast("string")).alias("row"))
    accesses = spark.range(10_000).select("id", F.lit("t").alias("tab"), F.lit("A = 7").alias("predicate"))
    began = time.perf_counter()
    got = K.split_by_predicate(accesses, entries, "tab", "predicate", "row", "entry", "id").groupBy("status", "applicable", "context").count().collect()
    assert [tuple(r) for r in got] == [("EXACT", [7, 2007], [], 10_000)] and time.perf_counter() - began < 60


def test_accesses_of_one_id_without_table_or_predicate(spark):
    entries = spark.createDataFrame([("t", 2, {"A": "1"}), ("t", 1, {"A": "2"}), ("t", None, {"A": "1"}), (None, 3, {"A": "1"})], "tab string, entry int, row map<string, string>")
    asked = [(1, "t", "A = 1"), (1, "t", "A = 1"), (2, "t", "A = 1 and B > :X"), (3, "t", None), (4, None, "A = 1"), (5, "u", None)]
    got = {r.id: (r.status, r.applicable, r.context) for r in K.split_by_predicate(spark.createDataFrame(asked, "id int, tab string, predicate string"), entries, "tab", "predicate", "row", "entry", "id").collect()}
    assert got == {1: ("EXACT", [2, 2], []), 2: ("PARTIAL", [], [2]), 3: ("UNRESOLVED", [], [1, 2]), 4: ("EXACT", [], []), 5: ("UNRESOLVED", [], [])}


def test_ids_out_of_order_after_a_hundredth(spark, tmp_path):
    """the row before keeps its own id, also where that is a hundredth; a null time comes last."""
    at = lambda n: None if n is None else datetime(2024, 1, n)
    e = [(300, at(1), 1), (250, at(2), 1), (700, at(3), 1), (400, at(4), 1), (401, at(5), 1), (50, None, 1), (-5, at(1), 2), (-100, at(2), 2), (-7, at(3), 2)]
    got, want = against_sql(spark, tmp_path, "i09_out_of_order", events=spark.createDataFrame(e, "event_id long, ts timestamp, user_id long"))
    assert got == want and ("300", "250", "1") in got


def test_numbers_that_only_a_date_or_name_holds(spark, tmp_path):
    """24 and 2024 stand in the cited date, 7 in the cited code or table's name, but not as numbers."""
    docs = [(i, "source7", n) for i, n in enumerate([24, 7, 7, 24, 1, 2024, 20, 5, 0, None, 20, 1, 1])]
    got, want = against_sql(spark, tmp_path, "x38_claim_violations", documents=spark.createDataFrame(docs, "doc_id long, source string, n_chars long"))
    assert got == want


def test_conflicts_by_a_condition(spark):
    """the same relations as from a table of conflicts, without that table."""
    refs = spark.range(60).select("id", (F.col("id") % 2).alias("s"), (F.col("id") % 3).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("l"))
    hit = (F.col("a") + F.col("b")) % 7 == 0
    table = refs.select(F.col("id").alias("a")).crossJoin(refs.select(F.col("id").alias("b"))).where("a < b").where(hit)
    one, other = (X.relations(refs, "s", "id", "t", "l", c) for c in (hit, table))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and {r.relation for r in one.collect()} == {"CONFLICT", "EXACT_MATCH", "RELATED"}
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_loops_broadcast_no_tables(spark):
    """F5 to F7: what rounds of joins read back is dealt, however small it is."""
    tree = spark.range(200).select(F.col("id").alias("node"), F.expr("case when id > 0 then (id - 1) div 3 end").alias("parent"), "id")
    found = G.subtree_has(tree, F.col("id") == 199)
    assert {r.node for r in found.where("found").collect()} == {199, 66, 21, 6, 1, 0}
    a = stash_dealt(spark.range(10), "a")
    plan = a.join(stash_dealt(spark.range(5), "b").groupBy("id").count(), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert all(m.stash is stash_dealt for m in (G, L))


def test_versions_join_lines_once(spark, tmp_path, monkeypatch):
    """both versions are read from one join of the lines, so what is published has none."""
    publish, plans = files.R.publish, []

    def seen(session, tables, *args, **kwargs):
        plans.append(tables["lines"]._jdf.queryExecution().optimizedPlan().toString())
        return publish(session, tables, *args, **kwargs)

    monkeypatch.setattr(files.R, "publish", seen)
    orders = spark.createDataFrame([(1, "O"), (2, "F"), (3, "P"), (4, "F"), (4, "O")], "o_orderkey long, o_orderstatus string")
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1)], "l_orderkey long, l_linenumber int")
    for table, df in {"orders": orders, "lineitem": lines}.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    got = all_queries()["k02_versions"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("reader after", "F", 2, 2), ("reader between", "O", 2, 3)]
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_calls_are_read_once(spark, monkeypatch):
    """F8, F11: statements and effects come from statements that were written, not from two readings of the lines."""
    given, whole = [], dataflow.N.propagate

    def seen(statements, effects, items=None):
        given.extend((statements, effects))
        return whole(statements, effects, items)

    monkeypatch.setattr(dataflow.N, "propagate", seen)
    for name in ("e08_calls", "e09_barriers"):
        all_queries()[name](spark, "/root/testdata/sf0.001")
    assert len(given) == 4 and not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in given)


def test_branches_shuffle_lines_once(spark, tmp_path, monkeypatch):
    """lines are shuffled by order once, and their moves once; no lines of a null order but the first."""
    lines = [(k, n, 1, 1, float(10 * n + (k or 0)), "R" if n % 3 else "A") for k, m in ((1, 1), (2, 2), (3, 3), (4, 6), (5, 9), (None, 5)) for n in range(1, m + 1)]
    shuffles, write = [], dataflow.N.stash

    def seen(df, name="table"):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, name)

    monkeypatch.setattr(dataflow.N, "stash", seen)
    got, want = against_sql(spark, tmp_path, "e07_branching", lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"))
    assert got == want and len(got) > 15
    # Lines, branches, decisions that cannot be told, moves: joins of small tables are broadcast.
    assert sum(shuffles) == 4 and shuffles[0] == shuffles[-1] == 1
