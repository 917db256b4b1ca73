"""Package sources and sinks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strandgraph.sources import packages as P
from strandgraph.sources import sinks as K


def test_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.CBL").write_bytes(b"MOVE A TO B")
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfA,B")
    (tmp_path / "z.bin").write_bytes(b"\xff\xfe")
    got = {r.name: (r.kind, r.size, r.encoding) for r in P.inventory(spark, str(tmp_path)).collect()}
    assert got == {"X.CBL": ("COBOL", 11, "UTF-8"), "t.csv": ("CSV", 6, "UTF-8-SIG"), "z.bin": (None, 2, None)}


def test_entry_problems(spark):
    rows = [("a/B.cbl", 10, 5), ("a/b.CBL", 10, 5), ("../x", 1, 1), ("bomb", 100_000, 10), ("ok", 1, 0)]
    got = P.entry_problems(spark.createDataFrame(rows, "name string, size long, packed long"), max_entries=4)
    assert sorted((r.code, r.entry) for r in got.collect() if r.entry) == [("COMPRESSION_RATIO", "bomb"), ("NAME_COLLISION", "a/B.cbl"), ("UNSAFE_PATH", "../x")]
    assert [r.code for r in got.where("entry is null").collect()] == ["TOO_MANY_ENTRIES"]


def test_missing_paths(spark):
    declared = spark.createDataFrame([("a",), ("b",), (None,)], "path string")
    assert {r.path for r in P.missing_paths(declared, spark.createDataFrame([("a",)], "name string")).collect()} == {"b", None}


def test_snapshot_rows(spark):
    lines = [("p", 1, "A,B"), ("p", 2, "1"), ("p", 3, "1,2,3"), ("d", 1, "a, A"), ("d", 2, "1,2"), ("q", 1, 'A,"B,C"'), ("q", 2, '" x ","say ""y"""'), ("e", 1, "A")]
    rows, status = P.snapshot_rows(spark.createDataFrame(lines, "file string, line_no int, line string"))
    assert dict(status.collect()) == {"p": "PARTIAL", "d": "UNSUPPORTED", "q": "SUPPORTED", "e": "SUPPORTED"}
    got = {(r.file, r.row_number): (r.raw, r.normalized) for r in rows.collect()}
    assert got[("p", 1)][0] == {"A": "1", "B": ""} and got[("p", 2)][0] == {"A": "1", "B": "2"}
    assert got[("q", 1)] == ({"A": " x ", "B,C": 'say "y"'}, {"A": "x", "B,C": 'say "y"'})
    assert len(got) == 3


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("EXEC SQL SELECT A INTO :V FROM t1 WHERE B = :W AND C = '1' END-EXEC", ("T1", "READS", "B = :W AND C = '1'", ["V", "W"])),
        ("insert into S.T2 (A) values (:X)", ("S.T2", "INSERTS", None, ["X"])),
        ("UPDATE T3 SET A = :V:IND WHERE B = 1 ORDER BY C", ("T3", "UPDATES", "B = 1", ["V"])),
        ("DELETE FROM T4", ("T4", "WRITES", None, [])),
        ("SELECT * FROM A JOIN B ON A.X = B.X WHERE A.X = :V", (None, None, None, ["V"])),
        ("COMMIT", (None, None, None, [])),
    ],
)
def test_sql_access(spark, sql, want):
    r = spark.createDataFrame([(sql,)], "s string").select(P.sql_access(F.col("s")).alias("a")).first().a
    assert (r.table, r.operation, r.predicate, r.host_variables) == want


def test_states_and_terms(spark):
    s = spark.createDataFrame([("r1", 1, "RUNNING"), ("r1", 2, "RUNNING"), ("r2", 5, "SUCCEEDED"), ("r3", 4, "RUNNING")], "run string, at int, status string")
    e = spark.createDataFrame([("r1", 3, "FAILED"), ("r2", 9, "FAILED"), ("r3", 4, "FAILED"), ("r4", 1, "FAILED")], "run string, at int, status string")
    got = {r.run: (r.status, r.emergency) for r in P.latest_state(s, e, "run", "at", "status", ["SUCCEEDED", "FAILED"]).collect()}
    assert got == {"r1": ("FAILED", True), "r2": ("SUCCEEDED", False), "r3": ("RUNNING", False), "r4": ("FAILED", True)}
    g = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z")], "tag string, term string")
    assert [(r.tag, r.terms) for r in P.unclear_terms(g).collect()] == [("a", ["x", "y"])]


def test_programs_and_manifests(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"program_name": "P", "source_file": "p.cbl", "source_hash": "h1"}')
    schema = "program_name string, source_file string, source_hash string"
    good = spark.createDataFrame([("p.cbl", "h1")], "source_file string, sha256 string")
    assert P.programs(spark, str(tmp_path / "p.json"), schema, good).first().program_name == "P"
    with pytest.raises(Exception, match="other source"):
        P.programs(spark, str(tmp_path / "p.json"), schema, good.withColumn("sha256", F.lit("h2"))).collect()
    (tmp_path / "m.xml").write_text("<m><table><name>T</name></table><table><name>U</name></table></m>")
    assert sorted(r.name for r in P.manifests(spark, str(tmp_path / "m.xml"), "table", "name string").collect()) == ["T", "U"]


def test_graph_is_replaced_by_package(spark, tmp_path):
    path = str(tmp_path / "g")

    def write(package, ids, edges):
        n = spark.createDataFrame([(i, package) for i in ids], "id string, package_hash string")
        K.replace_graph(n, spark.createDataFrame([(*e, package) for e in edges], "src string, dst string, package_hash string"), path)

    write("p1", ["a", "b"], [("a", "b")])
    write("p2", ["c", "d"], [("c", "d")])
    write("p1", ["a", "e"], [("a", "e")])
    nodes, edges = K.read_graph(spark, path)
    assert sorted(r.id for r in nodes.collect()) == ["a", "c", "d", "e"] and edges.count() == 2
    with pytest.raises(Exception, match="without a node"):
        write("p3", ["x"], [("x", "y")])


def test_rendered(spark, tmp_path):
    d = spark.createDataFrame([("k1", "A *b*", None), ("k2", "C", "d_e")], "key string, title string, note string")
    d = d.select("key", K.markdown(F.col("title"), {"Note": F.col("note")}).alias("text"))
    assert {r.key: r.text for r in d.collect()} == {"k1": "# A \\*b\\*\n", "k2": "# C\n\n- **Note**: d\\_e"}
    assert K.write_rendered(d, str(tmp_path / "r"), "key", "text").count() == 2
    assert spark.read.parquet(str(tmp_path / "r")).where("key = 'k2'").first().text == "# C\n\n- **Note**: d\\_e"
    K.write_artifact(d, str(tmp_path / "art"), "r1", "rendered")
    assert spark.read.parquet(str(tmp_path / "art")).where("run_id = 'r1'").count() == 2
