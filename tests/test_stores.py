"""Versions of tables, bound templates, manifests and guarded claims on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import guardrail as V
from strandgraph.operators.templates import Template, load_template
from strandgraph.sources import packages as P
from strandgraph.sources import sinks as K
from strandgraph.sources import versions as R


def rows(spark, path, name, version=None):
    return sorted(r.id for r in R.read_version(spark, path, name, version).collect())


def test_readers_see_whole_versions(spark, tmp_path):
    path = f"{tmp_path}/set"
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert R.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        R.read_version(spark, path, "nodes")
    first = R.publish(spark, {"nodes": table(1), "edges": table(2)}, path)
    held = []

    def between():
        held.append((R.current(spark, path), rows(spark, path, "nodes"), rows(spark, path, "edges")))

    second = R.publish(spark, {"nodes": table(3), "edges": table(4)}, path, before_pointer=between)
    assert held == [(first, [1], [2])] and R.current(spark, path) == second
    assert rows(spark, path, "nodes") == [3] and rows(spark, path, "edges", first) == [2]

    def stopped():
        raise RuntimeError("the writer is lost")

    with pytest.raises(RuntimeError):
        R.publish(spark, {"nodes": table(5), "edges": table(6)}, path, before_pointer=stopped)
    assert R.current(spark, path) == second and rows(spark, path, "edges") == [4]
    third = R.publish(spark, {"nodes": table(7), "edges": table(8)}, path)
    assert rows(spark, path, "nodes") == [7] and rows(spark, path, "nodes", second) == [3]
    folders = {p.name for p in (tmp_path / "set" / "versions").iterdir()}
    assert first not in folders and {second, third} <= folders

    def other_writer():
        R.publish(spark, {"nodes": table(9), "edges": table(9)}, path)

    last = R.publish(spark, {"nodes": table(10), "edges": table(10)}, path, before_pointer=other_writer)
    assert R.current(spark, path) == last and rows(spark, path, "edges") == [10]


def test_an_artifact_comes_back_when_its_swap_fails(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/artifacts"
    for i in (1, 2):
        K.write_artifact(spark.createDataFrame([(i,)], "id long"), path, "r", "s")
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    assert [p.name for p in (tmp_path / "artifacts" / "run_id=r").iterdir() if not p.name.startswith(".")] == ["stage=s"]


def test_templates():
    text = "SELECT ':no' AS a, \":no\" AS b, x::int -- :no\nFROM t /* :no */ WHERE k = :key AND (j = :key OR :least <= 1)"
    t = Template("q", text, {"key": 2, "least": 1})
    assert t.sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert t.effective(key="it's", least=None).endswith("WHERE k = 'it''s' AND (j = 'it''s' OR NULL <= 1)")
    for wrong in ({"key": 1, "least": 1}, {"key": 2}, {"key": 2, "least": 1, "no": 1}):
        with pytest.raises(ValueError):
            Template("q", text, wrong)
    for values in ({"key": 1}, {"key": 1, "least": 2, "more": 3}):
        with pytest.raises(ValueError):
            t.effective(**values)
    with pytest.raises(ValueError):
        Template("q", "  \n", {})


def test_templates_are_bound_not_pasted(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT id FROM {t} WHERE name = :name")
    q = load_template(spark, f"{tmp_path}/q.sql", "q", {"name": 1})
    t = spark.createDataFrame([(1, "a"), (2, "x' OR 'a' = 'a")], "id int, name string")
    for name, want in (("a", [1]), ("x' OR 'a' = 'a", [2]), (None, [])):
        got = q.run(spark, {"t": t}, name=name).collect()
        assert [r.id for r in got] == want
        assert all((r.template_sha256, r.effective_sha256) == (q.sha256, hashlib.sha256(q.effective(name=name).encode()).hexdigest()) for r in got)
    with pytest.raises(ValueError):
        load_template(spark, f"{tmp_path}/q.sql", "q", {"name": 2})


def test_manifest_outcomes(spark):
    cases = {
        "good": ('<m v="1"><n>x</n></m>', "VALID"), "bad value": ('<m v="2"><n>x</n></m>', "VALUE_INVALID"), "no n": ('<m v="1"/>', "SCHEMA_INVALID"), "neither": ("<m/>", "SCHEMA_INVALID"), "cut": ('<m v="1"><n>x', "NOT_WELL_FORMED"),
        "text": ("hello", "NOT_WELL_FORMED"), "empty": ("", "NOT_WELL_FORMED"), "null": (None, "NOT_WELL_FORMED"), "entity": ('<!DOCTYPE m [<!ENTITY e SYSTEM "file:///etc/passwd">]><m v="1"><n>&e;</n></m>', "UNSAFE"),
    }
    df = spark.createDataFrame([(k, x) for k, (x, _) in cases.items()], "path string, content string")
    got = {r.path: r for r in P.manifest_outcomes(df, "_v string, n string", {"v": F.col("_v").isNotNull(), "n": F.col("n").isNotNull()}, {"v": F.col("_v") == "1"}).collect()}
    assert {k: r.outcome for k, r in got.items()} == {k: w for k, (_, w) in cases.items()}
    assert got["neither"].problems == ["n", "v"] and got["good"].manifest.n == "x" and got["bad value"].manifest is None


def test_json_nodes(spark):
    docs = [("a", '{"x": {"y": [1, {"z": null}, "t"]}, "e": {}, "b": true}'), ("b", "[[2]]"), ("c", "no json"), ("d", None), ("e", '"text"')]
    got = {(r.k, r.path): r.value for r in V.json_nodes(spark.createDataFrame(docs, "k string, j string"), "k", "j").collect()}
    assert got == {
        ("a", "$"): None, ("a", "$.x"): None, ("a", "$.x.y"): None, ("a", "$.x.y[0]"): "1", ("a", "$.x.y[1]"): None, ("a", "$.x.y[1].z"): "null", ("a", "$.x.y[2]"): "t", ("a", "$.e"): None, ("a", "$.b"): "true",
        ("b", "$"): None, ("b", "$[0]"): None, ("b", "$[0][0]"): "2", ("e", "$"): "text",
    }


def test_claims(spark):
    doc = '{"decision": {"condition": "A B D203"}, "effects": {"table_effects": [{"table": "T 41", "approved_for_rule_text": true}, {"table": "U"}], "return_codes": [{"code": "ZZ9", "approved_for_rule_text": false}]}}'
    nodes = V.json_nodes(spark.createDataFrame([("p", doc)], "k string, j string"), "k", "j")
    claims = spark.createDataFrame([
        ("p", "c2", "effect", ["$.decision", "$.decision.none", None], ["e1", "e2"]), ("p", "c1", "effect", ["$.effects.table_effects[0]"], []), ("p", "c3", "title", ["$.effects.table_effects[1].table", "$.effects.return_codes[0].code", "$.effects.table_effects[7]"], []),
    ], "k string, claim string, field string, paths array<string>, ids array<string>")
    drafts = spark.createDataFrame([("p", "effect", "pays 'D203' and \"D20\" 41 and 4.5 on 2024-01-02 or 1/2/24, 'mixed\" 'low'"), ("p", "title", "code 'ZZ9'"), ("p", "context", "costs 7"), ("p", "statement", None)], "k string, field string, text string")
    got = {(r.field, r.code, r.claim, r.detail) for r in V.claim_violations(claims, drafts, nodes, spark.createDataFrame([("p", "e1")], "k string, id string"), "k").collect()}
    assert got == {
        ("effect", "unknown_evidence_path", "c2", "$.decision.none"), ("effect", "unknown_evidence_id", "c2", "e2"), ("title", "unknown_evidence_path", "c3", "$.effects.table_effects[7]"),
        ("title", "unapproved_table_effect", "c3", "$.effects.table_effects[1]"), ("title", "unapproved_return_code", "c3", "$.effects.return_codes[0]"), ("effect", "unsupported_explicit_literal", "c1", "D20"),
        ("effect", "unsupported_explicit_number", "c1", "4.5"), ("effect", "unsupported_explicit_date", "c1", "2024-01-02"), ("effect", "ambiguous_date_format", "c1", "1/2/24"),
        ("title", "unsupported_explicit_literal", "c3", "ZZ9"), ("context", "unsupported_explicit_number", None, "7"),
    }


def test_cases(spark):
    cases = [("p1", "POSITIVE", "A ", ["f"]), ("p2", "POSITIVE", "A", ["f", "g"]), ("p3", "POSITIVE", "B", ["f"]), ("n1", "NEGATIVE", "A", ["f"]), ("n2", "NEGATIVE", "C", ["f"]), ("n3", "NEGATIVE", "A", []), ("p4", "POSITIVE", "A", ["f"])]
    wants = [("p1", "e1", "R", None, "1", None, 1), ("p1", "e2", "R", "G", None, "x ", 1), ("p2", "e3", "R", None, None, None, 1), ("p3", "e4", "R", None, None, None, 1)]
    found = [(1, "R", "A", "G", " 1", "x"), (2, "R", "A", "H", "2", None), (3, "S", "A", "G", "1", "x"), (4, "UNKNOWN", "C", None, None, None), (5, "R", None, None, None, None)]
    verdicts, stray = V.case_verdicts(
        spark.createDataFrame(cases, "case_id string, kind string, program string, fixtures array<string>"), spark.createDataFrame(wants, "case_id string, expectation_id string, family string, paragraph string, literal string, condition string, min_count int"),
        spark.createDataFrame(found, "id int, family string, program string, paragraph string, literal string, condition string"), spark.createDataFrame([("f",)], "digest string"),
    )
    got = {r.case_id: (r.outcome, r.matched, r.unexpected) for r in verdicts.collect()}
    assert got == {"p1": ("MATCHED", 2, 1), "p2": ("NOT_EVALUATED", 0, 0), "p3": ("MISSING", 0, 0), "n1": ("UNEXPECTED_CANDIDATES", 0, 3), "n2": ("CONFIRMED_ABSENT", 0, 0), "n3": ("NOT_EVALUATED", 0, 0), "p4": ("MATCHED", 0, 0)}
    assert sorted((r.case_id, r.id) for r in stray.collect()) == [("n1", 1), ("n1", 2), ("n1", 3), ("p1", 2)]
    assert tuple(V.case_metrics(verdicts).first()) == (2, 1, 2, 1)


def test_citations_are_repaired_or_left(spark):
    doc = '{"decision": {"expression": "X > 30 AND Y = D203", "evidence_ids": ["d1"]}, "effects": {"return_codes": [{"code": "77"}, {"code": "40", "approved_for_rule_text": true, "evidence_ids": ["r1"]}], "table_effects": [{"table": "PAG_AUD", "evidence_ids": ["a"]}, {"table": "PAG_OPER", "approved_for_rule_text": true, "evidence_ids": ["o"]}, {"table": "PAG", "approved_for_rule_text": true}]}}'
    drafts = {
        "both": "over 30 gives 40", "one lacks": "over 30 gives 77", "quoted": "is 'D203'", "part of a word": "is 'D2'", "names one": "writes PAG_OPER", "names the wrong one": "PAG_OPER, not PAG_AUD", "names two": "PAG_OPER and PAG", "names none": "writes",
    }
    cite = lambda k: ["$.effects.table_effects[0]"] if k.startswith("names") else ["$.effects.table_effects[2].table"]
    rows = [(k, doc, "c", "effect", cite(k), ["a", "z"], text) for k, text in drafts.items()]
    d = spark.createDataFrame(rows, "k string, j string, claim string, field string, paths array<string>, ids array<string>, text string")
    nodes = V.json_nodes(d, "k", "j")
    found = V.claim_violations(d, d, nodes, d.select("k", F.explode(F.array(F.lit("a"), F.lit("z"))).alias("id")), "k")
    more = {r.k: (r.anchored, r.paths[1:], r.ids) for r in V.anchored_citations(d, nodes, found, "k").collect()}
    assert more["both"] == (True, ["$.decision", "$.effects.return_codes[1]"], ["a", "z", "d1", "r1"]) and more["quoted"] == (True, ["$.decision"], ["a", "z", "d1"])
    assert all(more[k] == (False, [], ["a", "z"]) for k in drafts if k not in ("both", "quoted"))
    moved = {r.k: (r.retargeted, r.paths, r.ids) for r in V.retargeted_citations(d, d, nodes, found, "k").collect()}
    assert moved["names one"] == (True, ["$.effects.table_effects[1]"], ["z", "o"])
    assert all(moved[k] == (False, cite(k), ["a", "z"]) for k in drafts if k != "names one")
