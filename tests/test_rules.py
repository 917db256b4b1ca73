"""Rules met through their literals against every rule on every text."""

import random
import re

from pyspark.sql import functions as F

from strandgraph.operators.rules import by_rules, required_literals

RULE = "rule_id string, tag string, pattern string, confidence double"


def test_required_literals():
    cases = {
        "STEEL|BRASS": ["BRASS", "STEEL"], "STEEL|B": None, "(?:abc|abd)+x?": None, "(?:abc|xbd)+x?": ["abc", "xbd"], "abc.*defgh": ["defgh"], "a?bcd": ["bcd"], "(abc)?": None, "(abc)*xyz": ["xyz"], "(abc){2}": ["abc"],
        "^(Customer|Supplier)#0012$": ["Customer", "Supplier"], "(?i)abcdef": None, "(?i:abc)defg": ["defg"], r"\bTOTAL\b": ["TOTAL"], "[abc]def": ["def"], "[": None, r"\Qabc\E": None, "": None, None: None, "(?=abcd)..": None, "ab(cd)ef": ["abcdef"], "a|": None, r"\.{3}": None,
    }
    for pattern, want in cases.items():
        assert required_literals(pattern) == want, pattern


def test_against_every_rule_on_every_text(spark):
    rng = random.Random(8)
    words = ["steel", "brass", "total", "amount", "limit", "x", "rate", "due", "ab", "abc", "Ünï", "a.b"]
    make = [lambda: rng.choice(words), lambda: "|".join(rng.sample(words, 2)).replace("a.b", r"a\.b"), lambda: rf"\b{rng.choice(words)}.*{rng.choice(words)}", lambda: f"(?i){rng.choice(words)}", lambda: f"({rng.choice(words)})?{rng.choice(words)}$", lambda: f"[{rng.choice('xyz')}]{rng.choice(words)}+"]
    rules = [(f"r{i}", "t", rng.choice(make)(), 0.5) for i in range(300)] + [("none", "t", None, 0.1), ("r0", "t", "steel", 0.5), ("r0", "t", "steel", 0.5)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["", None, "steel", "steel"]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id int, name string, item_ int, rule_ string").drop("item_", "rule_")
    got = sorted((r.id, r.rule_id) for r in by_rules(items, spark.createDataFrame(rules, RULE), F.col("name"), block=40).collect())
    assert got == sorted((i, r) for i, t in enumerate(texts) for r, _, p, _ in rules if t is not None and p is not None and re.search(p, t))


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("cast(id as string) as rule_id", "'t' as tag", "concat('code-', lpad(id, 6, '0'), '\\\\b') as pattern", "0.5D as confidence")
    items = spark.range(0, 100_000, 500).selectExpr("id", "concat('see code-', lpad(id, 6, '0'), ' and code-', lpad(id + 1, 6, '0'), '9') as name")
    got = by_rules(items, rules, F.col("name")).selectExpr("count(*) as n", "bool_and(cast(id as string) = rule_id) as own").first()
    assert tuple(got) == (200, True)
