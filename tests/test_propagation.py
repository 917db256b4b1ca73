"""Followed literals against a plain interpreter of statement trees, from the same rules."""

import random

import pytest

from strandgraph.operators import effects as E
from strandgraph.operators import propagation as N

SCHEMA = (
    "program string, paragraph string, statement_id string, pos int, kind string, parent_id string, branch_kind string, branch_condition string, targets array<string>, sources array<string>, "
    "literals array<string>, condition_target string, condition_value boolean, target_paragraphs array<string>, call_kind string, arguments array<struct<name:string, mode:string, literal:string, omitted:boolean>>, returning string"
)
CONDITIONS = [("P", "ONE", "X", ["1"], False), ("P", "MANY", "Y", ["1", "2"], False), ("P", "RANGE", "Z", ["1"], True)]
ITEMS = [("P", "G1.X", "X"), ("P", "G1.W", "W"), ("P", "G2.W", "W"), ("P", "G1.Y", "Y"), ("P", "Z", "Z")]


def row(i, n, kind, parent=None, branch=None, condition=None, t=(), s=(), lit=(), ct=None, cv=None, away=None, call="LITERAL", args=None, back=None, paragraph="G"):
    return ("P", paragraph, i, n, kind, parent, branch, condition, list(t), list(s), list(lit), ct, cv, away, call, args, back)


class Plain:
    """Runs one paragraph statement by statement."""

    def __init__(self, rows, items=()):
        self.rows, self.facts, self.barriers = sorted(rows, key=lambda r: (r[3], r[2])), [], []
        self.whole = {q for _, q, _ in items}
        self.short = {}
        for _, q, name in items:
            self.short.setdefault(name, []).append(q)
        self.run([r for r in self.rows if r[5] is None], {}, "P::G::root")

    def key(self, name):
        if name in self.whole:
            return name, False
        found = self.short.get(name, [])
        return (found[0], False) if len(found) == 1 else (name, len(found) > 1)

    def fact(self, region, r, status, target, key, literal=None, steps=0):
        self.facts.append((region, r[2], status, target, key, literal, steps))

    def bar(self, region, r, reason, affected, clears):
        self.barriers.append((region, r[2], reason, sorted(set(affected)), clears))

    def run(self, rows, env, region):
        written = set()
        for r in rows:
            written |= self.decide(r, env, region) if r[4] in ("IF", "EVALUATE") else self.leaf(r, env, region)
        return written

    def decide(self, d, env, region):
        below = [r for r in self.rows if r[5] == d[2]]
        if any(r[6] is None for r in below):
            self.bar(region, d, "CONTROL_FLOW_BOUNDARY", env, True)
            gone = set(env)
            env.clear()
            return gone
        runs = []
        for r in below:
            if not runs or r[6] != runs[-1][-1][6] or r[7] is not None:
                runs.append([])
            runs[-1].append(r)
        written = set()
        for i, one in enumerate(runs):
            written |= self.run(one, dict(env), f"{region}::{d[2]}::{one[0][6]}::{i}")
        for name in written:
            env.pop(name, None)
        return written

    def clear(self, r, env, region, reason):
        for k in list(env):
            self.fact(region, r, "INVALIDATED", k, k)
        self.bar(region, r, reason, env, True)
        gone = set(env)
        env.clear()
        return gone

    def kill(self, r, env, region, name, status):
        k, _ = self.key(name)
        self.fact(region, r, status, name, k)
        env.pop(k, None)
        return {k}

    def give(self, r, env, region, name, literal, status):
        k, unclear = self.key(name)
        if unclear:
            self.bar(region, r, "AMBIGUOUS_SYMBOL", [name], False)
            return self.kill(r, env, region, name, "BLOCKED")
        self.fact(region, r, status, name, k, literal, 1)
        env[k] = (literal, 1)
        return {k}

    def leaf(self, r, env, region):
        _, _, _, _, kind, _, _, _, t, s, lit, ct, cv, away, call, args, back = r
        gone = set()
        if kind == "MOVE" and len(lit) == 1 and not s:
            for name in t:
                gone |= self.give(r, env, region, name, lit[0], "DIRECT")
            return gone
        if kind == "MOVE" and len(s) == 1 and len(t) == 1 and not lit:
            (k, unclear), (f, dim) = self.key(t[0]), self.key(s[0])
            if unclear or dim:
                self.bar(region, r, "AMBIGUOUS_SYMBOL", t if unclear else s, False)
                return self.kill(r, env, region, t[0], "BLOCKED")
            if f not in env:
                return self.kill(r, env, region, t[0], "UNRESOLVED_COPY")
            env[k] = (env[f][0], env[f][1] + 1)
            self.fact(region, r, "PROPAGATED", t[0], k, *env[k])
            return {k}
        if kind == "MOVE" and s and t and not lit:
            for name in t:
                gone |= self.kill(r, env, region, name, "UNRESOLVED_COPY")
            self.bar(region, r, "UNKNOWN_SIDE_EFFECT", t, False)
            return gone
        if kind == "SET" and ct is None:
            for name in t:
                gone |= self.kill(r, env, region, name, "INVALIDATED")
            if t:
                self.bar(region, r, "UNKNOWN_SIDE_EFFECT", t, False)
            return gone
        if kind == "SET":
            found = [c for c in CONDITIONS if c[1] == ct]
            if not found:
                return self.clear(r, env, region, "UNSUPPORTED_STATEMENT")
            _, _, parent, values, ranged = found[0]
            if cv and len(values) == 1 and not ranged:
                return self.give(r, env, region, parent, values[0], "CONDITION")
            self.bar(region, r, ("CONDITION_VALUE_RANGE" if ranged else "MULTIPLE_CONDITION_VALUES") if cv else "CONDITION_FALSE_VALUE_UNDETERMINED", [parent], False)
            return self.kill(r, env, region, parent, "BLOCKED")
        if kind == "COMPUTE" and t:
            for name in t:
                self.bar(region, r, "COMPUTED_VALUE", [name], False)
                gone |= self.kill(r, env, region, name, "INVALIDATED")
            return gone
        if kind == "EXEC_SQL":
            for name in t:
                gone |= self.kill(r, env, region, name, "INVALIDATED")
            if t:
                self.bar(region, r, "SQL_HOST_DIRECTION_UNKNOWN", t, False)
            return gone
        if kind in ("GO_TO", "PERFORM") and away:
            return self.clear(r, env, region, "CONTROL_FLOW_BOUNDARY" if kind == "GO_TO" else "LOOP_OR_PERFORM_BOUNDARY")
        if kind == "CALL" and call is not None:
            args = args or []
            if any(n is None and m == "UNKNOWN" and x is None and not o for n, m, x, o in args):
                return self.clear(r, env, region, "CALL_BOUNDARY")
            names = []
            for n, m, _, o in args:
                k = n and self.key(n)[0]
                if n is None or o or m in ("CONTENT", "VALUE") or k in gone:
                    continue
                names.append(n)
                gone |= self.kill(r, env, region, n, "INVALIDATED")
            if back is not None:
                if self.key(back)[0] not in gone:
                    names.append(back)
                gone |= self.kill(r, env, region, back, "INVALIDATED")
            if names:
                self.bar(region, r, "CALL_BOUNDARY", names, False)
            return gone
        return self.clear(r, env, region, "UNSUPPORTED_STATEMENT" if kind == "CALL" else "UNKNOWN_SIDE_EFFECT")


def check(spark, rows, items=()):
    s = spark.createDataFrame(rows, SCHEMA)
    c = spark.createDataFrame(CONDITIONS, "program string, condition string, parent string, values array<string>, ranged boolean")
    i = spark.createDataFrame(list(items), "program string, qualified string, simple string") if items else None
    facts, barriers = N.propagate(s, E.statement_effects(s, c), i)
    got = sorted(((r.paragraph, r.region, r.statement_id, r.status, r.target, r.key, r.literal, r.steps) for r in facts.collect()), key=repr)
    bars = sorted(((r.paragraph, r.region, r.statement_id, r.reason, r.affected, r.clears) for r in barriers.collect()), key=repr)
    want, wanted = [], []
    for p in sorted({r[1] for r in rows}):
        run = Plain([r for r in rows if r[1] == p], items)
        want += [(p, f[0].replace("P::G::", f"P::{p}::", 1), *f[1:]) for f in run.facts]
        wanted += [(p, b[0].replace("P::G::", f"P::{p}::", 1), *b[1:]) for b in run.barriers]
    assert got == sorted(want, key=repr)
    assert bars == sorted(wanted, key=repr)
    return facts, barriers


def random_paragraph(rng, name, size):
    rows, decisions, names = [], [None], ["X", "Y", "Z", "W", "G1.X", "Q"]
    pick = lambda n: [rng.choice(names) for _ in range(n)]
    for n in range(size):
        parent = rng.choice(decisions[-4:])
        branch = rng.choice(["THEN", "ELSE", "WHEN"]) if parent else None
        if parent and rng.random() < 0.01:
            branch = None
        place = dict(parent=parent, branch=branch, condition="c" if branch == "WHEN" and rng.random() < 0.5 else None, paragraph=name)
        kind = rng.choice(["LIT"] * 6 + ["COPY"] * 8 + ["IF"] * 4 + ["EVALUATE", "MULTI", "SET", "COND", "COMPUTE", "SQL", "CALL", "CALL", "GO_TO", "PERFORM", "DISPLAY", "GOBACK"])
        i = f"{name}{n}"
        if kind in ("IF", "EVALUATE"):
            decisions.append(i)
        rows.append({
            "LIT": lambda: row(i, n, "MOVE", t=pick(rng.choice([1, 1, 2])), lit=[str(n)], **place), "COPY": lambda: row(i, n, "MOVE", t=pick(1), s=pick(1), **place), "MULTI": lambda: row(i, n, "MOVE", t=["X", "Y"], s=pick(rng.choice([1, 2])), **place),
            "SET": lambda: row(i, n, "SET", t=["Y"], lit=["1"], **place), "COND": lambda: row(i, n, "SET", ct=rng.choice(["ONE", "MANY", "RANGE", "NONE"]), cv=rng.random() < 0.7, **place),
            "COMPUTE": lambda: row(i, n, "COMPUTE", t=rng.choice([["Z"], ["Z", "X"], []]), **place), "SQL": lambda: row(i, n, "EXEC_SQL", t=rng.choice([[], ["X", "Q"]]), **place),
            "CALL": lambda: row(i, n, "CALL", args=[(rng.choice([*names, None]), rng.choice(["REFERENCE", "CONTENT", "VALUE", "UNKNOWN"]), rng.choice([None, None, "7"]), rng.random() < 0.2) for _ in range(rng.randint(0, 3))], back=rng.choice([None, None, "Y"]), call=rng.choice(["LITERAL", "DYNAMIC", "LITERAL", "LITERAL", None]), **place),
            "GO_TO": lambda: row(i, n, "GO_TO", away=rng.choice([["A"], None]), **place), "PERFORM": lambda: row(i, n, "PERFORM", away=["A"], **place), "DISPLAY": lambda: row(i, n, "DISPLAY", **place), "GOBACK": lambda: row(i, n, "GOBACK", **place),
        }.get(kind, lambda: row(i, n, kind, **place))())
    return rows


@pytest.mark.parametrize("items", [(), ITEMS])
def test_random_trees(spark, items):
    rng = random.Random(11)
    rows = [r for p in range(40) for r in random_paragraph(rng, f"p{p}_", rng.randint(1, 45))]
    facts, barriers = check(spark, rows, items)
    kinds = {r.status for r in facts.select("status").distinct().collect()}
    assert kinds >= {"DIRECT", "CONDITION", "PROPAGATED", "UNRESOLVED_COPY", "INVALIDATED", "BLOCKED"}
    assert facts.where("status = 'PROPAGATED' and size(split(region, '::')) > 6").count() > 0
    assert barriers.where("clears and size(affected) > 1").count() > 0


def test_calls_forget_what_they_are_given(spark):
    cases = [
        (None, None, True), ([("X", "CONTENT", None, False)], None, True), ([("X", "VALUE", None, False)], None, True), ([("X", "REFERENCE", None, True)], None, True), ([(None, "REFERENCE", "5", False)], None, True), ([], "Y", True),
        ([("X", "REFERENCE", None, False)], None, False), ([("X", "UNKNOWN", None, False)], None, False), ([(None, "UNKNOWN", None, False)], None, False), ([], "X", False),
    ]
    rows = []
    for p, (args, back, _) in enumerate(cases):
        rows += [row(f"{p}.1", 1, "MOVE", t=["X"], lit=["1"], paragraph=f"p{p}"), row(f"{p}.5", 5, "CALL", args=args, back=back, paragraph=f"p{p}"), row(f"{p}.9", 9, "MOVE", t=["Y"], s=["X"], paragraph=f"p{p}")]
    facts, _ = check(spark, rows)
    known = {r.paragraph: r.status == "PROPAGATED" for r in facts.where("statement_id like '%.9'").collect()}
    assert known == {f"p{p}": k for p, (_, _, k) in enumerate(cases)}


def test_no_statements_and_no_python(spark, capsys):
    s = spark.createDataFrame([], SCHEMA)
    facts, barriers = N.propagate(s, E.statement_effects(s))
    assert facts.count() == 0 and barriers.count() == 0
    rows = random_paragraph(random.Random(2), "a", 30)
    s = spark.createDataFrame(rows, SCHEMA)
    facts, _ = N.propagate(s, E.statement_effects(s))
    facts.explain()
    assert "Python" not in capsys.readouterr().out


def test_numbers_of_facts_and_barriers(spark):
    rows = [row("1", 1, "MOVE", t=["X", "X"], lit=["1"]), row("2", 2, "COMPUTE", t=["X", "X"]), row("3", 3, "GO_TO", away=["A"])]
    facts, barriers = check(spark, rows)
    assert sorted((r.fact_id, r.ordinal) for r in N.numbered_facts(facts).collect()) == [(f"fact::P::G::P::G::root::X::{i}::{n}", n) for i, n in (("1::DIRECT", 0), ("1::DIRECT", 1), ("2::INVALIDATED", 0), ("2::INVALIDATED", 1))]
    assert sorted(r.barrier_id for r in N.numbered_barriers(barriers).collect()) == ["barrier::P::G::P::G::root::2::COMPUTED_VALUE::0", "barrier::P::G::P::G::root::2::COMPUTED_VALUE::1", "barrier::P::G::P::G::root::3::CONTROL_FLOW_BOUNDARY::0"]


def test_effects_of_the_statements_themselves(spark):
    """without effects, moves are taken from the rows that hold the statements; facts and barriers are the same."""
    rng = random.Random(5)
    s = spark.createDataFrame([r for p in range(12) for r in random_paragraph(rng, f"p{p}_", rng.randint(1, 40))], SCHEMA)
    for one, other in zip(N.propagate(s), N.propagate(s, E.statement_effects(s)), strict=True):
        got, want = (sorted(map(repr, df.collect())) for df in (one, other))
        assert got == want and got
