"""Repair of conversations against a plain recursion over cheapest edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from strandgraph.llm import repair

SPACE = " \t\n\x0b\x0c\r"
FREE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def step(state, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial)) if initial else state


def plain(rows):
    """Result columns of one conversation's (turn, role, text), from the rules."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    sys.setrecursionlimit(100_000)

    @lru_cache(None)
    def best(i, q, new=0):
        ways = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if i < len(rows):
            _, role, text = rows[i]
            gone = faults[i] in ("blank", "duplicate")
            more = 3 if faults[i] == "truncated" else 0
            choices = [(4, "D", q, ())]
            if not gone:
                choices.append((3 + more, "R", step(q, FREE[q][0]), (f"{FREE[q]}:{text}",)))
                if step(q, role[:1]) is not None:
                    choices.append((more, "K", step(q, role[:1]), (f"{role}:{text}",)))
            for cost, letter, to, line in choices:
                c, audit, lines = best(i + 1, to)
                ways.append((cost + c, letter + audit, line + lines))
        if new < 4:
            c, audit, lines = best(i, step(q, FREE[q][0]), new + 1)
            ways.append((3 + c, "I" + audit, (f"{FREE[q]}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    ), lines


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def some_turns(rng, n):
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = lambda: rng.choice(["Yes.", "No!", "Why?", "a b.", "cut", "", "  ", None, f"t{rng.random()}.", f"t{rng.random()}", "x. \n"])
    return [(rng.choice([i, i, i, i, i + 1, None]), role(), text()) for i in range(n)]


def frame(spark, conversations):
    rows = [(c, t, r, x, 1, "p", 2) for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, prefix string, n int")


def check(spark, conversations):
    t = frame(spark, conversations)
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in repair.repair_report(t).collect()}
    assert got == {c: plain(turns)[0] for c, turns in conversations.items()}
    lines = {}
    for r in repair.repaired_turns(t).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    assert lines == {c: list(enumerate(x)) for c, turns in conversations.items() if (x := plain(turns)[1])}


def test_random_conversations(spark):
    rng = random.Random(4)
    conversations = {i: some_turns(rng, rng.randint(1, 12)) for i in range(120)}
    conversations[None] = some_turns(rng, 9)
    check(spark, conversations)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in plain(t)[1] if x[0] != ":")) for t in conversations.values())


def test_long_conversations_are_cut_into_parts(spark):
    rng = random.Random(6)
    good = [(i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(301)]
    worse = [(t, r if rng.random() < 0.9 else "tool", x if rng.random() < 0.9 else rng.choice(["", "cut", "text 5."])) for t, r, x in good]
    check(spark, {1: good, 2: worse, 3: some_turns(rng, 300), 4: [(0, "user", "Hi.")]})


def test_copies_within_a_turn(spark):
    check(spark, {1: [(0, "user", "Same.")] * 50, 2: [(None, None, None)] * 7 + [(3, "assistant", "Late.")] * 2, 3: [(0, "user", "a."), (1, "assistant", "a."), (1, "assistant", "a."), (2, "user", "b")]})


def test_only_names_and_empty(spark):
    t = frame(spark, {1: [(0, "user", "A.")], 2: [(0, "user", "B.")]})
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in repair.repair_report(t.where("conv_id = 1"), t).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[1] == plain([(0, "user", "A.")])[0]
    assert repair.repair_report(t.limit(0)).count() == 0 and repair.repaired_turns(t.limit(0)).count() == 0


def test_very_long_text(spark):
    check(spark, {1: [(0, "user", "word " * 250_000 + "."), (1, "assistant", " " * 1_000_000), (2, "assistant", "x" * 1_000_000)]})


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t in [*range(6), None] for r, x in [("user", "One. Two!"), (None, None)]]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            want += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_pieces_add_up(seed):
    """Costs through pieces give the cost of the whole, wherever it is cut."""
    rng = random.Random(seed)
    kinds = [(rng.choice(["s", "u", "a", "", "?"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(30)]
    whole = repair.distances(kinds, repair.END, True)
    for cut in range(1, 30):
        rest = repair.distances(kinds[cut:], repair.END, True)[:4]
        assert rest == whole[4 * cut : 4 * cut + 4]
        assert repair.distances(kinds[:cut], dict(enumerate(rest)), False)[: 4 * cut] == whole[: 4 * cut]
