"""Vector codes against all distances."""

import hashlib
import math

import numpy as np
import pytest

from strandgraph.llm import codes


def plain(rows, size=256, rounds=4, parts=4, scale=1024):
    """Result rows of (vec_id, vector, label) of one length, from the rules."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [[math.floor(scale * x) for x in p] for p in np.split(np.array(v, np.float64), np.cumsum([len(v) // parts + (i < len(v) % parts) for i in range(parts)])[:-1])]
    cuts = [cut(v) for _, v, _ in rows]
    books = [[c[p] for c in cuts[:size]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cuts:
                members.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(k, "".join(f"{i:02x}" for _, i in c), e, by_label[label], digest) for (k, _, label), c, e in zip(rows, coded, errors, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "vec_id long, embedding array<float>, label int, n int, code string, error int")


def check(spark, rows, want=None, **how):
    got = [tuple(r) for r in codes.encode_vectors(frame(spark, rows), **how).drop("label").collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, **how) if want is None else want, key=repr)


def vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * spread).astype(np.float32).tolist()


def test_random_vectors(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(1, 400, 12))]
    check(spark, rows, size=20)
    check(spark, rows[:30])


def test_awkward_vectors(spark):
    rows = [(i, v, None if i % 4 == 0 else i % 3) for i, v in enumerate(vectors(2, 60, 8))]
    rows += [(3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] * 8, 1), (5, None, 1), (6, [None] + [0.0] * 7, 1), rows[7], rows[7], (7, rows[9][1], None), (None, [0.5] * 8, 2), (None, None, None)]
    rows += [(200 + i, [-0.001 * i] * 8, None) for i in range(10)]
    check(spark, rows, size=16)


def test_lengths_have_codebooks_of_their_own(spark):
    a, b, c = [(i, v, 1) for i, v in enumerate(vectors(3, 40, 8))], [(100 + i, v, 2) for i, v in enumerate(vectors(4, 30, 7))], [(300, [], 3), (301, [], 3), (302, [0.5], 4), (303, [0.25], 4)]
    check(spark, a + b + c, plain(a, size=9) + plain(b, size=9) + plain(c[:2], size=9) + plain(c[2:], size=9), size=9)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(x * 4000)) for x in v], i % 2) for i, v in enumerate(vectors(5, 50, 8))]
    check(spark, rows, size=7)
    top = codes.encode_vectors(frame(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [0.0] * 4, 1)]), size=2).collect()
    assert len(top) == 3 and max(r.error for r in top) <= 4 * (2 * codes.BOUND) ** 2


def test_hot_label_and_empty_table(spark):
    rows = [(i, v, 7 if i % 2 else i) for i, v in enumerate(vectors(6, 3000, 4))]
    check(spark, rows, size=8, rounds=1)
    assert codes.encode_vectors(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        codes.encode_vectors(frame(spark, rows), size=257)


@pytest.mark.parametrize("spread", [1, 1000])
def test_annulus_holds_the_nearest_and_leaves_most_out(spread):
    rng = np.random.default_rng(8)
    lengths = np.exp(rng.uniform(0, 6, 2000))[:, None] * spread
    x = rng.standard_normal((2000, 6))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * lengths).astype(np.int64)
    entries, p = x[:256], np.concatenate([x[256:], x[:20]])
    code, error, evaluated = codes.nearest_entries(p, entries)
    d2 = ((p[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == d2.argmin(axis=1)).all() and (error == d2.min(axis=1)).all()
    assert evaluated < 0.6 * d2.size


def test_ties_go_to_the_lower_index():
    entries = np.array([[3, 4], [5, 0], [-5, 0], [5, 0], [0, 5]])
    code, error, _ = codes.nearest_entries(np.array([[0, 0], [5, 0], [1, 1]]), entries)
    assert code.tolist() == [0, 1, 0] and error.tolist() == [25, 0, 13]
