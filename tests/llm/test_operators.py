"""Operators against plain versions, on awkward small tables."""

import hashlib
import math
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import archives, chat, contamination, language, licenses, linededup, mixing, simhash, spans, topk

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega Éa Übung niño".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """(id, text): near and exact copies, repeated passages, periodic, blank, null and long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 90)) for _ in range(14)]
    passage = prose(rng, 45)
    texts = base + [base[0], base[0], base[3] + " tail", "lead " + passage + " x", passage, base[1] + "\n" + passage, base[2] + "\t" + passage + "\x0b" + base[4]]
    texts += ["a b c " * 30, "a b c " * 12, "", " \n\t ", None, None, "one", "two words", "A" * 3000, prose(rng, 3000), "nul\x00byte \x1f unit\x85next space"]
    return list(enumerate(texts))


def frame(spark, rows, extra=True):
    """Documents with extra columns whose names the operators use themselves."""
    clash = [(k, t, i % 3, "en", "s", "w", 1, "o") for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(clash, "doc_id long, text string, ord int, lang string, source string, word string, fp int, start string") if extra else spark.createDataFrame(rows, "doc_id long, text string")


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- simhash ------------------------------------------------------------------


def test_simhash_matches_brute_force(spark):
    rows = [*corpus(), (90, corpus()[0][1]), (90, corpus()[0][1])]
    got = simhash.near_duplicates(frame(spark, rows))
    same(collected(got, "doc_id", "fingerprint", "component_id"), brute.simhash(rows))


def test_simhash_null_ids_and_empty_table(spark):
    rows = [(None, "x y z w"), (7, "x y z w"), (None, "only nulls here share this")]
    same(collected(simhash.near_duplicates(frame(spark, rows)), "doc_id", "component_id"), [(None, 7), (7, 7), (None, None)])
    assert simhash.near_duplicates(frame(spark, corpus()).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    rng, table = random.Random(1), [m % (1 << 64) for m in simhash.masks(radius)]
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, radius)):
            y ^= 1 << b
        assert any(x & m == y & m for m in table)


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(2)
    center = rng.getrandbits(63)
    fps = {center}
    for _ in range(400):
        fps.add(center ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = dict(collected(simhash.components(df, 2), "fp", "component_id"))
    want = brute.groups(list(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[f] for f in fps] == want
    links = simhash.covering_links(df.select("fp"), 2, crowd=8).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 for r in links)


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "quite another text stands here")]
    df = frame(spark, rows)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


# --- archives -----------------------------------------------------------------


def pages(spark):
    rows = [
        (1, "http://a.example/x y", "<p>é</p>"), (2, "http://b.example/", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\nHTTP/1.1 200 OK\n1 2 3 4 5"),
        (6, "http://d.example/", "z" * 200_000), (None, "http://e.example/", "<p>é</p>"), (2, "http://b.example/", "<p>é</p>"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_pages_round_trip(spark, tmp_path):
    df = pages(spark)
    out = archives.archive_pages(df, f"{tmp_path}/arc", f"{tmp_path}/warc").collect()
    assert all(r.intact for r in out)
    html = {1: "<p>é</p>", 2: "<p>é</p>", 3: "", 4: "", 5: df.where("page_id = 5").first().html, 6: "z" * 200_000, None: "<p>é</p>"}
    for r in out:
        b = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), archives.base32_sha1(b))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=repr)
    want = [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (None, "revisit", 1)]
    assert got == sorted(want, key=repr)


def test_small_payloads_stay_responses(spark, tmp_path):
    out = archives.archive_pages(pages(spark), f"{tmp_path}/arc", f"{tmp_path}/warc", min_bytes=9)
    assert {r.record_type for r in out.where("payload_bytes < 9").collect()} == {"response"}


def test_empty_pages(spark, tmp_path):
    assert archives.archive_pages(pages(spark).limit(0), f"{tmp_path}/arc", f"{tmp_path}/warc").count() == 0


def test_arc_versions_dates_and_cut_files(spark, tmp_path):
    one = b"filedesc://a.arc 0.0.0.0 20010203 text/plain 13\n1 0 somebody\n\nhttp://h/ 1.2.3.4 20010203040506 text/html 5\nhello\ndns:h 1.2.3.4 200102 text/dns 3\nabc\n"
    two = b"filedesc://b.arc 0.0.0.0 20010203 text/plain 200 - - 0 b.arc 13\n2 0 somebody\n\nhttp://h/2 1.2.3.4 20010203040506 text/html 200 - - 77 b.arc 40\nHTTP/1.0 200 OK\r\n\r\ncut"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(one)
    (tmp_path / "in" / "b.arc").write_bytes(two)
    kinds = collected(archives.read_arc(spark, f"{tmp_path}/in"), "kind", "url", "payload_bytes")
    assert kinds == sorted([("warcinfo", "filedesc://a.arc", 13), ("resource", "http://h/", 5), ("resource", "dns:h", 3), ("warcinfo", "filedesc://b.arc", 13), ("response", "http://h/2", 3)], key=repr)
    archives.arc_to_warc(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    dates = {r.url: r.date for r in archives.read_warc(spark, f"{tmp_path}/out").collect()}
    assert dates["http://h/"] == "2001-02-03T04:05:06Z"
    assert dates["dns:h"] == "2001-02-01T00:00:00Z"


def test_arc_goes_on_after_bytes_that_are_no_record(spark, tmp_path):
    head = b"filedesc://a.arc 0.0.0.0 20010203 text/plain 13\n1 0 somebody\n\n"
    rec = lambda url, mime, body: b"%s 1.2.3.4 20010203040506 %s %d\n%s\n" % (url, mime, len(body), body)
    data = head + rec(b"http://h/1", b"text/html", b"one") + rec(b"http://h/with blank", b"text/html; charset=x", b"two") + b"garbage that\nis no record 12\n" + rec(b"http://h/3", b"text/html", b"three") + b"http://h/4 1.2.3.4 20010203040506 text/html 99\nstump"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(data)
    got = collected(archives.read_arc(spark, f"{tmp_path}/in"), "kind", "url", "payload_bytes", "problem")
    want = [("warcinfo", "filedesc://a.arc", 13, None), ("resource", "http://h/1", 3, None), ("resource", "http://h/with blank", 3, None), ("malformed", None, 29, "no record line"), ("resource", "http://h/3", 5, None), ("resource", "http://h/4", 5, "cut short")]
    same(got, want)
    parsed = list(archives.parse_arc(data))
    assert b"".join(b for _, f, b, _ in parsed if not f) == b"garbage that\nis no record 12\n"
    archives.arc_to_warc(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    raw = b"".join(archives._bytes(p.read_bytes()) for p in (tmp_path / "out").glob("part-*"))
    assert raw.count(b"WARC-Truncated: unspecified") == 1 and b"urn:arc:malformed:" in raw
    assert archives.read_warc(spark, f"{tmp_path}/out").count() == 6


def test_keys_with_line_ends_and_changed_payloads(spark, tmp_path):
    odd = "a\r\nX-Page-Id: b & c%"
    df = spark.createDataFrame([(odd, "http://x/", "text"), ("z", "http://y/", "text")], "page_id string, url string, html string")
    out = {r.page_id: r for r in archives.archive_pages(df, f"{tmp_path}/arc", f"{tmp_path}/warc").collect()}
    assert set(out) == {odd, "z"} and out["z"].refers_to == odd
    block = b"HTTP/1.1 200 OK\r\n\r\nother"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block))
    r = archives.read_warc(spark, f"{tmp_path}/bad").first()
    assert r.digest == archives.base32_sha1(b"other") and r.intact is False


def _warc(block, length=None, end="\r\n", kind="resource"):
    head = f"WARC/1.1{end}WARC-Type: {kind}{end}Content-Length: {len(block) if length is None else length}{end}{end}"
    return head.encode() + block + 2 * end.encode()


def test_warc_reader_loses_no_bytes(spark, tmp_path):
    good = _warc(b"one")
    cases = {
        "letters for a length": (good + _warc(b"two", "abc") + good, ["one", None, "one"]),
        "no length": (b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nxx\r\n\r\n" + good, [None, "one"]),
        "bytes between": (good + b"rubbish\r\n\r\nmore" + b"\r\n" + good, ["one", None, "one"]),
        "no blank line": (b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n" + good, [None, "one"]),
        "length beyond the data": (good + _warc(b"two", 10**9) + good, ["one", "two\r\n\r\n", "one"]),
        "length into the next record": (_warc(b"two", 30) + good + good, ["two\r\n\r\n", "one", "one"]),
        "length too short": (_warc(b"two and more", 3) + good, ["two", None, "one"]),
        "line feeds": (_warc(b"two", end="\n") + good, ["two", "one"]),
        "cut short": (good + _warc(b"two", 50), ["one", "two\r\n\r\n"]),
        "cut in a header": (good + b"WARC/1.1\r\nWARC-Ty", ["one", None]),
        "a record in a payload": (_warc(b"a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n") + good, ["a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n", "one"]),
        "nothing": (b"", []), "rubbish alone": (b"rubbish", [None]),
    }
    for name, (data, want) in cases.items():
        found = list(archives.parse_warc(data))
        assert [b.decode() if h else None for _, h, b, _ in found] == want, name
        assert all(p == "no record header" if not h else True for _, h, _, p in found)
        blank = data.replace(b"\r", b"").replace(b"\n", b"")
        spans = [data[at : data.index(b, at) + len(b)] for at, _, b, _ in found]
        assert b"".join(spans).replace(b"\r", b"").replace(b"\n", b"") == blank, name
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc").write_bytes(cases["letters for a length"][0])
    assert collected(archives.read_warc(spark, f"{tmp_path}/in"), "kind", "payload_bytes", "problem") == sorted([("resource", 3, None), ("malformed", 61, "no record header"), ("resource", 3, None)], key=repr)


def test_warc_reader_is_linear():
    for unit in (b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", b"\r\n", b"x: y\n"):
        began = time.time()
        assert sum(len(b) for _, _, b, _ in archives.parse_warc(b"WARC/1.1\r\n" + unit * (1_000_000 // len(unit)))) >= 0
        assert time.time() - began < 5


# --- lines and spans -------------------------------------------------------------


def lines_corpus():
    a, b, c = "first line of it", "second line of it", "third line of it"
    long = "a long line " * 12
    return [
        (0, "\n".join([a, b, c])), (1, "\n".join([b, c, "x"])), (2, "\n".join([c, b])), (3, f"{long}\nown"), (4, f"other\n  {long} \r\n\nmore"),
        (5, "\n".join([a, "", " ", b, "tail"])), (6, None), (7, ""), (8, "\n\n"), (9, "p\np\np\np"), (10, "\n".join([a, b, c])),
    ]


def test_second_hash_is_not_made_from_the_first(spark):
    from strandgraph.llm.rows import text_hashes

    one, two = spark.createDataFrame([("some line",)], "t string").select(*text_hashes(F.col("t"))).first()
    seed = spark.range(1).select(F.xxhash64(F.lit(1))).first()[0]
    import xxhash

    digest = lambda s: (xxhash.xxh64_intdigest("some line", s % (1 << 64)) + (1 << 63)) % (1 << 64) - (1 << 63)
    assert (one, two) == (digest(42), digest(seed))


def test_maximal_line_runs(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d e", "", f" u{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + "\n" + rows[5][1]), (102, None), *[(103 + i, "\n".join(f"z{j}" for j in range(11))) for i in range(3)]]
    same([tuple(r) for r in linededup.repeated_runs(frame(spark, rows)).collect()], brute.maximal_runs(rows, 2))


def test_texts_of_many_lines(spark):
    many = "\n".join(f"line {i} of many" for i in range(200_000))
    df = spark.createDataFrame([(1, many), (2, "x\nline 5 of many\nline 6 of many\ny"), (3, "a\n" * 500)], "doc_id long, text string")
    out = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert out[1].text == many and out[2].text == "x\ny" and out[3].n_removed == 499 and out[3].text == "a\n"


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs(spark, min_lines):
    df = frame(spark, lines_corpus())
    out = linededup.dedup_lines(df, min_lines=min_lines)
    assert out.columns[: len(df.columns)] == df.columns
    got = collected(out, "doc_id", "n_lines", "n_removed", "n_left", "text")
    same(got, brute.line_runs(lines_corpus(), min_lines))


def test_widespread_lines_go(spark):
    planted = ["Please read our terms of use here.", "All rights reserved by the owner of this page, and no part may be copied without leave, as ever."]
    rows = [(i, "\n".join(x for p in (*planted, "Les.", "Two words") for x in (f"own line {i} before {p}", p))) for i in range(5)]
    rows += [(9, "\n".join(["own start", "only in two documents", "own middle", planted[0], "own tail", planted[0], "own end"])), (10, "x\nonly in two documents\ny")]
    assert all(30 <= len(p) < 100 for p in planted)
    from corpus_pipeline import line_dedup

    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup(spark, df, "").collect()}
    assert got[0] == rows[0][1].split("\n")
    for i in range(1, 5):
        assert got[i] == [x for x in rows[i][1].split("\n") if x not in planted]
    assert got[9] == ["own start", "only in two documents", "own middle", "own tail", "own end"] and got[10] == ["x", "only in two documents", "y"]


def test_line_runs_with_repeated_and_null_ids(spark):
    rows = [(1, "a b\nc d\ne"), (1, "a b\nc d\ne"), (None, "a b\nc d\nf"), (1, "zz\nyy")]
    out = linededup.dedup_lines(frame(spark, rows))
    assert sorted(r.text for r in out.collect()) == sorted(["a b\nc d\ne", "a b\nc d\ne", "f", "zz\nyy"])
    assert linededup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(frame(spark, lines_corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("k,m,wide", [(20, 8, 32), (20, 8, 0), (5, 3, 1), (3, 3, 32)])
def test_repeated_spans(spark, k, m, wide):
    df = frame(spark, corpus()).repartition(3)
    got = collected(spans.remove_repeats(df, k=k, m=m, wide=wide), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, brute.repeats(corpus(), k))


def test_paths_compact_to_their_full_length(spark):
    """A copy of a whole text is one path; so is a passage on each side of a changed word."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    spans_of = [(2, 0, 30, 1, 70), (2, 30, 500, 1, 100), (2, 540, 100, 1, 610), (2, 640, 1, 3, 0)]
    df = spark.createDataFrame(spans_of, "ord long, start long, n long, source_ord long, source_start long")
    got = collected(spans._compacted(df), "ord", "start", "length", "source_ord", "source_start")
    same(got, [(2, 0, 530, 1, 70), (2, 540, 100, 1, 610), (2, 640, 1, 3, 0)])
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:1500], "other", *words[1500:]]))]
    same(collected(spans.remove_repeats(frame(spark, rows)), "doc_id", "n_words", "n_removed"), [(1, 3000, 0), (2, 3000, 3000), (3, 3001, 3000)])


def test_words_that_differ_from_their_source_stay(spark):
    """Coordinates alone remove nothing: the words at both places must be equal."""
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d x")], "ord long, text string").withColumn("doc_id", F.col("ord"))
    paths = spark.createDataFrame([(2, 0, 2, 1, 0), (2, 0, 3, 1, 0)], "ord long, start long, length long, source_ord long, source_start long")
    packed = spans._packed(texts)
    known = spans._with_digests(paths, packed, 3).groupBy("ord").agg(F.collect_list(F.struct("start", "length", "digest")).alias("runs"))
    out = packed.join(known, "ord").select("doc_id", "z", "runs").mapInArrow(spans._finish(3, True, "bigint"), "doc_id bigint, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same(collected(out, "doc_id", "n_removed", "kept_text"), [(2, 4, "x")])


def test_one_passage_in_every_chunk(spark):
    """A passage in a third of all texts, over many partitions, and a text of over 1 MB."""
    rng = random.Random(9)
    passage, long_one = prose(rng, 60), prose(rng, 180_000)
    rows = [(i, f"{prose(rng, 30)} {passage} {i}" if i % 3 == 0 else prose(rng, 60)) for i in range(300)] + [(300, long_one), (301, long_one)]
    got = collected(spans.remove_repeats(frame(spark, rows).repartition(40)), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, brute.repeats(rows, 20))


def test_repeated_spans_ties(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    got = collected(spans.remove_repeats(frame(spark, rows)), "doc_id", "n_words", "n_removed")
    same(got, [(1, 30, 0), (1, 30, 0), (None, 30, 30), (2, 0, 0)])
    assert spans.remove_repeats(frame(spark, rows).limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------


def sources(spark, n=600):
    rng = random.Random(3)
    names = ["a", "b", "c", "Z", "é", None]
    rows = [(i, None if i % 50 == 0 else prose(rng, rng.randint(1, 60)), names[min(5, int(rng.expovariate(0.9)))]) for i in range(n)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_mix_meets_targets(spark):
    df = sources(spark)
    out = mixing.mix_sources(df).toPandas()
    again = mixing.mix_sources(df.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, out[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    assert (out.taken <= 2 * out["size"]).all() and len(out) == 600
    out["source"] = out.source.fillna("~")
    per = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.source_size).all()
    assert ((per.taken - per.target).abs() <= 60).all()
    assert abs(per.target.sum() - 1.5 * per.source_size.sum()) < 1e-6
    order = sorted(per.index, key=lambda s: (s == "~", s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    free = [s for s in order if per.target[s] < 2 * per.source_size[s] - 1e-9]
    assert max(per.target[s] / weight[s] for s in free) - min(per.target[s] / weight[s] for s in free) < 1e-6


def test_mix_edge_cases(spark):
    empty = sources(spark).limit(0)
    assert mixing.mix_sources(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_sources(wordless).collect()} == {0}
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(twice).count() == 3
    rows = mixing.mix_rows(sources(spark))
    assert rows.columns == ["doc_id", "text", "source", "size", "copy_no"]
    assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("block", [3, 4096])
def test_mix_with_one_id_in_many_rows(spark, monkeypatch, block):
    """Null and common ids: ranks go on through all rows of one id, however they are cut into blocks."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 7, i]), " ".join("w" * rng.choice([1, 1, 2])), "s" if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(df)
    rate = {r.source: r.target / r.source_size for r in got.select("source", "target", "source_size").distinct().collect()}
    for source in ("s", None):
        offset = int(hashlib.md5(f"7:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32
        digest = lambda k: hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()
        mine = sorted((len(t.split()), digest(k), k is not None, k or 0) for k, t, s in rows if s == source)
        steps = [math.floor((i + 1) * rate[source] + offset) - math.floor(i * rate[source] + offset) for i in range(len(mine))]
        want = sorted((size, -1 if not known else k, c) for (size, _, known, k), c in zip(mine, steps, strict=True))
        assert sorted((r["size"], -1 if r.doc_id is None else r.doc_id, r.copies) for r in got.where(F.col("source").eqNullSafe(F.lit(source))).collect()) == want


def test_mix_runs_no_python(spark):
    plan = mixing.mix_sources(sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- chat ------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "Hi"), (0, 1, "assistant", "Good"), (1, 0, "user", "Hi"), (1, 1, "assistant", "Bad"), (1, 2, "user", None),
        (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "user", "lonely"), (None, 0, "user", "nobody"), (6, 0, None, "<|im_end|>"), (7, 0, "system", ""), (7, 0, "system", ""),
    ]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pair string")
    out = {r.pair: r for r in chat.preference_pairs(t, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0).collect()}
    assert sorted(out) == [0, 1, 3]
    r = out[0]
    assert (r.n_prefix, r.n_chosen, r.n_rejected) == (1, 1, 2)
    assert r.prompt == "<|im_start|>user\nHi<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\nGood<|im_end|>\n"
    pieces = [x.split(":") for x in r.chosen_mask.split(",")]
    assert sum(int(n) for n, _ in pieces) == len(r.chosen)
    at, learned = 0, ""
    for n, flag in pieces:
        learned += r.chosen[at : at + int(n)] if flag == "1" else ""
        at += int(n)
    assert learned == "Good<|im_end|>"
    assert (out[1].n_prefix, out[1].chosen, out[1].rejected, out[1].chosen_mask) == (1, "", "", "")
    assert out[3].n_rejected == 2 and "< |im_end|>" in out[3].chosen and "unknown" in out[3].chosen
    assert chat.preference_pairs(t.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_preference_pairs_run_no_python_and_take_long_conversations(spark):
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" if i < 2000 else f"turn {i} of {c}") for c in (0, 1) for i in range(2500)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.preference_pairs(t, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    r = out.first()
    assert (r.n_prefix, r.n_chosen, r.n_rejected) == (2000, 500, 500) and r.prompt.count("<|im_start|>") == 2000


# --- language ----------------------------------------------------------------------


def test_language_pages_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.train(seen, rows_per_language=40)
    kept = language.reject_languages(held, model)
    assert kept.columns == held.columns and kept.count() >= 0.99 * held.count()
    blind = language.fuse(held.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), *[F.lit(None).cast("string").alias(c) for c in ("host", "domain", "suffix")]), model, ["doc_id"]).join(held.select("doc_id", "lang"), "doc_id")
    right = blind.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97
    odd = spark.createDataFrame([(1, None, "en", "s"), (2, "123 456", "en", "s"), (3, "", "xx", None), (4, "the and this is of that with the", None, None)], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in language.reject_languages(odd, model).collect()] == [4]
    assert language.reject_languages(odd, model, allowed=["fr"]).count() == 0
    assert language.reject_languages(odd.limit(0), model).count() == 0


def test_texts_in_no_known_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40))
    strange = [
        "La mattina presto il vecchio pescatore prende la sua barca e va verso il mare aperto per cercare qualche pesce da vendere al mercato della piazza",
        "Wczesnym rankiem stary rybak bierze swoją łódź i płynie na otwarte morze aby złowić kilka ryb które sprzeda na rynku",
        "Рано утром старый рыбак берёт свою лодку и выходит в открытое море чтобы поймать рыбу для продажи на рынке", "清晨老渔夫带着他的船去大海里捕鱼然后在市场上出售", noise,
    ]
    odd = spark.createDataFrame([(-1 - i, t, lang, "web") for i, t in enumerate(strange) for lang in ("en", None)], docs.schema)
    stray = spark.createDataFrame([(-100 - i, " ".join(rng.choice(["zzyx", "qwykk", "xxolv", "jjupt"]) for _ in range(30)), "xx", "web") for i in range(20)], docs.schema)
    from corpus_pipeline import language_id

    kept = [r.doc_id for r in language_id(spark, docs.union(odd).union(stray), "").select("doc_id").collect()]
    assert min(kept) >= 0
    assert len(kept) >= 0.99 * docs.count()


def test_evidence_beside_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, rows_per_language=40)
    html = [(i, "https://www.firma.de/a", '<html lang="de"><p>und der die das nicht auch für</p></html>') for i in range(8)]
    html += [(100, "https://www.firma.de/b", "<p>12 34</p>"), (101, None, None), (102, "not an address", "<html lang=FR>"), (100, "https://www.firma.de/b", "<p>12 34</p>")]
    pages_ = spark.createDataFrame([(*r, "clash") for r in html], "page_id long, url string, html string, language string")
    out = {r.page_id: r for r in language.identify_pages(pages_, model).collect()}
    assert out[100].language == "de" and out[100].text_language is None
    assert out[102].language == "fr" and out[102].declared == "fr"
    assert out[101].language is not None and out[101].grams == 0
    assert language.identify_pages(pages_, model).count() == 12
    assert language.identify_pages(pages_.limit(0), model).count() == 0


def test_language_evidence_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, rows_per_language=40)
    texts = [r.text for r in docs.where("length(text) between 40 and 4000").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(6)
    hosts = ["www.firma.de", "de.firma.de", "a.example.ch", "b.example.ch", "shop.example.fr", "x.org", "y.x.org", "localhost"]
    rows = [(i, f"https://{rng.choice(hosts)}/p{i}", f'<html lang="{rng.choice(["de", "en", "fr", "xx", "EN-us"])}"><script>var x</script><p>{t[:rng.choice([20, 200, 4000])]}</p>') for i, t in enumerate(texts)]
    rows += [(100, "https://user@www.firma.de:8/b?x", "<p>12 34</p>"), (101, None, None), (102, "not an address", "<html lang=FR>"), (103, "ftp://Z.Example.CH", ""), (104, "https://x.org", "<p>" + texts[0] * 300 + "</p>"), (None, "https://x.org", "<p>the</p>")]
    got = language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model)
    got = got.withColumn("confidence", F.round("confidence", 6))
    same(collected(got, "page_id", "declared", "text_language", "language", "confidence", "grams"), brute.languages(rows, model, language.trigrams, language.SUFFIX_LANGUAGES))


@pytest.mark.parametrize("unit", ["<", "<!--", "<script ", "<style>", "<html ", "<a href='x' ", "&amp", "</script", "<html lang=", "a < b ", "<p>x</p>"])
def test_long_pages_take_linear_time(spark, unit):
    html = unit * (1_000_000 // len(unit))
    began = time.time()
    language.visible_text(html)
    assert time.time() - began < 5
    df = spark.createDataFrame([(1, "http://" + "a" * 1_000_000, html), (2, "http://" + "a." * 500_000, html)], "page_id long, url string, html string")
    began = time.time()
    assert df.select("page_id", "url", "html").transform(language.page_evidence).select("declared", "host", "domain", "suffix").collect() is not None
    assert time.time() - began < 5


def test_visible_text():
    cases = {
        "<p>a</p>b": "a b", "a<!-- x <b> -->b": "a b", "a<script>if (x < 1) </b></SCRIPT >b": "a b", "a < b": "a < b", "a<b": "a", "a<style>x": "a", "a<!-- b": "a", "a&amp;b&#65;c&;": "a b c&;",
        "<scripted>a</scripted>": "a", "a<>b": "a<>b", "": "", None: "",
    }
    for html, want in cases.items():
        assert language.visible_text(html).split() == want.split(), html


def test_many_labels_make_one_more_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    model = language.train(dirty, rows_per_language=40, languages=2, always=["es"])
    assert len(model.languages) in (3, 4) and language.OTHER in model.languages and "es" in model.languages and model.logs.shape[1] == len(model.languages)
    assert dirty.select(model.known(F.lit(" ES ")), model.known(F.lit("x9")), model.known(F.lit("")), model.known(F.lit(None).cast("string"))).first()[:] == ("es", language.OTHER, None, None)


# --- top k ----------------------------------------------------------------------------


def top(rows, k):
    """Every valid row, null and repeated ids included, against all other rows of its length."""
    rows = [(i, np.floor(np.array(v, np.float64) * 64).astype(np.int64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is not None and q % 3 == 0:
            best = sorted((-int(v @ x), c is None, c or 0) for n, (c, x) in enumerate(rows) if n != at and len(x) == len(v))[:k]
            out += [(q, i + 1, None if none else c, -s) for i, (s, none, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("block_rows,query_rows,pivots", [(4096, 4096, None), (5, 4, 6), (50, 10, 1)])
def test_top_k_is_exact(spark, block_rows, query_rows, pivots):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    rows += [(300, None), (303, [float("nan")] + [0.0] * 7), (306, [float("inf")] * 8), (None, rows[1][1])]
    rows += [(309, [None] + [0.0] * 7), (312, []), (315, [1.0]), (318, [2.0, 1.0]), (321, [1.0, 3.0]), (322, [0.5, 0.5]), (3, rows[7][1]), (4, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    out = topk.nearest(df, F.col("vec_id") % 3 == 0, k=7, pivots=pivots, block_rows=block_rows, query_rows=query_rows)
    same(collected(out, "query_id", "rank", "vec_id", "score"), top(rows, 7))


def test_top_k_replicates_what_is_needed(spark):
    """Of 20,000 vectors in far-apart bundles, with 100 queries a part, few are sent anywhere twice."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(100, 16)) * 40
    v = np.concatenate([c + rng.normal(size=(200, 16)) for c in centers])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    dealt, plain = [], topk.deal

    def counted(data, sent, *how):
        out = plain(data, sent, *how)
        dealt.append(tuple(x.count() for x in out))
        return out

    topk.deal = counted
    try:
        got = topk.nearest(df, F.col("vec_id") % 20 == 0, k=5, query_rows=100)
        assert got.count() == 5000
    finally:
        topk.deal = plain
    assert dealt[0][0] <= 20_000 and dealt[0][1] == 1000
    assert dealt[1][0] <= 2 * 20_000 and dealt[1][1] <= 10 * 1000
    w = np.floor(v * 64).astype(np.int64)
    for r in got.where("rank = 1 and query_id % 1000 = 0").collect():
        s = w[r.query_id] @ w.T
        s[r.query_id] = np.iinfo(np.int64).min
        assert r.score == s.max()


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    same(collected(topk.nearest(df, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score"), [(0, 1, 1, 64 * 64 * 11)])
    assert topk.nearest(df.limit(0), F.lit(True)).count() == 0
    assert topk.nearest(df.limit(1), F.lit(True)).count() == 0
    twice = df.union(df)
    assert topk.nearest(twice, F.col("vec_id") == 0).count() == 6


def test_many_lengths_in_one_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3 + i % 12).astype(np.float32).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    began = time.time()
    got = topk.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    took = time.time() - began
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    for q in range(0, 240, 20):
        others = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:3]
        assert sorted(by_query[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(others)]
    assert took < 40


# --- licenses ---------------------------------------------------------------------------


def license_rows():
    return [
        (1, "Released under the MIT License."), (2, "under-the MIT... license under the mit license"), (3, "APACHE LICENSE, Version 2.0"), (4, "cc-by-nc cc by nc"), (5, "under the mit"),
        (6, None), (7, ""), (8, "nothing here"), (2, "under-the MIT... license under the mit license"), (None, "cc by nc"), (9, "x " * 5000 + "under the mit license"),
        (10, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ]


def test_license_base_labels(spark):
    out = licenses.scan_licenses(frame(spark, license_rows()))
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(collected(out, *cols), brute.licenses(license_rows(), licenses.PHRASES))
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[10].labels == "mit" and by_id[10].base_labels == "" and 0.6 <= by_id[10].score < 1
    assert by_id[8].labels == "" and by_id[8].score == 0 and by_id[1].score == 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in by_id.values())
    assert licenses.scan_licenses(frame(spark, license_rows()).limit(0)).count() == 0


def test_license_grants(spark):
    rows = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under the GNU General Public License, version 2.", "gpl-2"), ("under the GNU Lesser General Public License v3", "lgpl-3"),
        ("GNU LGPL version 2.1 or later", "lgpl-2.1"), ("under the GNU Affero General Public License, Version 3", "agpl-3"), ("released under the BSD 3-Clause License", "bsd"), ("Mozilla Public License, version 2.0", "mpl-2"),
        ("licensed under CC BY-SA 4.0", "cc-by-sa"), ("licensed under CC BY 4.0", "cc-by"), ("This work is licensed under the laws of the land, version 3.", ""), ("the GNU General Public License", ""), (None, ""),
        ("// SPDX-License-Identifier: GPL-3.0-only", "gpl-3"), ("# SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: EPL-2.0", "epl-2"), ("Licensed under GPLv3.", "gpl-3"), ("released under the ISC license", "isc"),
        ("carbon copies: cc by 2 friends", ""), ("licensed under CC BY 4", "cc-by"), ("cc-by-3.0", "cc-by"), ("Eclipse Public License - v 2.0", ""), ("Eclipse Public License, version 2.0", "epl-2"), ("under the terms of the AGPLv3", "agpl-3"),
    ]
    out = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in out} == {i: x for i, (_, x) in enumerate(rows)}
    assert all(r.n_base == 0 and r.base_labels == "" for r in out) and all(r.score == 1 for r in out if r.labels)


def test_license_texts_and_scores(spark):
    rng = random.Random(8)
    texts = {k: v[0] for k, v in licenses.whole_texts().items()}
    w = {k: v.split() for k, v in texts.items()}
    typo = ["changed" if rng.random() < 0.03 else x for x in w["mit"]]
    rows = [*license_rows(), *[(100 + i, t) for i, t in enumerate(texts.values())]]
    rows = [(i, t) for i, t in rows if i is not None]
    rows += [(200, " ".join(typo)), (201, " ".join(w["gfdl-1.3"][: len(w["gfdl-1.3"]) // 3])), (202, texts["mit"] + prose(rng, 40) + texts["bsd-3"] + texts["mit"]), (203, texts["bsd-2"] + "\nunder the mit license"), (204, prose(rng, 3000) + " " + texts["mpl-2"]), (205, " ".join(x for x in w["bsd-3"] if rng.random() > 0.4))]
    got = collected(licenses.scan_licenses(frame(spark, rows)), "doc_id", "labels", "score")
    same(got, brute.license_labels(rows, licenses.templates()))
    labels = {i: set(x.split(",")) for i, x, _ in got}
    assert all(k in labels[100 + i] for i, k in enumerate(texts))
    assert "bsd-2" not in labels[100 + list(texts).index("bsd-3")] and "bsd-3" not in labels[203] and "mit" in labels[200] and labels[201] == {""} and {"mit", "bsd-3"} <= labels[202]


# --- contamination --------------------------------------------------------------------------


def bench_rows():
    rng = random.Random(9)
    long = prose(rng, 40)
    return long, [(1, long), (2, long), (10, "short item"), (3, None), (4, "..."), (None, "lost item"), (5, " ".join(["again"] * 20)), (6, "Éa, der Übung-niño")]


@pytest.mark.parametrize("held", [1 << 20, 8])
def test_contamination(spark, held, monkeypatch):
    monkeypatch.setattr(contamination, "HELD", held)
    long, items = bench_rows()
    w = long.split()
    rng = random.Random(11)
    rows = [
        (1, long), (2, prose(rng, 300) + " " + " ".join(w[5:18]) + " " + prose(rng, 20)), (3, " ".join(w[5:17])), (4, "a Short -- ITEM b"), (5, None), (6, ""), (7, " ".join(["again"] * 14)),
        (8, " ".join(w[:6]) + " other " + " ".join(w[7:])), *[(20 + i, " ".join([*w[:i], "other", *w[i + 1 : 13]])) for i in range(13)], (9, "éa der übung niño"), (10, "Éa der Übung niño"), (11, prose(rng, 2000) + " " + long), (1, long), (12, "a lost item"), (None, "lost item here"), (13, " ".join(["again"] * 30_000)),
    ]
    bench = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, window int")
    out = contamination.find_passages(frame(spark, rows), bench)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(collected(out, *cols), brute.contamination(rows, items))
    by_id = {r.doc_id: r for r in out.collect()}
    assert [tuple(p) for p in by_id[1].passages] == [(0, 40)]
    assert sum(by_id[20 + i].n_near for i in range(13)) > 0 and all(by_id[20 + i].n_hit == 0 for i in range(13))
    assert contamination.find_passages(frame(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination.find_passages(frame(spark, rows).limit(0), bench).count() == 0
