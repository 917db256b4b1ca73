"""Secrets in texts, told from copied examples by who else in the corpus has them."""

from __future__ import annotations

import math
import re
from bisect import bisect, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.rows import salted_join
from strandgraph.llm.words import chunks
from strandgraph.store import stash

#: Kinds whose matches are the base spans, and their least lengths (of group 2 of ``assign``).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = {"assign": 6, "access": 20, "hex": 24}
#: Parts of the keywords of ``assign``; a text without any has no such match.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Public credential formats, by kind; a text must hold the first string to have one.
FORMATS = {
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{20,}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "url": ("://", re.compile(r"(?<=://)[^\s/:@]{1,256}:[^\s/:@]{6,256}(?=@)")),
    "code": ("_", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|[rs]k_live_[A-Za-z0-9]{16,})")),
    "chat": ("xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    "cloud": ("AIza", re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}")),
}
#: Order of kinds at one start; ``bare`` is a random-looking run without a format.
KINDS = [*BASE, *FORMATS, "bare"]
#: Runs that may hold an access key, hex digits or a bare token; all three lie in one run.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Parts of values that nobody means as a secret.
PLACEHOLDERS = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?(?:key|token|secret|password)|xxxx|\*\*\*|1234567|abcdef|0{8}", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits a character, by the value's own frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value looks drawn at random: no placeholder, letters and digits mixed, 2.5 bits a character."""
    return len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not PLACEHOLDERS.search(value) and entropy(value) >= 2.5


def _random_run(run: str) -> bool:
    return sum(c.isdigit() for c in run) >= 3 and sum(c.isalpha() for c in run) >= 3 and entropy(run) >= 3.2 and not _UUID.fullmatch(run)


def base_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, leftmost without overlap per kind."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        yield from (("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= BASE["assign"])
    for r in _RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            yield from ((kind, *m.span(), m[0]) for m in pattern.finditer(text, *r.span()) if m.end() - m.start() >= BASE[kind])


def further_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value) of formats and bare runs that overlap neither ``taken`` nor one another."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(taken):  # overlapping base spans count as one
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))

    def free(start: int, end: int) -> bool:
        i = bisect(merged, (start, end))
        return not (i and merged[i - 1][1] > start) and not (i < len(merged) and merged[i][0] < end)

    found = ((kind, m) for kind, (hint, pattern) in FORMATS.items() if hint in text for m in pattern.finditer(text))
    runs = (("bare", m) for m in _RUN.finditer(text) if _random_run(m[0]))
    for kind, m in (*found, *runs):
        if free(*m.span()):
            insort(merged, m.span())
            yield kind, *m.span(), m[0].split(":", 1)[1] if kind == "url" else m[0]


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("random", pa.bool_())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        counts, bases, candidates = {k: [] for k in BASE}, [], []
        for text in b["text"].to_pylist():
            found = list(base_spans(text or ""))
            for k in BASE:
                counts[k].append(sum(f[0] == k for f in found))
            base = sorted((s, KINDS.index(k), e) for k, s, e, _ in found)
            bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base))
            found += further_spans(text or "", [(s, e) for _, s, e, _ in found])
            hashes = [xxhash.xxh3_128_intdigest(v.encode("utf-8", "surrogatepass")) for *_, v in found]
            candidates.append([
                {"kind": KINDS.index(k), "start": s, "end": e, "h1": _signed(h >> 64), "h2": _signed(h & (1 << 64) - 1), "random": looks_live(v)}
                for (k, s, e, v), h in zip(found, hashes, strict=True)
            ])
        columns = [b["doc_id"], b["owner"], b["repo"], *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(bases, pa.string()), pa.array(candidates, pa.list_(_CANDIDATE))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "owner", "repo", *(f"n_{k}" for k in BASE), "base", "candidates"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(h1, h2, n, repos, owners) of (h1, h2, owner, repo): how often a value
    stands anywhere, and in how many repositories and by how many owners.

    Each step counts the groups of the one before, so a value that everybody
    copies is combined before it is shuffled. Null is an owner, and a
    repository, of its own.
    """
    by_repo = candidates.groupBy("h1", "h2", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("h1", "h2", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text", wide: int = 5) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) per row.

    ``base`` names the matches of the base kinds as ``kind:start:end`` (code
    points, end exclusive) by start, then kind. ``spans`` are all spans in that
    order as (start, kind, end, verdict, owners, repos): the base ones, and
    those of the other kinds (credential formats, random-looking runs outside
    of them) that are not examples. Verdicts come from the whole corpus: the
    hash of a value is counted by distinct repositories and owners. A value of
    ``wide`` owners or more, or one that looks like no random string, is an
    ``example``; of one owner it is ``live``, else ``shared``. Base spans stay
    whatever their verdict.

    Texts are read once, and only hashes and spans are shuffled; occurrences of
    a common value are dealt over many tasks to get their verdict. A
    repository belongs to its owner: equal names under two owners are two.

    Null text is empty; a text without a span has empty ``base`` and
    ``spans``. Each row gets a row, repeated rows and null ids included. Null
    owners are one owner. Other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    candidate = "array<struct<kind: int, start: bigint, end: bigint, h1: bigint, h2: bigint, random: boolean>>"
    scanned = d.mapInArrow(_scan, f"doc_id {kind}, owner string, repo string, n_assign long, n_access long, n_hex long, base string, candidates {candidate}")
    scanned = stash(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = scanned.select("row", "owner", "repo", F.inline("candidates"))
    values = stash(ownership(each), "values")
    total = values.agg(F.sum("n")).first()[0] or 0
    judged = salted_join(each.drop("owner", "repo"), values, ["h1", "h2"], ["row", "start"], total)
    verdict = F.when(~F.col("random") | (F.col("owners") >= wide), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = judged.withColumn("verdict", verdict).where((F.col("kind") < len(BASE)) | (F.col("verdict") != "example"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repos"))).alias("spans"))
    named = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform("spans", lambda s: s.withField("kind", F.get(named, s["kind"])))
    return scanned.drop("owner", "repo", "candidates").join(spans, "row", "left").drop("row").withColumn("spans", F.coalesce(shown, F.array()))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
