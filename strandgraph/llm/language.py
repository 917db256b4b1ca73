"""Language by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.words import chunks, plain_words
from strandgraph.store import stash

#: Languages that a country's address suffix speaks for, most
#: spoken first. They only start a suffix off; its pages' own evidence adds to it.
SUFFIX_LANGUAGES = {
    "ad": "ca es fr", "ar": "es", "at": "de", "au": "en", "be": "nl fr de", "bg": "bg", "bo": "es", "br": "pt", "by": "ru be", "ca": "en fr", "ch": "de fr it", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cz": "cs",
    "de": "de", "dk": "da", "do": "es", "ec": "es", "ee": "et", "es": "es ca", "fi": "fi sv", "fr": "fr", "gr": "el", "gt": "es", "hn": "es", "hr": "hr", "hu": "hu", "ie": "en ga", "il": "he", "in": "en hi", "ir": "fa", "is": "is", "it": "it",
    "jp": "ja", "kr": "ko", "li": "de", "lt": "lt", "lu": "fr de", "lv": "lv", "ma": "ar fr", "mc": "fr", "mx": "es", "nl": "nl", "no": "no nb", "nz": "en", "pa": "es", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "rs": "sr",
    "ru": "ru", "se": "sv", "si": "sl", "sk": "sk", "sn": "fr", "sv": "es", "th": "th", "tn": "ar fr", "tr": "tr", "tw": "zh", "ua": "uk ru", "uk": "en", "us": "en", "uy": "es", "ve": "es", "vn": "vi", "za": "en af",
}

SLOTS = 1 << 14
#: The label that stands for all labels without a column of their own.
OTHER = "und"


@dataclass
class TextModel:
    """Log likelihoods of hashed byte trigrams, one column per language."""

    languages: list[str]
    logs: np.ndarray

    def known(self, label: Column) -> Column:
        """The language that a label names: OTHER, if the model has it, for labels without a column."""
        label = F.lower(F.trim(label))
        label = F.when(label != "", label)
        return F.when(label.isin(self.languages), label).when(label.isNotNull() & F.lit(OTHER in self.languages), F.lit(OTHER))

    def least_mean(self, limits: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The ``limits`` for texts of so many trigrams, a row per text: three standard errors lower, as the mean of few trigrams varies."""
        p = np.exp(self.logs.astype(np.float64))
        p /= p.sum(axis=0)
        deviation = np.sqrt((p * self.logs**2).sum(axis=0) - (p * self.logs).sum(axis=0) ** 2)
        return limits - 3 * deviation / np.sqrt(np.maximum(grams, 1))[:, None]


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the byte trigrams of words with a letter, each word between blanks."""
    words = [w for w in plain_words(text) if not w.isdigit()]
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    return (b[:-2] * 9973 + b[1:-1] * 131 + b[2:]) % SLOTS


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, languages: int = 64, always: Sequence[str] = ()) -> TextModel:
    """A model from about ``rows_per_language`` different texts of each of the
    ``languages`` commonest labels and of those ``always`` kept; trigrams are
    counted in the tasks.

    All other labels together are one more language, OTHER, so that a column
    of dirty labels makes the model no larger. The sample's bound is
    ``rows_per_language`` times the languages. A text is in it if its hash is
    under a limit that follows from the number of different texts, so no task
    gathers a language's rows, and copies count once. Labels are compared in
    lower case without blanks; null and empty ones are left out.
    """
    lang = F.lower(F.trim(F.col(lang_col)))
    rows = labelled.select(lang.alias("lang"), F.col(text_col).alias("text")).where("lang <> '' and text is not null").withColumn("h", F.xxhash64("text"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang").collect()
    own = sorted({r.lang for r in common} | set(always))
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(OTHER))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()  # as many rows as the model has languages
    names = sorted(r.lang for r in found)
    if not names:
        return TextModel([], np.zeros((SLOTS, 0), np.float32))
    bounds = [x for r in found for x in (F.lit(r.lang), F.lit(min((1 << 63) - 1, rows_per_language * (1 << 64) // r.texts - (1 << 63))))]
    sample = rows.where(F.col("h") <= F.try_element_at(F.create_map(*bounds), F.col("lang"))).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {}
            for n, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                at.setdefault(n, np.zeros(SLOTS, np.int64))
                at[n] += np.bincount(trigrams(t), minlength=SLOTS)
            for n, c in at.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(some), pa.string()), pa.array(some), pa.array(c[some])], ["lang", "slot", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    total = np.full((SLOTS, len(names)), 0.05)
    for r in counts:
        total[r.slot, names.index(r.lang)] += r.n
    return TextModel(names, np.log(total / total.sum(axis=0)).astype(np.float32))


def text_limits(scored: DataFrame, model: TextModel, weight: int, tail: float = 0.05, times: float = 3.0, spread: float = 0.5) -> np.ndarray:
    """The mean log likelihood under which a long text is in none of a model's
    languages, by language, from all rows of ``score`` that declare one.

    A text's score is the mean log likelihood of its trigrams under its label.
    The limit is ``times`` as far under the label's median score as the lowest
    ``tail`` of its texts begins, which counts as ``spread`` at least; so
    wrong labels and junk do not move it while they are fewer than the tail.
    """
    at = F.create_map(*[x for i, n in enumerate(model.languages) for x in (F.lit(n), F.lit(i))])
    mean = F.get("logs", F.element_at(at, F.col("known"))) / F.least("grams", F.lit(weight))
    known = scored.where("known is not null and grams > 0").select("known", mean.alias("score"))
    found = known.groupBy("known").agg(F.percentile_approx("score", [0.5, tail], 10_000).alias("q")).collect()  # a row a language
    by_name = {r.known: r.q[0] - times * max(spread, r.q[0] - r.q[1]) for r in found}
    return np.array([by_name.get(x, -np.inf) for x in model.languages])


#: Markup that opens here hides what follows up to its end: comments, scripts and styles with their content, tags.
_OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<hidden>script|style)\b|[a-z/!?])", re.IGNORECASE | re.ASCII)
_CLOSING = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE | re.ASCII) for x in ("script", "style")}
_ENTITY = re.compile(r"&#?[a-z0-9]{1,32};", re.IGNORECASE | re.ASCII)


def visible_text(html: str | None) -> str:
    """The text of a page, markup and entities as blanks, in one pass.

    What opens and is not closed (a tag, a comment, a script or a style) goes
    on to the end of the page, so the end is looked for once at most. A ``<``
    that opens nothing is text.
    """
    html, out, at = html or "", [], 0
    while at < len(html):
        m = _OPENING.search(html, at)
        out.append(html[at : m.start() if m else len(html)])
        if m is None:
            break
        if m["comment"]:
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else len(html)
        elif m["hidden"]:
            close = _CLOSING[m["hidden"].lower()].search(html, m.end())
            at = close.end() if close else len(html)
        else:
            end = html.find(">", m.end() - 1)
            at = end + 1 if end >= 0 else len(html)
    return _ENTITY.sub(" ", " ".join(out))


def mean_logs(model: TextModel, slots: np.ndarray) -> np.ndarray:
    """Mean log likelihoods of trigrams, a block of them at a time."""
    blocks = range(0, len(slots), 1 << 14)
    return sum(model.logs[slots[i : i + (1 << 14)]].sum(axis=0, dtype=np.float64) for i in blocks) / len(slots)


def _log_likelihoods(model: TextModel, weight: int, read: Callable[[str | None], str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            scores, counts = [], []
            for t in b["text"].to_pylist():
                slots = trigrams(read(t))
                counts.append(len(slots))
                scores.append((mean_logs(model, slots) * min(len(slots), weight)).tolist() if len(slots) else [0.0] * len(model.languages))
            keep = [b[n] for n in b.schema.names if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.int64())], [*names, "logs", "grams"])

    return run


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def host_priors(evidence: DataFrame, languages: list[str], strength: float) -> DataFrame:
    """(host, domain, suffix, prior, mass, own) with ``own`` the host's summed responsibilities.

    Responsibilities add up per host, then hosts to domains, domains to
    suffixes and suffixes to one root: each level is smoothed towards the one
    above with ``strength`` rows' weight, and a country suffix adds that much,
    shared by its languages (each half as much as the one before). Sums combine
    before each shuffle.
    """
    n = len(languages)
    sums = [F.sum(F.get("resp", F.lit(i))).alias(f"s{i}") for i in range(n)]
    up = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    pack = F.array(*[F.col(f"s{i}") for i in range(n)])
    hosts = stash(evidence.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*up)
    suffixes = domains.groupBy("suffix").agg(*up)
    root = suffixes.agg(*up).first()
    base = np.array([x or 0.0 for x in root]) + 1.0
    p0 = F.array(*[F.lit(float(x)) for x in base / base.sum()])
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smooth(own, above, extra=None):
        total = _add(own, F.transform(above, lambda x: x * strength))
        total = _add(total, extra) if extra is not None else total
        return F.transform(total, lambda x: x / mass(total))

    def shares(spoken: str) -> list[float]:
        each = {x: 0.5**i for i, x in enumerate(x for x in spoken.split() if x in languages)}
        return [strength * each.get(x, 0.0) / (sum(each.values()) or 1.0) for x in languages]

    spoken = F.create_map(*[x for k, v in SUFFIX_LANGUAGES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in shares(v)]))])
    extra = F.coalesce(F.try_element_at(spoken, F.col("suffix")), F.array(*[F.lit(0.0)] * n))
    suffixes = suffixes.select(F.col("suffix").alias("x_"), smooth(pack, p0, extra).alias("p1"))
    domains = domains.join(suffixes, F.col("suffix").eqNullSafe(F.col("x_")))
    domains = domains.select(F.col("domain").alias("y_"), F.col("suffix").alias("x_"), smooth(pack, F.col("p1")).alias("p2"))
    hosts = hosts.join(domains, F.col("domain").eqNullSafe(F.col("y_")) & F.col("suffix").eqNullSafe(F.col("x_")))
    return hosts.select("host", "domain", "suffix", pack.alias("own"), "p2")


def declared_table(scored: DataFrame, languages: list[str], weight: float, strength: float) -> np.ndarray:
    """P(declared d | language l), a row per d, from all rows that declare one of ``languages``.

    Rows count for the languages as their text alone says. Each language
    starts with ``strength`` rows of which the share ``weight`` declares it and
    the others share the rest, so without rows that is the table. At most a
    row per language comes to the driver.
    """
    n = len(languages)
    sums = [F.sum(F.get("own", F.lit(i))).alias(f"s{i}") for i in range(n)]
    known = scored.where(F.col("known").isNotNull() & (F.col("grams") > 0)).withColumn("own", _posterior(F.col("logs")))
    counts = np.full((n, n), strength * (1 - weight) / max(1, n - 1))
    np.fill_diagonal(counts, strength * (weight if n > 1 else 1.0))
    for r in known.groupBy("known").agg(*sums).collect():
        counts[languages.index(r.known)] += [r[f"s{i}"] or 0.0 for i in range(n)]
    return counts / counts.sum(axis=0)


def score(rows: DataFrame, model: TextModel, keys: list[str], weight: int, read: Callable[[str | None], str | None] = lambda x: x) -> DataFrame:
    """``keys``, declared, host, domain and suffix with (logs, grams): the mean
    log likelihood of the text under each language, times at most ``weight``
    trigrams so that long texts are no surer than they should be. ``read``
    makes text of what the column text holds."""
    kept = rows.select(*keys, model.known(F.col("declared")).alias("known"), F.lower(F.trim("declared")).alias("declared"), "host", "domain", "suffix", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", logs array<double>, grams long"
    return stash(kept.mapInArrow(_log_likelihoods(model, weight, read), schema), "likelihoods")


def fuse(rows: DataFrame, model: TextModel, keys: list[str], strength: float = 5.0, declared_weight: float = 0.8, weight: int = 40, read: Callable[[str | None], str | None] = lambda x: x) -> DataFrame:
    """``keys`` plus (declared, text_language, language, confidence, grams) per row.

    What a declared language says is learned from all rows: see ``declared_table``.

    ``rows``: the keys and text (see ``read`` of ``score``), declared, host,
    domain and suffix. Each row weighs its text with its declared language (no
    evidence where it is null or unknown to the model). Those responsibilities
    give the hosts' priors, from which a row's own share is taken out again
    before it is judged. Ties go to the first language by name.
    """
    langs, n = model.languages, len(model.languages)
    if not n:
        return rows.select(*keys, "declared", *[F.lit(None).cast(t).alias(c) for c, t in (("text_language", "string"), ("language", "string"), ("confidence", "double"), ("grams", "long"))])
    scored = score(rows, model, keys, weight, read)
    said = _said(declared_table(scored, langs, declared_weight, strength), langs)
    scored = scored.withColumn("both", _add(F.col("logs"), said)).withColumn("resp", _posterior(F.col("both")))
    priors = stash(host_priors(scored, langs, strength), "priors").select(F.col("host").alias("h_"), F.col("domain").alias("d_"), F.col("suffix").alias("x_"), "own", "p2")
    same = F.col("host").eqNullSafe(F.col("h_")) & F.col("domain").eqNullSafe(F.col("d_")) & F.col("suffix").eqNullSafe(F.col("x_"))
    out = scored.join(priors, same)
    others = F.zip_with("own", "resp", lambda a, r: F.greatest(a - r, F.lit(0.0)))
    smoothed = _add(others, F.transform("p2", lambda x: x * strength))
    out = out.withColumn("post", _posterior(F.zip_with("both", smoothed, lambda a, p: a + F.log(p))))
    name = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.get(name, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return out.select(*keys, "declared", F.when(F.col("grams") > 0, best(F.col("logs"))).alias("text_language"), best(F.col("post")).alias("language"), F.array_max("post").alias("confidence"), "grams")


def _said(table: np.ndarray, languages: list[str]) -> Column:
    """Log evidence of column ``known`` by a ``declared_table``."""
    rows = F.create_map(*[x for d, row in zip(languages, np.log(table).tolist(), strict=True) for x in (F.lit(d), F.array(*[F.lit(y) for y in row]))])
    return F.coalesce(F.try_element_at(rows, F.col("known")), F.array(*[F.lit(0.0)] * len(languages)))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, declared, host, domain, suffix, text) of raw web pages, text
    still with its markup (see ``visible_text``); parts that are missing are null.

    The first html tag of a page declares its language. Every pattern takes
    one pass, whatever the page or address holds.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    tag = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html\b([^>]*)", 1)
    null = lambda c: F.when(c != "", c)
    last = lambda n: F.substring_index(host, ".", -n)
    domain = F.when(last(2).rlike(r"^[^.]+\.[^.]+$"), last(2))
    suffix = F.when(F.contains(host, F.lit(".")), null(last(1)))
    declared = null(F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})", 1)))
    return pages.select(F.col(id_col).alias("page_id"), declared.alias("declared"), null(host).alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col(html_col).alias("text"))


def identify_pages(pages: DataFrame, model: TextModel, **columns: str) -> DataFrame:
    """(page_id, declared, text_language, language, confidence, grams) per page.

    Null html has no text and null or unparsable addresses no host; such a
    page rests on what evidence is left, at last the prior of all pages.
    Repeated rows and null ids stay. Without languages in the model, language
    is null. Other columns are not read.
    """
    return fuse(page_evidence(pages, **columns), model, ["page_id"], read=visible_text)


def reject_languages(
    docs: DataFrame, model: TextModel, allowed: list[str] | None = None, least: float = 0.5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    strength: float = 5.0, declared_weight: float = 0.8, weight: int = 40,
) -> DataFrame:
    """The rows of ``docs`` in an allowed language (default: any of the model).

    A document goes if its text has no trigram of a word with a letter, if
    the most probable language is not allowed, if its probability is under
    ``least``, or if the text is less likely in that language than the limit
    of ``text_limits``: one of the languages is always the most probable, also
    for noise and for a language that no label names. The source stands for
    the host. One pass over the texts scores them; the table of declared
    languages, the limits and the source priors all come from those scores.
    Texts are scored once more while they pass, so no text is shuffled unless
    the table of source priors is large. Null source is a source of its own;
    null text goes; rows pass with all their columns, repeated rows as often
    as they are.
    """
    langs = model.languages
    if not langs:
        return docs.limit(0)
    known = docs[lang_col].cast("string"), docs[source_col].cast("string")
    nothing = F.lit(None).cast("string")
    whole = docs.where(docs[text_col].isNotNull())
    scored = score(whole.select(known[0].alias("declared"), known[1].alias("host"), nothing.alias("domain"), nothing.alias("suffix"), docs[text_col].alias("text")), model, [], weight)
    table = declared_table(scored, langs, declared_weight, strength)
    limits = text_limits(scored, model, weight)
    scored = scored.withColumn("resp", _posterior(_add(F.col("logs"), _said(table, langs))))
    priors = stash(host_priors(scored, langs, strength), "priors").select(F.col("host").alias("h_"), "own", "p2")
    joined = whole.join(priors, known[1].eqNullSafe(priors["h_"]))
    verdict = _verdict(model, np.log(table), limits, sorted(set(langs if allowed is None else allowed)), least, strength, weight)
    return joined.where(verdict(docs[text_col], model.known(known[0]), priors["own"], priors["p2"])).select(*[docs[c] for c in docs.columns])


def _normal(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _verdict(model: TextModel, said: np.ndarray, limits: np.ndarray, allowed: list[str], least: float, strength: float, weight: int):
    """Whether documents stay, from text, known declared language, and their source's sums and prior."""
    at = {x: i for i, x in enumerate(model.languages)}

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series, declared: pd.Series, own: pd.Series, above: pd.Series) -> pd.Series:
        grams, means = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(at)))
        for i, t in enumerate(texts):  # one text's trigrams at a time
            slots = trigrams(t)
            if len(slots):
                grams[i], means[i] = len(slots), mean_logs(model, slots)
        logs = means * np.minimum(grams, weight)[:, None] + np.stack([said[at[d]] if d in at else np.zeros(len(at)) for d in declared])
        prior = np.maximum(np.stack(own) - _normal(logs), 0) + strength * np.stack(above)
        post = _normal(logs + np.log(prior))
        best, each = post.argmax(axis=1), np.arange(len(post))
        right = np.isin(np.array(model.languages)[best], allowed) & (means[each, best] >= model.least_mean(limits, grams)[each, best])
        return pd.Series((grams > 0) & right & (post.max(axis=1) >= least))

    return keep
