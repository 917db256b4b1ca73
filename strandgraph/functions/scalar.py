"""Scalar rules as Columns: names, digests, predicates, JSON paths, text tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names and text -------------------------------------------------------


def split_qualified(name: Column | str) -> Column:
    """Parts of a dotted name; dots within double quotes do not split, quotes go and ``""`` is ``"``."""
    parts = F.regexp_extract_all(_col(name), F.lit(r'"(?:[^"]|"")*"|[^.]+'), F.lit(0))
    clean = lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)
    return F.transform(F.transform(parts, lambda p: F.trim(p)), clean)


def before(text: Column | str, mark: str) -> Column:
    """What stands before the first ``mark``; the whole text without one."""
    return F.substring_index(_col(text), mark, 1)


def three_parts(text: Column | str, mark: str = "::") -> Column:
    """First part, middle, last part, cut at the first and at the last mark; null with fewer than two."""
    p = f"^(.+?){mark}(.+){mark}(.+)$"
    t = _col(text)
    return F.when(t.rlike(p), F.array(*[F.regexp_extract(t, p, i) for i in (1, 2, 3)]))


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


#: Characters that Markdown reads as markup, and the most digits that open a list.
MARKUP, LIST_DIGITS = "\\`*_#+-!|(){}[]", 9


def markdown_safe(text: Column | str) -> Column:
    """One line with markup characters escaped, for Markdown and HTML.

    Line ends and tabs become visible; a full stop is escaped only where
    digits before it would open a list, so decimals and dates stay readable.
    """
    t = F.regexp_replace(_col(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"^[ \t]+|[ \t]+$", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, "([" + "".join(f"\\{c}" for c in MARKUP) + "])", r"\\$1")
    t = F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    number = F.substring_index(t, ".", 1)
    after = F.substr(t, F.length(number) + 2, F.lit(1))
    opens = F.contains(t, F.lit(".")) & (F.length(number) <= LIST_DIGITS) & number.rlike("^[0-9]+$") & after.isin("", " ")
    return F.when(opens, F.concat(number, F.lit("\\."), F.substr(t, F.length(number) + 2, F.length(t)))).otherwise(t)


def is_numeric_picture(pic: Column | str) -> Column:
    """Whether a picture clause holds digits alone (sign, scale and repeats allowed)."""
    return F.upper(F.trim(_col(pic))).rlike(r"^S?[9VP]+(\(\d+\))?([9VP](\(\d+\))?)*$")


# --- digests --------------------------------------------------------------


def digest(columns: list[str], length: int = 64) -> Column:
    """Leading hex digits of SHA-256 over the values, joined by unit separators; null is empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, length)


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def sorted_map(m: Column | str) -> Column:
    """A map with its keys in order, so that equal maps give equal JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(_col(m))))


def stable_bucket(key: Column | str, buckets: int = 100) -> Column:
    return (F.conv(F.substring(F.sha2(_col(key), 256), 1, 8), 16, 10).cast("long") % buckets).cast("long")


#: The ways of choosing keys.
BY_LIST, BY_BUCKET, BY_EITHER = "EXPLICIT_ALLOWLIST", "PACKAGE_HASH_BUCKET", "ALLOWLIST_OR_HASH_BUCKET"


def canary(denied: Column, allowed: Column, key: Column, percent: int, strategy: Column) -> Column:
    """(selected, bucket, reason, matched_allowlist, matched_denylist) of a key.

    Denied keys are never selected and have no bucket. Otherwise the strategy
    says whether the allowlist counts, the bucket (of a hundred, ``percent`` of
    which are in), either, or neither; the allowlist counts first.
    """
    listed, hashed = strategy.isin(BY_LIST, BY_EITHER), strategy.isin(BY_BUCKET, BY_EITHER)
    listed, hashed = F.coalesce(listed, F.lit(False)), F.coalesce(hashed, F.lit(False))
    bucket = F.when(hashed & ~denied, stable_bucket(key, 100))
    # The reasons.
    reason = (
        F.when(denied, "denylisted").when(listed & allowed, "allowlisted").when(hashed & (bucket < percent), "bucket_selected")
        .when(hashed, "bucket_not_selected").when(listed, "not_allowlisted").otherwise("strategy_never_selects_without_match")
    )
    return F.struct(
        reason.isin("allowlisted", "bucket_selected").alias("selected"), bucket.alias("bucket"), reason.alias("reason"),
        F.when(denied, allowed).otherwise(listed & allowed).alias("matched_allowlist"), denied.alias("matched_denylist"),
    )


# --- predicates -----------------------------------------------------------


def _bare(text: Column) -> Column:
    """Text without the parentheses around all of it, however many."""

    def step(p, _):
        depths = F.aggregate(
            F.split(F.left(p, F.length(p) - 1), ""), F.struct(F.lit(0).alias("d"), F.lit(False).alias("closed")),
            lambda s, c: F.struct((s["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (s["closed"] | ((c == ")") & (s["d"] == 1))).alias("closed")),
        )
        whole = F.startswith(p, F.lit("(")) & F.endswith(p, F.lit(")")) & ~depths["closed"]
        return F.when(whole, F.trim(F.substring(p, 2, F.length(p) - 2))).otherwise(p)

    t = F.trim(text)
    opening = F.length(F.regexp_replace(F.regexp_extract(t, r"^[( ]*", 0), " ", ""))
    return F.aggregate(F.sequence(F.lit(0), opening), t, step)


def conjuncts(predicate: Column | str, strip_where: bool = False) -> Column:
    """The parts of a predicate between top-level ANDs; quoted text (with
    doubled quotes) and what is in parentheses stay whole, parentheses around
    all of it or all of a part go. Null for null or blank text."""
    p = F.trim(_col(predicate))
    if strip_where:
        p = F.regexp_replace(p, r"(?i)^where\s+", "")
    tokens = F.regexp_extract_all(_bare(p), F.lit(r"(?is)'(?:[^']|'')*'|'.*| and |[()]|[^'() ]+| "), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("now"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(s, t):
        ends = (F.lower(t) == " and ") & (s["d"] == 0)
        return F.struct(
            (s["d"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("d"), F.when(ends, "").otherwise(F.concat(s["now"], t)).alias("now"),
            F.when(ends, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]).alias("parts"),
        )

    parts = F.aggregate(tokens, start, step, lambda s: F.concat(s["parts"], F.array(s["now"])))
    return F.when(p != "", F.transform(parts, _bare))


_BLANKS = " \t\n\r\x0b\x0c"


def comparisons(parts: Column) -> Column:
    """(column, literal, number) of each ``column = literal``; number is null for quoted text, in which doubled quotes are one.

    The column is a name, in double quotes or not. One parenthesis that was
    left open before it, or closed after the literal, does not count.
    """
    blanks = F.lit(_BLANKS)
    # A transform a step, as what a lambda names twice is worked out twice.
    x = F.transform(parts, lambda x: F.trim(x, blanks))
    x = F.transform(x, lambda x: F.when(F.startswith(x, F.lit("(")), F.substr(x, F.lit(2), F.length(x))).otherwise(x))
    x = F.transform(x, lambda x: F.when(F.endswith(x, F.lit(")")), F.left(x, F.length(x) - 1)).otherwise(x))
    x = F.transform(x, lambda x: F.struct(F.substring_index(x, "=", 1).alias("l"), x.alias("x")))
    x = F.filter(x, lambda s: F.length(s["l"]) < F.length(s["x"]))
    x = F.transform(x, lambda s: F.struct(F.trim(s["l"], blanks).alias("l"), F.trim(F.substr(s["x"], F.length(s["l"]) + 2, F.length(s["x"])), blanks).alias("r")))
    around = lambda c, mark: (F.length(c) > 1) & F.startswith(c, F.lit(mark)) & F.endswith(c, F.lit(mark))
    within = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
    x = F.transform(x, lambda s: F.struct(
        F.when(around(s["l"], '"'), within(s["l"])).otherwise(s["l"]).alias("name"), F.when(around(s["r"], "'"), within(s["r"])).alias("inner"), s["r"].alias("r")
    ))
    single = lambda s: F.contains(F.replace(s["inner"], F.lit("''"), F.lit("")), F.lit("'"))
    good = lambda s: s["name"].rlike(r"^[A-Za-z_]\w*$") & F.coalesce(~single(s), s["r"].rlike(r"^[+-]?\d+([.]\d+)?$"))
    return F.transform(F.filter(x, good), lambda s: F.struct(
        F.upper(s["name"]).alias("column"), F.coalesce(F.replace(s["inner"], F.lit("''"), F.lit("'")), s["r"]).alias("literal"), F.when(s["inner"].isNull(), s["r"].try_cast("double")).alias("number")
    ))


def predicate_status(parts: Column, found: Column) -> Column:
    """EXACT if every part is a comparison with a literal, PARTIAL if some are, else UNRESOLVED."""
    n = F.coalesce(F.size(found), F.lit(0))
    return F.when(parts.isNull() | (n <= 0), "UNRESOLVED").when(n == F.size(parts), "EXACT").otherwise("PARTIAL")


def row_matches(row: Column | str, found: Column) -> Column:
    """Whether a map of text satisfies all comparisons: as numbers where the
    literal is one (text that is none does not match), else as trimmed text.
    The map's names are compared in upper case without blanks at their ends."""
    entries = F.map_entries(_col(row))

    def holds(c):
        value = F.get(F.filter(entries, lambda e: F.upper(F.trim(e["key"])) == c["column"]), F.lit(0))["value"]
        return F.coalesce(F.when(c["number"].isNotNull(), F.trim(value).try_cast("double") == c["number"]).otherwise(F.trim(value) == F.trim(c["literal"])), F.lit(False))

    return F.forall(found, holds)


# --- JSON and tokens ------------------------------------------------------


def json_path(text: Column | str, path: str) -> tuple[Column, Column]:
    """(found, value as text): a JSON null is found and has a null value."""
    v = F.try_variant_get(F.try_parse_json(_col(text)), path, "variant")
    return v.isNotNull(), F.try_variant_get(F.try_parse_json(_col(text)), path, "string")


def strict_object(text: Column | str) -> Column:
    """A JSON object as a variant; null for other values, repeated keys and text that is no JSON."""
    v = F.try_parse_json(_col(text))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def numbers(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def iso_dates(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))


def ambiguous_date(text: Column | str) -> Column:
    """Whether a dd/mm or mm/dd date is one either way round, with different days."""
    p = r"^(\d{1,2})/(\d{1,2})/\d{4}$"
    a, b = (F.regexp_extract(_col(text), p, i).try_cast("int") for i in (1, 2))
    return F.coalesce((a != b) & a.between(1, 12) & b.between(1, 12), F.lit(False))


def double_quoted(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit('"([^"]*)"'), F.lit(1))


def has_word(text: Column | str, word: Column | str) -> Column:
    """Whether a word stands in a text between word boundaries, taken literally."""
    return _col(text).rlike(F.concat(F.lit(r"(?<!\w)\Q"), _col(word), F.lit(r"\E(?!\w)")))


# --- time and numbers -----------------------------------------------------


def utc_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Also of times without a zone, which count as the session's."""
    return (F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))) / 1e6


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def backoff_seconds(attempt: Column, base: float = 0.5, limit: float = 30.0) -> Column:
    return F.least(F.lit(limit), F.lit(base) * F.pow(F.lit(2.0), attempt))


# --- bytes ----------------------------------------------------------------


def encoding_of(content: Column | str, declared: Column | str | None = None) -> Column:
    """UTF-8 with a mark, then what was declared, then plain UTF-8; null where bytes settle nothing."""
    c = _col(content)
    marked = F.hex(F.substring(c, 1, 3)) == "EFBBBF"
    valid = F.is_valid_utf8(c.cast("string"))
    high = F.hex(c).rlike(r"^(..)*[89A-F].")
    out = F.when(marked, F.when(valid, "UTF-8-SIG"))
    if declared is not None:
        d = F.upper(F.trim(_col(declared)))
        out = out.when(d.isNotNull() & (d != "AUTO") & (d != ""), F.when((d != "UTF-8") | valid, d))
    return out.when(~high, "UTF-8").when(valid, "UTF-8")
