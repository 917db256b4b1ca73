"""Rules by regular expression, met through the literals that their patterns require."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strandgraph.store import stash

try:  # the parser of Python's own module; its place has changed once
    from re import _constants as _c
    from re import _parser
except ImportError:
    import sre_constants as _c
    import sre_parse as _parser

#: Length of the pieces of literals by which texts and rules meet.
GRAM = 3
#: Rules without a literal that are sent to all tasks at once.
BLOCK = 10_000
_UNSAFE = _c.SRE_FLAG_IGNORECASE | _c.SRE_FLAG_VERBOSE | _c.SRE_FLAG_LOCALE


def _required(sequence) -> set[str] | None:
    """Strings of which every text that matches holds at least one; the set whose
    shortest is the longest, or None if no such set is plain to see."""
    candidates, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            candidates.append({run})
        run = ""

    for op, what in sequence:
        if op is _c.LITERAL:
            run += chr(what)
            continue
        if op is _c.SUBPATTERN and not what[1] and not what[2] and all(o is _c.LITERAL for o, _ in what[3]):
            run += "".join(chr(w) for _, w in what[3])
            continue
        close()
        if op is _c.SUBPATTERN and not what[1] & _UNSAFE:
            inner = _required(what[3])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", _c.MAX_REPEAT)) and what[0] >= 1:
            inner = _required(what[2])
        elif op is getattr(_c, "ATOMIC_GROUP", None):
            inner = _required(what)
        elif op is _c.BRANCH:
            each = [_required(x) for x in what[1]]
            inner = set().union(*each) if all(each) else None
        else:
            inner = None
        if inner:
            candidates.append(inner)
    close()
    return max(candidates, key=lambda s: min(map(len, s)), default=None)


def required_literals(pattern: str | None) -> list[str] | None:
    """Literals of GRAM or more characters of which a match holds at least one, or None.

    Patterns that ignore case, or that Python cannot read (they are Java's),
    give None: such a rule is tried on every text.
    """
    try:
        tree = _parser.parse(pattern or "")
    except Exception:  # noqa: BLE001 - whatever the parser says, the rule is then tried everywhere
        return None
    if tree.state.flags & _UNSAFE:
        return None
    found = _required(tree)
    return sorted(found) if found and min(map(len, found)) >= GRAM and all(ord(c) < 0x10000 for f in found for c in f) else None


@F.pandas_udf(ArrayType(StringType()))
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literals)


def _grams(text: Column) -> Column:
    n = F.length(text) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, GRAM))))


def by_rules(items: DataFrame, rules: DataFrame, text: Column, block: int = BLOCK) -> DataFrame:
    """Every item with each rule (rule_id, tag, pattern, confidence) whose pattern its text holds.

    A pattern's required literals are found from its syntax; each is known by
    that piece of GRAM characters of it that the fewest texts hold, and only
    texts with the piece, then with the literal, are searched for the pattern.
    So work follows the texts that hold a rule's rarest piece, not rules times
    texts. Rules without such a literal are tried on every text, ``block`` of
    them at a time. Any number of rules is taken.

    A null text or pattern matches nothing. Repeated items, and repeated
    rules, stay as they are.
    """
    numbered = stash(rules.where(F.col("pattern").isNotNull()).withColumn("rule_", F.monotonically_increasing_id()).withColumn("literals_", _literals("pattern")), "rules")
    held = stash(items.withColumns({"text_": text, "item_": F.monotonically_increasing_id()}).where("text_ is not null"), "items")
    exact = numbered.where("literals_ is not null")
    factors = exact.select("rule_", F.explode("literals_").alias("literal")).withColumn("gram", F.explode(_grams(F.col("literal"))))
    wanted = stash(factors.select("gram").distinct(), "grams")
    places = stash(held.select("item_", F.explode(_grams(F.col("text_"))).alias("gram")).join(wanted, "gram"), "places")
    often = places.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = factors.join(often, "gram", "left").groupBy("rule_", "literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    postings = rarest.where("g.n > 0").select("rule_", "literal", "g.gram")
    columns = [*[F.col(c) for c in items.columns], *[F.col(f"r_.{c}") for c in rules.columns]]
    packed = F.struct(*rules.columns).alias("r_")
    near = places.join(postings, "gram").select("item_", "rule_", "literal")
    near = near.join(held.select("item_", "text_"), "item_").where(F.contains("text_", F.col("literal"))).select("item_", "rule_").distinct()
    met = near.join(held, "item_").join(exact.select("rule_", packed), "rule_").where(F.rlike("text_", F.col("r_.pattern"))).select(*columns)
    loose = stash(numbered.where("literals_ is null").select("rule_", packed), "loose")
    parts = -(-loose.count() // block)
    for part in range(parts):  # hashed evenly, so a part is about a block
        some = loose.where(F.pmod(F.xxhash64("rule_"), F.lit(parts)) == part)
        met = met.unionByName(held.join(F.broadcast(some), F.rlike("text_", F.col("r_.pattern"))).select(*columns))
    return met
