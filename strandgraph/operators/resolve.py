"""Names resolved by unique match: qualified name first, then simple name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Upper case without white space at the ends."""
    return F.upper(F.regexp_replace(name, r"^\s+|\s+$", ""))


def resolve_names(tokens: DataFrame, index: DataFrame, token: str, scope: list[str], qualified: str, simple: str, target: str, normalise: bool = True) -> DataFrame:
    """``tokens`` with (target, resolution).

    Within a scope a token is QUALIFIED if one entry has it as qualified name,
    else SIMPLE if one entry has it as simple name. Several entries are
    AMBIGUOUS, and an ambiguous qualified name is not tried as a simple one;
    none is UNRESOLVED. The index is counted per key before it is joined, so
    no token meets more than one row of it.
    """
    norm = normal_name if normalise else lambda c: c
    t = tokens.withColumn("k_", norm(F.col(token)))

    def keyed(name: str, tag: str) -> DataFrame:
        return index.where(F.col(name).isNotNull()).groupBy(*[F.col(s).alias(f"{s}_{tag}") for s in scope], norm(F.col(name)).alias(f"k_{tag}")).agg(F.count("*").alias(f"n_{tag}"), F.min(target).alias(f"t_{tag}"))

    def on(tag: str, table: DataFrame) -> Column:
        same = F.col("k_") == table[f"k_{tag}"]
        for s in scope:
            same = same & (tokens[s] == table[f"{s}_{tag}"])
        return same

    q, s = keyed(qualified, "q"), keyed(simple, "s")
    out = t.join(q, on("q", q), "left").join(s, on("s", s), "left")
    status = F.when(F.col("n_q") == 1, "QUALIFIED").when(F.col("n_q") > 1, "AMBIGUOUS").when(F.col("n_s") == 1, "SIMPLE").when(F.col("n_s") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    found = F.when(F.col("n_q") == 1, F.col("t_q")).when(F.col("n_q").isNull() & (F.col("n_s") == 1), F.col("t_s"))
    return out.select(*[t[c] for c in tokens.columns], found.alias("target"), status.alias("resolution"))


def terminal_name(name: Column) -> Column:
    """The last part of a dotted name, a dot within double quotes not counting; quotes go."""
    last = F.regexp_extract(name, r'("(?:[^"]|"")*"|[^."]+)\s*$', 1)
    return F.when(F.startswith(last, F.lit('"')), F.replace(F.substr(last, F.lit(2), F.length(last) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(last))
