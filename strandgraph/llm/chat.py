"""Preference pairs as one prompt and two masked completions, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def loss_mask(turns: Column, learn: str) -> Column:
    """``length:flag`` of each piece of the rendered turns, in characters; flag
    1 marks what is learned: the text and end marker of role ``learn``."""
    flag = lambda t: F.when(t["role"] == learn, "1").otherwise("0")
    piece = lambda t: F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), F.lit(":"), flag(t), F.lit(",1:0"))
    return F.array_join(F.transform(turns, piece), ",")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(pair, n_prefix, n_chosen, n_rejected, prompt, chosen, chosen_mask, rejected, rejected_mask).

    ``pair`` names the pair a turn's conversation is in, ``chosen`` tells
    whether it is the preferred side; one shuffle by pair brings both sides
    together, and a pair is as large as the two conversations it renders. The
    longest prefix of turns with equal role and text on both sides is rendered
    once as the prompt, the rest of each side as its completion.

    Turns stand in order of (turn, role, text), so repeated turns stay and ties
    are settled; null turns come first. A null role renders as ``unknown``, a
    null text as empty, and both match only their like. Turns without a pair or
    side take no part; pairs of which one side is missing have no preference
    and give no row. Sides that are wholly equal give a prompt and two empty
    completions. Other columns are not read.
    """
    t = turns.select(pair.alias("pair"), chosen.alias("side"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    t = t.where("pair is not null and side is not null")
    side = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("t"))))
    both = t.groupBy("pair").agg(side(F.col("side")).alias("a"), side(~F.col("side")).alias("b")).where("size(a) > 0 and size(b) > 0")
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    both = both.withColumn("parted", F.array_position(same, False))
    both = both.withColumn("n", F.when(F.col("parted") > 0, F.col("parted") - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return both.select(
        "pair", F.col("n").cast("long").alias("n_prefix"), (F.size("a") - F.col("n")).cast("long").alias("n_chosen"), (F.size("b") - F.col("n")).cast("long").alias("n_rejected"),
        render(F.slice("a", 1, F.col("n"))).alias("prompt"), render(rest("a")).alias("chosen"), loss_mask(rest("a"), learn).alias("chosen_mask"),
        render(rest("b")).alias("rejected"), loss_mask(rest("b"), learn).alias("rejected_mask"),
    )
