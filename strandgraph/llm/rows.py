"""Row order and row identity that hold across jobs, also with null or repeated ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.store import stash


def text_hashes(x) -> tuple:
    """Two 64-bit hashes of a column with seeds of their own.

    The constant goes first: ``xxhash64`` seeds each argument with the hash of
    those before it, so a constant after the text would make the second hash a
    function of the first.
    """
    return F.xxhash64(x), F.xxhash64(F.lit(1), x)


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers, never null and never repeated."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    ids = docs.select(F.col(id_col).alias("k")).groupBy("k").count()
    odd = ids.where("k is null or count > 1").limit(1).count()
    return odd == 0


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "ord") -> DataFrame:
    """``docs`` with a long column ``name`` that rises with the id.

    Where ids are unique, it is the id. Else it numbers the distinct
    (id, text) pairs by id, null ids last, then by text hash: rows that repeat
    both share one number and so count as one document; rows that share only
    the id are documents of their own.
    """
    if unique_ids(docs, id_col):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    a, b = text_hashes(F.col(text_col))
    key = docs.select(F.col(id_col).alias("i"), a.alias("a"), b.alias("b")).distinct()
    key = stash(key.orderBy(F.col("i").asc_nulls_last(), "a", "b").withColumn("number", F.monotonically_increasing_id()), "order")
    a, b = text_hashes(docs[text_col])
    same = docs[id_col].eqNullSafe(key["i"]) & (a == key["a"]) & (b == key["b"])
    return docs.join(key, same).select(*[docs[c] for c in docs.columns], key["number"].alias(name))


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord long, doc_id, text), ord as ``numbered`` gives it."""
    return numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("ord", "doc_id", "text")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``name`` is not in ``numbers`` (ord long), without that column."""
    return docs.join(numbers, docs[name] == numbers["ord"], "left_anti").drop(name)


#: No task of a salted join gets more than about one in SHARES of all rows by one key.
SHARES = 1000


def salted_join(left: DataFrame, per_key: DataFrame, keys: list[str], spread: list[str], total: int) -> DataFrame:
    """Join ``left`` with a written table of one row, and the number ``n`` of
    left rows (``total`` in all), per key; ``n`` goes.

    A key with more than one in SHARES of all rows is dealt over as many salts,
    by a hash of the columns ``spread``, as it has such shares. Fewer than
    SHARES keys are that common, which bounds what is broadcast, and the salted
    rows add less than SHARES in all.
    """
    dealt = per_key.withColumn("parts", F.ceil(F.col("n") * SHARES / F.lit(total or 1)).cast("int")).drop("n")
    common = F.broadcast(dealt.where("parts > 1").select(*keys, "parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("parts")), F.lit(0)).cast("int")
    salted = left.join(common, keys, "left").withColumn("salt", salt).drop("parts")
    right = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return salted.join(right, [*keys, "salt"]).drop("salt")


def running(df: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """``df``, written, with ``before``: the sum of column ``n`` over the rows with smaller ``keys``.

    Keys are unique. Rows are sorted in ranges; sums within a range and one
    total per range (as many as there are partitions) give the prefix sums, so
    no task sees all rows.
    """
    held = stash(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    totals = held.groupBy("part").agg(F.sum(n).alias("all"))
    ahead = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))
    inner = Window.partitionBy("part").orderBy(*keys)
    return held.join(F.broadcast(ahead), "part").withColumn("before", F.col("ahead") + F.sum(n).over(inner) - F.col(n)).drop("part", "ahead")
