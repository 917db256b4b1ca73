"""Intermediate tables in the shared checkpoint folder.

Lineage is cut with written Parquet tables, never with ``localCheckpoint``: a
table in ``spark.checkpoint.dir`` outlives the executors that wrote it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a local master may leave that unset;
    it then gets a temporary folder that goes when Python ends.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="strandgraph-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths written since the outermost ``passing`` of this thread began, by its depth.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for scope in _SCOPES.get():
        scope.append(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.stash_path = path
    return held


def stash_dealt(df: DataFrame, name: str = "table") -> DataFrame:
    """``stash`` for tables of loops that grow with the input: joins with them
    are shuffled. Spark would broadcast each while it is small, and what many
    rounds of many joins broadcast adds up on the driver."""
    held = stash(df, name)
    out = held.hint("merge")
    out.stash_path = held.stash_path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many parts as Spark is set to, never
    fewer: for what is sorted wider than it is shuffled, which would spill in
    the parts that Spark sizes by what it has shuffled."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the store that its path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a table that ``stash`` gave and that no later step reads."""
    delete_path(df.sparkSession, df.stash_path)


@contextmanager
def passing(spark: SparkSession, keep: Callable[[], list[DataFrame]]) -> Iterator[None]:
    """Delete at the end all that was stashed within, but for the tables that ``keep`` then names.

    Results that are not written yet still read what was stashed for them, so
    the block has to write (stash) what it keeps.
    """
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        kept = {x.stash_path for x in keep()}
        for path in mine:
            if path not in kept:
                delete_path(spark, path)
