"""Sets of tables that are replaced as a whole: version folders and numbered pointers.

A version is a folder that nothing changes once it is written. What is current
is told by the pointer file with the greatest number; it appears by one
rename, after its version is complete, so a reader that resolves the pointer
once reads one whole version, whatever writers do meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTERS, VERSIONS = "_pointers", "versions"


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, there = _files(spark, folder), _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(there)) if files.exists(there) else []


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of each pointer, in order. A name is ``<number>-<version>``."""
    names = [n.partition("-") for n in _names(spark, f"{path}/{POINTERS}") if not n.startswith((".", "_"))]
    return sorted((int(number), version) for number, _, version in names)


def current(spark: SparkSession, path: str) -> str | None:
    """The version that is current, to be passed to ``read_version``; None if nothing was published."""
    found = _pointers(spark, path)
    return found[-1][1] if found else None


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, keep: int = 2, before_pointer: Callable[[], None] | None = None) -> str:
    """Write ``tables`` as the next version and make it current; its name.

    Tables are written with their own types. Versions other than the ``keep``
    latest go afterwards, and so do folders that no pointer names and that are
    older than the oldest kept one: what interrupted writers left.
    ``before_pointer`` is called when all is written and nothing points to it.
    A second writer that takes the same number fails; its version is not current.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{VERSIONS}/{version}/{name}")
    if before_pointer is not None:
        before_pointer()
    found = _pointers(spark, path)
    number = found[-1][0] + 1 if found else 1
    files, aside = _files(spark, path), _path(spark, path, f"_pointer-{version}")
    files.create(aside, False).close()
    files.mkdirs(_path(spark, path, POINTERS))
    taken = {n for n, _ in _pointers(spark, path)}
    if number in taken or not files.rename(aside, _path(spark, path, POINTERS, f"{number:012d}-{version}")):
        files.delete(aside, False)
        raise OSError(f"version {number} of {path} was published by another writer")
    _expire(spark, path, keep)
    return version


def _expire(spark: SparkSession, path: str, keep: int) -> None:
    files, found = _files(spark, path), _pointers(spark, path)
    kept = {v for _, v in found[-keep:]}
    for number, version in found[:-keep]:
        files.delete(_path(spark, path, POINTERS, f"{number:012d}-{version}"), False)
    when = {v: files.getFileStatus(_path(spark, path, VERSIONS, v)).getModificationTime() for v in _names(spark, f"{path}/{VERSIONS}")}
    oldest = min((when[v] for v in kept if v in when), default=0)
    for version, at in when.items():
        if version not in kept and at < oldest:
            files.delete(_path(spark, path, VERSIONS, version), True)


def read_version(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of ``version``, by default the current one. Resolve it once to read several tables of one version."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return spark.read.parquet(f"{path}/{VERSIONS}/{version}/{name}")
