"""Tables out: a graph replaced as a whole, rendered records, artifacts by run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.scalar import markdown_safe
from strandgraph.operators.checks import dangling, duplicates, enforce


def replace_graph(nodes: DataFrame, edges: DataFrame, path: str, part: str = "package_hash") -> None:
    """Write a graph, replacing the packages it holds and no other.

    Nodes must have one row per id and edges both ends; else nothing is
    written. Nodes and edges are rows of one table, so one commit of Spark's
    writer replaces both.
    """
    enforce(duplicates(nodes, ["id"]), "nodes with one id")
    enforce(dangling(edges, nodes, "src", "dst", "id"), "edges without a node")
    each = lambda df, kind: df.select(F.lit(kind).alias("record"), F.col(part), F.to_json(F.struct(*[c for c in df.columns if c != part]), {"ignoreNullFields": "false"}).alias("value"))
    both = each(nodes, "node").union(each(edges, "edge"))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_graph(spark: SparkSession, path: str, node_schema: str = "id string", edge_schema: str = "src string, dst string", part: str = "package_hash") -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of all packages, with the columns asked for."""
    rows = spark.read.parquet(path)
    read = lambda kind, schema: rows.where(F.col("record") == kind).select(part, F.from_json("value", schema).alias("x")).select("x.*", part)
    return read("node", node_schema), read("edge", edge_schema)


def markdown(title: Column, fields: dict[str, Column]) -> Column:
    """A record as a Markdown heading and a list; null values are left out."""
    items = [F.when(c.isNotNull(), F.concat(F.lit(f"- **{name}**: "), markdown_safe(c.cast("string")))) for name, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), markdown_safe(title)), F.lit(""), *items)


def write_rendered(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Write texts by key, and give the manifest (key, path, bytes, sha256).

    Rows are packed into as many files as there are partitions, sorted by key,
    so the number of files follows the size, not the number of keys.
    """
    docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    read = docs.sparkSession.read.parquet(path)
    return read.select(F.col(key), F.col("_metadata.file_path").alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


def write_artifact(df: DataFrame, path: str, run: str, stage: str) -> None:
    """One stage's table of one run; written again, it takes the old one's place.

    The new table is written aside, the old one is renamed aside, and the new
    one renamed into its place; if that fails, the old one comes back, and only
    after it the old one goes. Readers see the old one, for a moment none, or
    the whole new one. Where no reader may ever see none, or where several
    tables change together, ``versions.publish`` is the way.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    to, aside, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run}/{x}") for x in (f"stage={stage}", f"_aside-{name}", f"_old-{name}"))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(aside.toString())
    held = files.exists(to)
    if held and not files.rename(to, old):
        raise OSError(f"could not rename {to} to {old}")
    if not files.rename(aside, to):
        if held and not files.rename(old, to):
            raise OSError(f"could not rename {aside} to {to}, nor {old} back to it")
        raise OSError(f"could not rename {aside} to {to}")
    if held:
        files.delete(old, True)
