"""Sources and sinks: tables written as files of a package and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.plans.registry import Tables, query
from strandgraph.sources import packages as P
from strandgraph.sources import sinks as K
from strandgraph.sources import versions as R
from strandgraph.store import delete_path, new_path, stash


def _one_file_each(df: DataFrame, key: str, name: str) -> str:
    """Write (key, value) as a text file per key, lines in order."""
    path = new_path(df.sparkSession, name)
    df.repartition(key).sortWithinPartitions(key, "value").write.partitionBy(key).text(path)
    return path


#: Rows of a file that a query writes, so that files stay small at any scale.
FILE_ROWS = 1000


@query("""
WITH l AS (SELECT p_partkey // 1000 AS file, p_partkey, lpad(p_partkey::VARCHAR, 12, '0') || ' ' || p_name || chr(10) AS line FROM part)
SELECT file::BIGINT AS file, sum(strlen(line))::BIGINT AS size, sha256(string_agg(line, '' ORDER BY p_partkey)) AS sha256, 'UTF-8' AS encoding, NULL::VARCHAR AS kind FROM l GROUP BY file
""")
def s04_inventory(t: Tables) -> DataFrame:
    """All parts as lines of files, FILE_ROWS in a file."""
    line = F.concat_ws(" ", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), "p_name")
    path = _one_file_each(t.part.select(F.floor(F.col("p_partkey") / FILE_ROWS).alias("file"), line.alias("value")), "file", "package")
    files = P.inventory(t.spark, path).where("name not like '%_SUCCESS'")
    return files.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "size", "sha256", "encoding", "kind")


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def s06_manifests(t: Tables) -> DataFrame:
    """Elements of XML manifests by a fixed schema, FILE_ROWS in a file."""
    item = F.concat(F.lit("<table><key>"), F.col("p_partkey").cast("string"), F.lit("</key><name>"), F.upper("p_name"), F.lit("</name></table>"))
    lines = t.part.select(F.col("p_partkey").alias("k"), item.alias("value"))
    docs = lines.groupBy(F.floor(F.col("k") / FILE_ROWS).alias("file")).agg(F.concat(F.lit("<tables>"), F.array_join(F.array_sort(F.collect_list("value")), ""), F.lit("</tables>")).alias("value"))
    path = _one_file_each(docs, "file", "manifests")
    return P.manifests(t.spark, f"{path}/*", "table", "key long, name string").select(F.col("key").alias("p_partkey"), "name")


@query("""
SELECT s_suppkey AS file, CASE s_suppkey % 6 WHEN 0 THEN 'UNSAFE' WHEN 1 THEN 'NOT_WELL_FORMED' WHEN 2 THEN 'SCHEMA_INVALID' WHEN 3 THEN 'VALUE_INVALID' ELSE 'VALID' END AS outcome,
  CASE s_suppkey % 6 WHEN 2 THEN 'country,version' WHEN 3 THEN 'encoding,snapshot-date' ELSE '' END AS problems, CASE WHEN s_suppkey % 6 > 3 THEN s_name END AS application
FROM supplier
""")
def s06_manifest_outcomes(t: Tables) -> DataFrame:
    """A manifest per supplier: some with a document type, cut off, without required parts, or with values that are not allowed."""
    m, text = F.col("s_suppkey") % 6, lambda x: F.lit(x)
    version = F.when(m == 2, "").otherwise(' schema-version="1"')
    country = F.when(m == 2, "").otherwise('<country code="ES"/>')
    source = F.when(m == 3, '<source encoding="NONE"/><snapshot date="2024-13-40"/>').otherwise('<source encoding="UTF-8"/><snapshot date="2024-02-29"/>')
    xml = F.concat(F.when(m == 0, "<!DOCTYPE manifest [<!ENTITY x 'y'>]>").otherwise(""), text("<manifest"), version, text("><application>"), F.col("s_name"), text("</application>"), country, source, F.when(m == 1, "<open>").otherwise("</manifest>"))
    files = t.supplier.select(F.col("s_suppkey").alias("path"), xml.alias("content"))
    schema = "`_schema-version` string, application string, country struct<_code: string>, source struct<_encoding: string>, snapshot struct<_date: string>"
    required = {"version": F.col("_schema-version").isNotNull(), "country": F.col("country._code").isNotNull(), "application": F.col("application").isNotNull()}
    allowed = {"encoding": F.col("source._encoding").isin("UTF-8", "ISO-8859-1"), "snapshot-date": F.try_to_date("snapshot._date").isNotNull()}
    out = P.manifest_outcomes(files, schema, required, allowed)
    return out.select(F.col("path").alias("file"), "outcome", F.array_join("problems", ",").alias("problems"), F.col("manifest.application").alias("application"))


@query("SELECT s_suppkey AS program, s_name AS source_file, sha256(s_name) AS source_hash FROM supplier")
def s12_programs(t: Tables) -> DataFrame:
    """Program documents, FILE_ROWS in a file, whose hashes agree with their sources."""
    each = F.struct(F.col("s_suppkey").alias("program"), F.col("s_name").alias("source_file"), F.sha2("s_name", 256).alias("source_hash"))
    docs = t.supplier.groupBy(F.floor(F.col("s_suppkey") / FILE_ROWS).alias("file")).agg(F.to_json(F.collect_list(each)).alias("value"))
    path = _one_file_each(docs, "file", "programs")
    hashes = t.supplier.select(F.col("s_name").alias("source_file"), F.sha2("s_name", 256).alias("sha256"))
    return P.programs(t.spark, f"{path}/*", "program long, source_file string, source_hash string", hashes)


@query("""
SELECT 'reader between' AS seen, 'O' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') AS lines
UNION ALL SELECT 'reader after', 'F', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
""")
def k02_versions(t: Tables) -> DataFrame:
    """Orders and their lines under one pointer, published twice; a reader between the writing and the pointer sees the first version of both."""
    path, seen = new_path(t.spark, "versions"), []

    def look(name: str) -> None:
        held = R.current(t.spark, path)
        o, n = (R.read_version(t.spark, path, x, held) for x in ("orders", "lines"))
        status = o.agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("orders"))
        seen.append(stash(status.join(n.agg(F.count("*").alias("lines"))).select(F.lit(name).alias("seen"), "status", "orders", "lines"), "seen"))

    # Lines meet their orders once for both versions: whole lines are shuffled once, and not sorted.
    keys = t.orders.where(F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", F.col("o_orderstatus").alias("status")).distinct()
    both = new_path(t.spark, "lines")
    t.lineitem.join(keys.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey").write.partitionBy("status").parquet(both)
    lines = t.spark.read.schema(t.lineitem.schema.add("status", "string")).parquet(both)
    for status in ("O", "F"):
        o = t.orders.where(F.col("o_orderstatus") == status)
        tables = {"orders": o, "lines": lines.where(F.col("status") == status).drop("status")}
        R.publish(t.spark, tables, path, before_pointer=(lambda: look("reader between")) if status == "F" else None)
    look("reader after")
    delete_path(t.spark, both)
    return seen[0].union(seen[1])


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, 'r1' AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k01_artifacts(t: Tables) -> DataFrame:
    """A stage's table that is written again takes the place of the first."""
    path = new_path(t.spark, "artifacts")
    for status in ("O", "F"):
        K.write_artifact(t.orders.where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, "r1", "counts")
    return t.spark.read.parquet(path).select("o_orderpriority", "n", "run_id")


@query("""
SELECT 'node' AS record, s_nationkey::BIGINT AS package, 's' || s_suppkey AS id, NULL::VARCHAR AS dst FROM supplier UNION ALL SELECT 'node', s_nationkey, 'n' || s_nationkey, NULL FROM (SELECT DISTINCT s_nationkey FROM supplier)
UNION ALL SELECT 'edge', s_nationkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_nationkey <> 1 UNION ALL SELECT 'edge', 1, 'n1', 's' || s_suppkey FROM supplier WHERE s_nationkey = 1
""")
def k03_replaced_graph(t: Tables) -> DataFrame:
    """Suppliers as a graph of a package per nation, of which one is replaced by its reverse."""
    path = new_path(t.spark, "graph")
    package = F.col("s_nationkey").cast("long").alias("package_hash")
    supplier, nation = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    nodes = t.supplier.select(supplier.alias("id"), package).union(t.supplier.select(nation, package).distinct())
    K.replace_graph(nodes, t.supplier.select(supplier.alias("src"), nation.alias("dst"), package), path)
    K.replace_graph(nodes.where("package_hash = 1"), t.supplier.where("s_nationkey = 1").select(nation.alias("src"), supplier.alias("dst"), package), path)
    n, e = K.read_graph(t.spark, path)
    package = F.col("package_hash").cast("long").alias("package")
    return n.select(F.lit("node").alias("record"), package, "id", F.lit(None).cast("string").alias("dst")).union(e.select(F.lit("edge"), package, "src", "dst"))


@query("SELECT p_partkey, strlen('# ' || p_name || chr(10)) AS bytes, sha256('# ' || p_name || chr(10)) AS sha256 FROM part")
def k08_manifest(t: Tables) -> DataFrame:
    """Rendered records with a manifest read from what was written."""
    docs = t.part.select("p_partkey", K.markdown(F.col("p_name"), {}).alias("text"))
    return K.write_rendered(docs, new_path(t.spark, "rendered"), "p_partkey", "text").select("p_partkey", "bytes", "sha256")
