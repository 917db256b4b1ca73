"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.archives import archive_pages
from strandgraph.llm.chat import preference_pairs
from strandgraph.llm.codes import encode_vectors
from strandgraph.llm.contamination import find_passages
from strandgraph.llm.language import identify_pages, train
from strandgraph.llm.licenses import scan_licenses
from strandgraph.llm.linededup import dedup_lines
from strandgraph.llm.mixing import mix_sources
from strandgraph.llm.repair import damaged, repair_report
from strandgraph.llm.secrets import find_secrets, span_list
from strandgraph.llm.simhash import near_duplicates
from strandgraph.llm.spans import remove_repeats
from strandgraph.llm.topk import nearest
from strandgraph.store import delete_path, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = new_path(spark, "arc"), new_path(spark, "warc")
    out = archive_pages(_table(spark, sf_dir, "pages"), *paths)
    for path in paths:  # what was read back is a table of its own
        delete_path(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_left", F.sha2("text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2i and 2i+1 are the chosen and rejected side of pair i."""
    turns = _table(spark, sf_dir, "conversations")
    return preference_pairs(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(_table(spark, sf_dir, "pages"), train(_table(spark, sf_dir, "documents")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, its documents of one language are a repository."""
    found = find_secrets(_table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), turns)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_warc, op3_line_dedup, op4_mixing, op5_substring_dedup, op6_preferences, op7_language, op8_topk, op9_licenses, op10_decontamination, op11_secrets, op12_repair, op13_vector_codes]
    return {f.__name__: f for f in found}
