"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.contamination import find_passages
from strandgraph.llm.language import reject_languages, train
from strandgraph.llm.linededup import dedup_lines
from strandgraph.llm.mixing import mix_rows
from strandgraph.llm.rows import fresh, numbered, without
from strandgraph.llm.simhash import one_of_each
from strandgraph.store import drop_stash, passing, stash


#: The languages that the corpus is meant to hold.
TARGET_LANGUAGES = ["de", "en", "es", "fr"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a target language, with a probability of one half or more and a text that is usual for it.

    The commonest labels are in the model, and all others together, so that a text in another labelled language is told from the targets.
    """
    return reject_languages(docs, train(docs, always=TARGET_LANGUAGES), allowed=TARGET_LANGUAGES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of lines of three words or more in three documents or more, go; so do documents that lose all lines by that."""
    out = dedup_lines(docs, min_docs=3)
    removed, left = out.columns[-2], out.columns[-1]
    out = out.where((F.col(removed) == 0) | (F.col(left) > 0))
    n_chars = [F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up a twentieth of, or more, go.

    Documents are numbered once: numbers of repeated or null ids depend on how
    a sort is dealt, so a second numbering could name other documents.
    """
    name = fresh(docs, "ord")
    rows = numbered(docs, name=name)
    found = find_passages(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name)
    bad = stash(found.where("contaminated").select(F.col("doc_id").alias("ord")).distinct(), "contaminated")
    return without(rows, bad, name)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, with the copy's number."""
    return mix_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: SQL cannot express the trained language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes when its own
    table is written, and that goes when the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing(spark, lambda: [docs] if hasattr(docs, "stash_path") else []):
            docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stash(before)
        before = docs
    return docs
