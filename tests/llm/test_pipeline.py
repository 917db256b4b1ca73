"""The corpus pipeline, the queries and their SQL."""

import corpus_pipeline
import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from strandgraph.llm import contamination, queries, simhash, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_against_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    want = duck(SF).sql(sql.oracle_sql()[name]).df()
    assert rows(got.toPandas()) == rows(want)


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {n for n in queries.queries()} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mixing"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        if name != "mixing":
            assert out.columns == docs.columns, name
        out = out.cache()
        if name == "near_dedup":
            again = simhash.near_duplicates(out)
            assert again.where(F.col("doc_id") != F.col("component_id")).count() == 0
            groups = simhash.near_duplicates(seen).select("component_id").distinct().count()
            assert out.count() == groups
        if name == "decontaminate":
            found = contamination.find_passages(seen, spark.read.parquet(f"{SF}/benchmark.parquet"))
            clean = {r.doc_id for r in found.where("not contaminated").collect()}
            assert {r.doc_id for r in out.collect()} == clean
        if name == "line_dedup":
            assert out.where(F.length("text") != F.col("n_chars")).join(docs.where(F.length("text") == F.col("n_chars")), "doc_id", "left_semi").count() == 0
        seen = out
    assert seen.columns == [*docs.columns, "copy_no"]


def test_awkward_documents(spark):
    made = [
        (1, "der die das und nicht auch für", "de", "a", 1), (None, "the and of this is that with for", "en", None, 1), (1, "der die das und nicht auch für", "de", "a", 1),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, "the the the\nand and and\nof of of", "en", "b", 3), (5, "the the the\nand and and\nwith this that", "en", "b", 3),
    ]
    df = spark.createDataFrame([(*m, "x", 9) for m in made], "doc_id long, text string, lang string, source string, n_chars long, ord string, copy_no int")
    seen = df
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF).cache()
        assert seen.columns[: len(df.columns)] == df.columns, name
    assert seen.count() > 0
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_decontamination_numbers_documents_once(spark, tmp_path):
    passage = " ".join(f"answer{i}" for i in range(13))
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(passage + " "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("plain text "), F.col("doc_id").cast("string")))
    more = [(7, "another text with a repeated id"), (50, passage), (50, passage), (None, passage), (None, "no id")]
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", text).union(spark.createDataFrame(more, "doc_id long, text string"))
    dealt = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in dealt}
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left = out.select(F.count("*"), F.count(F.when(F.col("text").contains(passage), 1))).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(left) == (20_000 - 400 + 2, 0)
