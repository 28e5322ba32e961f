"""Every stage of the pipeline, and the whole of it, on awkward rows whose columns bear the names of helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import AWKWARD
from tidepanel.llm import decontam, linededup, neardup, simhash
from tidepanel.llm.names import free_names
from tidepanel.llm.registry import ship

SMALL = "/root/testdata/sf0.001"
CLASHING = ["_id", "_hash", "_mix", "_rank", "_found", "_cut_id", "_cut_hash", "_cut_lines", "_bad_id", "_bad_hash", "_bad_words", "found", "place_id", "PLACE_HASH", "mixed", "place_of",
            "cut_id", "cut_hash", "cut_lines", "bad_id", "bad_hash", "bad_words", "text_hash", "root", "set_id", "n", "key", "window", "ids", "start", "sequence_id"]


@pytest.fixture(scope="module")
def clashing(spark):
    ship(spark)
    rows = spark.createDataFrame([(*r, "x") for r in AWKWARD], "doc_id long, text string, lang string, source string")
    rows = rows.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return rows.select("*", F.length("text").alias("n_chars"), *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING]).cache()


def test_names_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "found int, FOUND_ int")
    assert free_names(df, "found", "other", "Other") == ["found__", "other", "Other_"]


def test_stages_keep_clashing_columns(spark, clashing):
    kept = clashing
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept, SMALL)
        if name == "pack":
            assert made.count() > 0
            break
        assert made.columns == clashing.columns
        before, after = kept.count(), made.count()
        assert 0 < after <= before
        # what a row says under those names is what it said before
        assert made.where(" or ".join(f"`{c}` <> concat('{c}', coalesce(cast(doc_id as string), '-'))" for c in CLASHING)).count() == 0
        assert stage(spark, clashing, SMALL).count() <= clashing.count()  # the raw rows, too
        kept = made
    assert stage(spark, clashing, SMALL).count() > 0


def test_operators_keep_clashing_columns(spark, clashing):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for made in (linededup.dedup_lines(clashing, min_words=1), neardup.keep_one(clashing), simhash.keep_one(clashing), decontam.decontaminate(clashing, items, cut=True)):
        assert made.columns == clashing.columns and made.count() > 0


def test_the_whole_pipeline(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and all(p.length <= 2048 for p in pieces)
