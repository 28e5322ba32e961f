"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on what the stage before it kept; ``run`` writes each result as Parquet to the
shared folder and reads it again. All stages but the last return the columns of ``documents``; ``n_chars``, where there is one, follows the text.

* ``language_id`` fits on the labelled rows it gets (ids whose crc32 is 2 modulo 4 are left out) and drops texts without a letter and ambiguous ones.
* ``line_dedup`` cuts lines with a word that match an earlier line; documents that lose all their words go.
* ``near_dedup`` keeps one document of each component of near copies: Jaccard similarity of 0.8 or more on shingles of five words,
  among candidates of BK-trees over SimHash fingerprints and of MinHash bands.
* ``decontaminate`` drops documents that hold a window of a benchmark item.
* ``pack`` returns the pieces of sequences of at most 2048 ids, with their ids.

Null, empty and repeated rows pass every stage; an empty table gives no rows; columns of any other name are kept as they are up to the last stage.

ORACLE_SQL is None: tokenizing and the fitted model have no SQL form; tests/llm/test_llm.py (test_pipeline_stages), test_neardup.py and
test_clashes.py check the stages against plain Python and on awkward rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import decontam, langid, linededup, neardup, packing
from tidepanel.llm.names import free_names
from tidepanel.llm.registry import ship, table
from tidepanel.session import materialize

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    found, = free_names(docs, "found")
    return docs.withColumn(found, langid.identify(model, F.col("text"))).filter(~F.col(f"{found}.ambiguous")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(docs, min_words=1)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
