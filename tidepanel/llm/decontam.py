"""Benchmark decontamination, with DataFrame functions only.

A-Z are lower-cased and words are runs of letters, digits and characters beyond ASCII. A window is ``size`` consecutive words of a test item;
an item with fewer words, but not none, is one window. The different windows are a broadcast hash set: training tasks join the
windows at each word of their texts against it, by the window's text, so a hit of the hash is verified by the join itself. Nothing
but hits and one row per document leaves a task. The set is counted first; beyond ``BROADCAST_WINDOWS`` windows the join is left to a shuffle.

Documents are known by their id and a hash of their text, so repeated rows give repeated results.

Defined cases: null texts have no words; an empty benchmark hits nothing; items with a null id hit, but are not listed; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.names import free_names

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lower-cased
WITH_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word and the gap before it, any case
BROADCAST_WINDOWS = 400_000  # windows of ten words, about 100 bytes each


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def windows_at(found: Column, size: int) -> Column:
    """Every window of ``size`` words, by its first position from 0."""
    count = F.size(found) - size + 1
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
                       lambda k: F.struct(k.alias("at"), F.array_join(F.slice(found, k + 1, F.lit(size)), " ").alias("window")))


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """window, length, items (ids as sorted text) of all different windows."""
    found = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    every = F.when(n >= size, F.transform(windows_at(F.col("w"), size), lambda x: x["window"])).when(n > 0, F.array(F.array_join("w", " "))) \
        .otherwise(F.array().cast("array<string>"))
    return found.select("item", F.least(n, F.lit(size)).alias("length"), F.explode(every).alias("window")) \
        .groupBy("window").agg(F.first("length").alias("length"), F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, text_hash, n_words, hits (at, length; positions of words from 0), items (ids as sorted text)."""
    known = item_windows(items, size, item_col, item_text_col)
    n, lengths = 0, []
    for row in known.groupBy("length").agg(F.count("*").alias("n")).collect():  # ``size`` rows at most
        n, lengths = n + row["n"], lengths + [row["length"]]
    known = known.withColumnRenamed("length", "known_length")
    if n <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    read = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    marker = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("window")))
    rows = read.select(id_col, "text_hash", F.size("w").cast("long").alias("n_words"),
                       F.explode(F.concat(marker, *[windows_at(F.col("w"), k) for k in sorted(lengths)])).alias("x")) \
        .select(id_col, "text_hash", "n_words", "x.at", "x.window")
    hit = rows.join(known, "window", "left").filter((F.col("at") < 0) | F.col("known_length").isNotNull())
    return hit.groupBy(id_col, "text_hash", "n_words").agg(
        F.count_if(F.col("at") < 0).cast("int").alias("times"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", F.col("known_length").alias("length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")) \
        .withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select(id_col, "text_hash", "n_words", "hits", "items")


def hit_words(hits: Column) -> Column:
    """Different word positions inside the hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, cut: bool = False, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The input's columns without contaminated documents or, with ``cut``, all documents without their hit words."""
    i, h, words = free_names(docs, "bad_id", "bad_hash", "bad_words")
    bad = find_hits(docs, items, size, id_col, text_col, **names).filter(F.size("hits") > 0).dropDuplicates([id_col, "text_hash"]) \
        .select(F.col(id_col).alias(i), F.col("text_hash").alias(h), hit_words(F.col("hits")).alias(words))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    if not cut:
        return docs.join(bad, same, "left_anti")
    kept = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(WITH_GAP), F.lit(0)), lambda _, k: ~F.array_contains(words, k))
    clean = F.when(F.col(words).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return docs.join(bad, same, "left").select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
