"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours that fill a seed's window.

A document is its token ids and an end id. It is cut into whole windows, which are sequences of their own, and
a tail. Tails are ordered by their two most telling terms, so that lexical neighbours lie together however the input is laid out, and dealt
into shards of ``shard_docs`` along this order; each shard has an inverted index of its own (all terms of all tails, BM25 impacts stored with
the postings). The first unused tail is the seed of a window; its unused neighbours follow by falling BM25 score, first those that fit whole,
then one that is cut at the end of the window. The rest of a cut tail stays in the shard as an unused neighbour. So only the last
sequence of a shard is short. Neighbours outside the shard are not found: their share is in the README.

Pieces are written once, then only tails are shuffled, by ranges of their key and a number of their own, so a key of many copies is split. A task
holds at most ``shard_docs`` tails of less than a window, and a lost task is repeated with the same result.

Defined cases: a null or empty text is the end id alone; rows with the same or a null id are packed one by one; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tidepanel.llm import tokens as K
from tidepanel.session import materialize

K1, B = 1.2, 0.75  # the usual BM25 parameters


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids in order and how often each stands; ids below 2^16 take a radix sort."""
    ids = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids.copy()
    ids.sort(kind="stable")
    ends = np.empty(len(ids), dtype=bool)
    ends[-1] = True
    np.not_equal(ids[1:], ids[:-1], out=ends[:-1])
    last = ends.nonzero()[0]
    count = last.copy()
    count[0] += 1
    count[1:] -= last[:-1]
    return ids[last], count


class Index:
    """BM25 inverted index over the tails of a shard."""

    def __init__(self, tails: list[np.ndarray]):
        found = [distinct(ids) for ids in tails]
        size = np.array([len(t) for t, _ in found])
        lengths = np.array([len(ids) for ids in tails], dtype=np.float64)
        doc = np.repeat(np.arange(len(tails)), size)
        term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order].astype(np.float64)
        new = np.append(True, term[1:] != term[:-1])
        self.bounds = np.append(np.flatnonzero(new), len(term))
        row = np.empty(len(order), dtype=np.int64)
        row[order] = np.cumsum(new) - 1
        self.rows = np.split(row, np.cumsum(size)[:-1])  # of each tail: the rows of its terms
        df = np.diff(self.bounds)
        idf = np.log(1 + (len(tails) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        self.doc = doc
        self.impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        self.size = len(tails)

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of used tails; the scores of the others stay as they are."""
        kept = ~used[self.doc]
        self.bounds = np.append(0, np.cumsum(kept))[self.bounds]
        self.doc, self.impact = self.doc[kept], self.impact[kept]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every tail for the distinct terms of the seed."""
        rows = self.rows[seed]
        spans = [slice(a, b) for a, b in zip(self.bounds[rows].tolist(), self.bounds[rows + 1].tolist())]
        doc, impact = np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.impact[s] for s in spans])
        return np.bincount(doc, weights=impact, minlength=self.size)


def fill_windows(tails: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, first id, count); each id of each tail lies in one of them."""
    if not tails:
        return
    index = Index(tails)
    used_to = [0] * len(tails)
    left = np.array([len(t) for t in tails])
    indexed = len(tails)  # tails with postings
    for seed in range(len(tails)):
        while left[seed]:
            pieces, space, scores, tail = [], window, None, seed
            while True:
                count = min(space, int(left[tail]))
                pieces.append((tail, used_to[tail], count))
                used_to[tail] += count
                left[tail] -= count
                space -= count
                if not space:
                    break
                if scores is None:
                    unused = np.count_nonzero(left)
                    if unused * 10 < indexed * 9:
                        index.forget(left == 0)
                        indexed = unused
                    scores = index.scores(seed)
                # the best unused neighbour that fits whole, or else the best one, cut; the first of equal ones
                near = np.flatnonzero((left > 0) & (left <= space))
                if not len(near):
                    near = np.flatnonzero(left)
                if not len(near):
                    break
                tail = int(near[np.argmax(scores[near])])
            yield pieces


def telling_terms(ids: np.ndarray) -> int:
    """The two terms with most weight in a tail, as one long: tails that share them lie together in order of it.

    The weight is BM25's saturated frequency times the logarithm of the id: merges of a vocabulary are numbered from frequent to rare.
    """
    terms, count = distinct(ids)
    weight = count / (count + K1) * np.log1p(terms, dtype=np.float64)
    first = int(np.argmax(weight))
    weight[first] = -1
    return int(terms[first]) << 32 | int(terms[np.argmax(weight)])


def cut_documents(docs: DataFrame, window: int, end_id: int, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """A row per whole window and per tail: doc, start, ids, doc_tokens, place (a number of its own) and key (of tails; null for windows)."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]
                          + [T.StructField(n, T.LongType()) for n in ("start", "doc_tokens", "place", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = K.encoder(path).library_ids
        end, size = K.pack([end_id]), window * K.WIDTH
        place = TaskContext.get().partitionId() << 38
        for batch in batches:
            doc_type, rows = batch.schema.field(0).type, []

            def out() -> pa.RecordBatch:
                types = (doc_type, pa.binary(), *[pa.int64()] * 4)
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for at in range(0, len(ids), size):
                    part = ids[at:at + size]
                    key = telling_terms(np.frombuffer(part, dtype="<u4")) if len(part) < size else None
                    rows.append((doc, part, at // K.WIDTH, len(ids) // K.WIDTH, place, key))
                    place += 1
                    if len(rows) == 2048:
                        yield out()
            if rows:
                yield out()

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, window: int = 2048, shard_docs: int = 2048, end_id: int = 1, path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    assert sys.byteorder == "little", "ids are sliced as little-endian"
    parts = materialize(cut_documents(docs, window, end_id, path, id_col, text_col))
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([parts.schema["doc"], parts.schema["ids"]] + [T.StructField(n, T.LongType()) for n in longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        shard: list[tuple] = []
        doc_type = None

        def close_shard() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in fill_windows([np.frombuffer(ids, dtype="<u4") for _, ids, _, _ in shard], window):
                offset = 0
                for k, first, count in pieces:
                    doc, ids, start, total = shard[k]
                    rows.append((doc, ids[first * K.WIDTH:(first + count) * K.WIDTH], start + first, count, total, 2 * sequence, offset))
                    offset += count
                sequence += 1
            shard.clear()
            types = (doc_type, pa.binary(), *[pa.int64()] * len(longs))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=schema.names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                shard.append(row)
                if len(shard) == shard_docs:
                    yield close_shard()
        if shard:
            yield close_shard()

    # a range of (key, place) splits a key that many tails share; the order makes a repeated task give the same windows
    tails = parts.filter("key is not null").repartitionByRange("key", "place").sortWithinPartitions("key", "place") \
        .select("doc", "ids", "start", "doc_tokens").mapInArrow(run, schema)
    whole = parts.filter("key is null").select("doc", "ids", "start", F.lit(window).cast("long").alias("length"), "doc_tokens",
                                               (2 * F.col("place") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return tails.unionByName(whole).select(F.col("doc").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
