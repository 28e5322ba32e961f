"""Near-duplicates by the Jaccard similarity of word shingles: BK-trees over SimHash and MinHash bands find candidates, each link is verified on the whole sets.

A document is the set of its shingles of ``shingle`` words (A-Z lower-cased, words between ASCII white space; fewer words: the whole sequence; none: the
empty set). Two documents are linked if the Jaccard similarity of their sets is ``threshold`` or more; copies with one set are one node.

1. SimHash: a set has a fingerprint of its shingles' hashes. The BK-trees of ``simhash`` find fingerprints within ``radius`` bits; they give a spanning forest of these links. Sets
   of one fingerprint are tried against the least of them, and a link of two fingerprints between the least sets of both.
2. Pairs of a similarity just over the threshold lie 4 to 11 bits apart, which would need hundreds of tree shards a fingerprint. MinHash bands find these, and what a tree's forest
   left out: BANDS keys of ROWS minima each. Two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.99999 at 0.8, 0.06 at 0.2. The
   keys of a document are BANDS at any table size.
3. Keys with at most SMALL sets give their pairs. These and the trees' pairs, each once, are verified by a join with the sets.
4. Keys with more sets carry the sets: they are dealt into pieces, and each pair of pieces is one group of a task, which verifies every pair that its earlier
   links don't connect already and returns a spanning forest. So a group of copies gives as many edges as it has sets, and no pair is emitted.

The sets are read again from the texts of those documents alone that have a candidate. Sets are known by a 64-bit hash, shingles too.

Defined cases: null texts and texts without words have the empty set, so they are copies of each other; rows that repeat an id and a text are copies; a null id stays only where
its component has no other; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidepanel.llm import simhash
from tidepanel.llm.components import components
from tidepanel.llm.linededup import similar
from tidepanel.llm.simhash import SEED, keep_first, signed
from tidepanel.session import materialize

BANDS, ROWS = 22, 4
SMALL = 16
PIECE = 256
BROADCAST_TEXTS = 400_000  # hashes of texts with a candidate, 16 bytes each
#: Fixed odd multipliers; the hashes they multiply are well mixed already.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], dtype="<u8"))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[k:k + (1 << 11), None] * FACTORS).min(0))
    return [signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id column, text_hash, set_id, n (size of the set), fp (its SimHash fingerprint), keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([signed(simhash.majority(s)) for s in sets], pa.int64()),
                                              pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("text_hash", "set_id", "n", "fp")],
                           T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, schema)


def set_hash(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """set_id, hashes of the sets of the wanted texts (text_hash), read from the texts; a task gives a text that it meets again once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text_hash not in seen:
                    seen.add(text_hash)
                    found = shingles(text.as_py(), shingle)
                    ids.append(set_hash(found))
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "hashes"])

    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return texts.join(wanted, "text_hash", "left_semi").mapInArrow(run, "set_id long, hashes array<long>").dropDuplicates(["set_id"])


def forest(tree: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the tree's sets and the queries (None: among the tree's sets)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for k, (v, a) in enumerate(tree if queries is None else queries):
        for u, b in tree[:k] if queries is None else tree:
            least, most = sorted((len(a), len(b)))
            if least * den < most * num or top(u) == top(v):
                continue
            if len(np.intersect1d(a, b, assume_unique=True)) * (num + den) >= (len(a) + len(b)) * num:
                parent[top(v)] = top(u)
                edges.append((v, u))
    return edges


def large_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: edges that connect all linked sets of each key. rows: key, pieces, set_id, hashes."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("pieces")).cast("int"))
    # piece a against piece b, a <= b: a set goes to every pair that its piece is part of
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "set_id", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            side = lambda piece: [(s, h) for own, s, h in group if own == piece]
            return forest(side(key[1]), None if key[1] == key[2] else side(key[2]), num, den)

        for batch in batches:
            edges = []
            names = [c.to_pylist() for c in batch.columns[:5]]
            for *at, own, set_id, hashes in zip(*names, batch.column(5)):
                if at != key:
                    edges += close()
                    key, group = at, []
                group.append((own, set_id, hashes.values.to_numpy().view(np.uint64)))
            yield batch_of(edges)
        yield batch_of(close())

    def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "set_id").mapInArrow(run, "u long, v long")


def tree_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """x, y, n_x, n_y: candidates among the sets by BK-trees over their fingerprints. distinct: set_id, n, fp, each set once; the empty set takes no part."""
    sets = distinct.filter("n > 0").select("fp", F.struct("set_id", "n").alias("set"))
    heads = materialize(sets.groupBy("fp").agg(F.min("set").alias("head")))
    same = sets.join(heads, "fp").filter("set != head").select(F.col("head").alias("x"), F.col("set").alias("y"))
    side = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    apart = simhash.links(heads.select("fp"), heads.count(), radius).join(side("u", "x"), "u").join(side("v", "y"), "v").select("x", "y")
    return same.unionByName(apart).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")) \
        .select("x.set_id", "y.set_id", "x.n", "y.n").toDF("x", "y", "n_x", "n_y")


def links(docs: DataFrame, distinct: DataFrame, num: int, den: int, shingle: int, text_col: str, radius: int = 3) -> DataFrame:
    """u, v: edges that connect all sets with a linked candidate. distinct: set_id, n, text_hash, fp, keys, each set once."""
    entries = distinct.select("set_id", "n", F.explode("keys").alias("key"))
    times = entries.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    met = materialize(entries.join(times, "key"))
    few = met.filter(F.col("times") <= SMALL)
    a, b = (few.select("key", F.col("set_id").alias(name), F.col("n").alias(f"n_{name}")) for name in "xy")
    near = (F.col("x") < F.col("y")) & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num)
    met_pairs = a.join(b, "key").select("x", "y", "n_x", "n_y").unionByName(tree_pairs(distinct, radius))
    pairs = materialize(met_pairs.filter(near).select("x", "y").distinct())
    many = met.filter(F.col("times") > SMALL)
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("set_id")).unionByName(many.select("set_id")).distinct()
    sets = materialize(whole_sets(docs, materialize(distinct.join(wanted, "set_id").select("text_hash")), shingle, text_col))
    side = lambda name: sets.select(F.col("set_id").alias(name), F.col("hashes").alias(f"h_{name}"))
    verified = pairs.join(side("x"), "x").join(side("y"), "y").filter(similar(F.col("h_x"), F.col("h_y"), num, den)) \
        .select(F.col("x").alias("u"), F.col("y").alias("v"))
    large = many.join(sets, "set_id").select("key", F.ceil(F.col("times") / PIECE).cast("int").alias("pieces"), "set_id", "hashes")
    return verified.unionByName(large_links(large, num, den))


def near_copies(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, text_hash, set_id, root (least set_id of the component)."""
    num, den = Fraction(str(threshold)).as_integer_ratio()
    signed_docs = materialize(signatures(docs, shingle, id_col, text_col))
    distinct = materialize(signed_docs.groupBy("set_id").agg(F.first("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"),
                                                                   F.first("keys").alias("keys")))
    found = components(links(docs, distinct, num, den, shingle, text_col, radius)).withColumnRenamed("u", "set_id")
    return signed_docs.join(found, "set_id", "left").select(id_col, "text_hash", "set_id", F.coalesce("root", "set_id").alias("root"))


def keep_one(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with one document of each component: the least id, nulls last, then the least hash of its text."""
    return keep_first(docs, near_copies(docs, threshold, shingle, radius, id_col, text_col), id_col, text_col)
