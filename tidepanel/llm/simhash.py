"""Near-duplicates by SimHash fingerprints and sharded BK-trees.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of ``shingle`` words with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Search: two fingerprints that differ in at most ``radius`` bits agree on at least m of radius + m blocks of bits, so they meet in
the shard of some choice of m blocks. m follows the number of different fingerprints, so that shards of spread-out fingerprints stay small at any size (4 choices
of 16 bits up to 2^26 fingerprints). A shard is a BK-tree: a node's children are keyed by their Hamming distance to it, and a query follows only the edges whose
key lies within the radius of its own distance. A shard with more than ``piece`` fingerprints is split; the tree of each piece is sent
to every piece of the shard, so a task holds at most two pieces. A tree task returns a spanning forest of the links it found, not
the links, so a group of copies gives as many edges as it has fingerprints.

Copies with one fingerprint are one node. Components follow from ``components``; no link, component or fingerprint passes the driver.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; repeated rows are
copies; a null id never becomes a component id unless its whole component has none; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidepanel.llm.components import components
from tidepanel.llm.names import free_names
from tidepanel.session import materialize

SEED = 42
PIECE = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, SEED) for p in parts], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, text_hash, fp (the 64 bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=schema.names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, schema)


class Tree:
    """BK-tree over integers: [value, {distance: child}]."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            apart = (node[0] ^ value).bit_count()
            if not apart:
                return
            child = node[1].get(apart)
            if child is None:
                node[1][apart] = [value, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        if self.root is None:
            return []
        found, open_nodes = [], [self.root]
        while open_nodes:
            kept, children = open_nodes.pop()
            apart = (kept ^ value).bit_count()
            if apart <= radius:
                found.append(kept)
            if children:
                if len(children) <= 2 * radius + 1:
                    open_nodes += [c for d, c in children.items() if -radius <= d - apart <= radius]
                else:
                    open_nodes += [children[d] for d in range(apart - radius, apart + radius + 1) if d in children]
        return found


def forest(tree_values: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the tree's values and the queries (None: among the tree's values)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges, tree = [], Tree()

    def link(value: int) -> None:
        for other in tree.near(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[a] = b
                edges.append((value, other))

    for value in tree_values:
        if queries is None:
            link(value)
        tree.add(value)
    for value in queries or ():
        link(value)
    return edges


def block_masks(radius: int, chosen: int) -> list[int]:
    """Masks of every choice of ``chosen`` among radius + chosen blocks of bits."""
    n = radius + chosen
    blocks = [((1 << (64 * (k + 1) // n)) - 1) ^ ((1 << (64 * k // n)) - 1) for k in range(n)]
    return [sum(c) for c in combinations(blocks, chosen)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, count: int, radius: int = 3, piece: int = PIECE) -> DataFrame:
    """u, v: edges that connect all fingerprints (column fp, each once) within the radius of each other."""
    chosen = 1
    while 64 * chosen // (radius + chosen) < 40 and count >> (64 * chosen // (radius + chosen)) > 1024:
        chosen += 1
    masks = block_masks(radius, chosen)
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"))
                                                     for k, m in enumerate(masks)])).alias("s")).select("fp", "s.choice", "s.bits")
    large = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > piece) \
        .select("choice", "bits", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    rows = rows.join(large, ["choice", "bits"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # piece a's tree against piece b's queries, a <= b: a fingerprint goes to every pair that its piece is part of
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "choice", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            a, b = key[2], key[3]
            if a == b:
                return forest([v for _, v in group], None, radius)
            return forest([v for own, v in group if own == a], [v for own, v in group if own == b], radius)

        for batch in batches:
            edges = []
            for choice, bits, a, b, own, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (choice, bits, a, b) != key:
                    edges += close()
                    key, group = (choice, bits, a, b), []
                group.append((own, fp & 0xFFFFFFFFFFFFFFFF))
            yield batch_of(edges)
        yield batch_of(close())

    def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array([signed(x) for x in u], pa.int64()), pa.array([signed(x) for x in v], pa.int64())], names=["u", "v"])

    keys = ["choice", "bits", "a", "b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, text_hash, fp (long), root (least fp of the component), component_id (its least id)."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    found = components(links(distinct.select("fp"), distinct.count(), radius))
    rooted = distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with one document of each component: the least id, nulls last, then the least hash of its text.

    Of rows that repeat id and text the one with the least hash of all columns stays.
    """
    return keep_first(docs, near_duplicates(docs, radius, shingle, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_one`` by a given table of components: the id column, text_hash and root, a row per document."""
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    each = materialize(found.groupBy("root", place.alias("place")).agg(F.count("*").alias("n")))
    first = each.groupBy("root").agg(F.min("place").alias("first"))
    judged = each.join(first, "root")
    i, h, mixed, place_of = free_names(docs, "place_id", "place_hash", "mixed", "place_of")
    key = lambda df: df.select(F.col("place.id").alias(i), F.col("place.hash").alias(h))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    repeated = key(judged.filter((F.col("place") == F.col("first")) & (F.col("n") > 1)))
    others = key(judged.filter((F.col("place") != F.col("first")) | (F.col("n") > 1)))
    rank = F.row_number().over(Window.partitionBy(i, h).orderBy(mixed))
    mix = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    again = docs.join(repeated, same).withColumn(mixed, mix).withColumn(place_of, rank).filter(F.col(place_of) == 1).select(*docs.columns)
    return docs.join(others, same, "left_anti").unionByName(again)
