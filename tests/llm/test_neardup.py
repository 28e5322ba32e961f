"""Near-dedup of the pipeline against brute force over all pairs of documents."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import neardup
from tidepanel.llm.registry import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def set_by_force(text):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def kept_by_force(rows):
    """The least id of each component of rows (id, text) with a Jaccard similarity of 0.8 or more, and the number of linked pairs of different sets."""
    sets, parent, pairs = {i: set_by_force(t) for i, t in rows}, {i: i for i, _ in rows}, 0

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x == y or 5 * both >= 4 * (len(x) + len(y) - both):
                pairs += x != y
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {top(i) for i in ids}, pairs


@pytest.fixture(scope="module")
def planted(spark):
    """The small table, near copies of its texts with changed words, a large group of them, and pairs just under the threshold."""
    ship(spark)
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    long = [t for _, t in rows if len(t.split()) > 80]
    more = []
    for k, text in enumerate(long[:40] + long[:1] * 40):
        words = text.split(" ")
        for _ in range(max(1, len(words) // (60 if k < 30 or k >= 40 else 15))):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        more.append((10**6 + k, " ".join(words)))
    return rows + more


@pytest.mark.parametrize("small, piece", [(16, 256), (2, 5)])
def test_stage_drops_near_copies(spark, planted, monkeypatch, small, piece):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PIECE", piece)
    want, pairs = kept_by_force(planted)
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert pairs > 60 and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want


def test_stage_awkward(spark):
    ship(spark)
    eight = "one two three four five six seven eight"
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t\n", 0), (4, eight, 1), (4, eight, 1), (None, eight, 2), (5, "wörd é 日本 \U0001f600 \x00 end", 3), (6, "long " * 40000, 4), (None, None, 5), (7, eight.upper(), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_trees_find_links_of_their_own(spark, planted):
    """Without a band key, sets within 3 bits of each other are still linked; links by fingerprints alone are not."""
    def set_of(text):
        words = text.encode().lower().split()
        return {b" ".join(words[k:k + 5]) for k in range(len(words) - 4)}

    def print_of(text):
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in set_of(text)]
        return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))

    docs = spark.createDataFrame([r for r in planted if len((r[1] or "").split()) > 80], "doc_id long, text string")
    signed = neardup.signatures(docs, 5, "doc_id", "text").dropDuplicates(["set_id"]).persist()
    got = {r.set_id: (r.fp & (1 << 64) - 1, set_of(r.text)) for r in signed.join(docs, "doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.fp & (1 << 64) - 1 == print_of(texts[r.doc_id]) for r in signed.limit(20).collect())
    edges = neardup.links(docs, signed.withColumn("keys", F.expr("cast(array() as array<bigint>)")), 4, 5, 5, "text").collect()
    linked = lambda u, v: 9 * len(got[u][1] & got[v][1]) >= 4 * (len(got[u][1]) + len(got[v][1]))
    part = {u: {u} for u in got}
    for u, v in edges:
        assert linked(u, v)
        whole = part[u] | part[v]
        part.update((w, whole) for w in whole)
    close = [(u, v) for u in got for v in got if u < v and (got[u][0] ^ got[v][0]).bit_count() <= 3 and linked(u, v)]
    assert len(close) >= 5 and all(v in part[u] for u, v in close)
    # one fingerprint for all: every set is tried against the least one, none is linked by its fingerprint alone
    alike = neardup.links(docs, signed.withColumn("fp", F.lit(7).cast("long")).withColumn("keys", F.expr("cast(array() as array<bigint>)")), 4, 5, 5, "text").collect()
    least = min(got)
    assert {frozenset(e) for e in alike} == {frozenset((least, u)) for u in got if u != least and linked(u, least)}
