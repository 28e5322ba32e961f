"""URL rules by Bloom filter cascades: exact membership over the corpus's keys, without a join.

A rule is (host, path, verdict). It fits a url if the url's host is the rule's or a subdomain of it and the url's path starts with the rule's. Of the rules that
fit, the one with the longest ``host + path`` wins (ties: more host labels; ``block`` before ``allow``). A url that no rule fits is allowed: the cascades say, exactly, that none of
its keys is listed.

Keys. A url is looked up under each *shape* (host labels, path length) that the rules have: its last labels and the start of its path. So a url has no
more keys than the rules have shapes, whatever its length. The distinct keys of all urls and the listed keys are the universe.

Cascade (one for each verdict). Level 1 encodes the listed keys; level 2 the keys of the universe that pass level 1 and are not listed; level 3 the listed keys that pass level 2;
and so on, until no key passes wrongly. A key is listed if the number of levels that it passes in a row is odd. Level 1 lets ``listed / (sqrt(2) others)`` of the other keys pass and
later levels a half, so all levels together hold about ``listed * (1.44 log2(others / listed) + 5)`` bits, whatever the corpus holds besides.

Keys are known by 128 bits of hash. A cascade that stops shrinking (two keys with equal hashes, one listed) is an error, never a wrong answer.

Spread: keys are made distinct before anything else (map-side, so a hot host shrinks first); levels are bit-or aggregates over words. Only the words of the
filters are collected and broadcast, and their size is known before: listed keys are dealt by hash into shards of at most ``shard_keys`` keys, each with cascades of its own, all built by the
same jobs. Shards are broadcast one after another and each answers for its own keys.

Defined cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; a host without labels in common is allowed; rules with a null part are
ignored, repeated ones count once; empty tables give no rows; no rules: everything is allowed; the columns of the table are kept in one struct, so no name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.session import materialize

SHARD_KEYS = 8_000_000
MAX_LEVELS = 64
VERDICTS = ("block", "allow")


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; path: on from there up to ? or #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


# one level of a cascade

@dataclass(frozen=True)
class Level:
    """A Bloom filter per shard; ``bits[s]`` and ``hashes[s]`` are 0 where it is empty, ``words`` is a table (shard, word, value)."""
    number: int
    bits: np.ndarray
    hashes: np.ndarray
    words: DataFrame


def scrambled(x: np.ndarray, number: int) -> np.ndarray:
    """The published finalizer of 64-bit mixing, from another start for each level."""
    z = x + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def places(h1: np.ndarray, h2: np.ndarray, number: int, bits: np.ndarray, turn: int) -> np.ndarray:
    """Bit of each key under its ``turn``-th hash; ``bits`` is the filter's size for each key."""
    a, b = scrambled(h1, 2 * number), scrambled(h2, 2 * number + 1) | np.uint64(1)
    return (a + np.uint64(turn) * b) % bits


def longs(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.int64).view(np.uint64)


def encode(keys: DataFrame, number: int, bits: np.ndarray, hashes: np.ndarray) -> Level:
    """Set the bits of keys (h1, h2, shard): one bit-or per word over all tasks."""
    @F.pandas_udf("array<long>")
    def positions(h1: pd.Series, h2: pd.Series, shard: pd.Series) -> pd.Series:
        s = shard.to_numpy(dtype=np.int64)
        a, b, m, k = longs(h1), longs(h2), bits[s].astype(np.uint64), hashes[s]
        turns = [places(a, b, number, m, t).astype(np.int64) for t in range(int(k.max(initial=0)))]
        return pd.Series([[int(p[i]) for p in turns[:k[i]]] for i in range(len(s))])

    at = keys.select("shard", F.explode(positions("h1", "h2", "shard")).alias("at"))
    words = at.groupBy("shard", F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value"))
    return Level(number, bits, hashes, materialize(words))


def gathered(level: Level, shards: Sequence[int]) -> dict:
    """The words of some shards, for a broadcast; at most bits / 8 bytes, known before they are collected."""
    sizes = {s: (int(level.bits[s]) + 63) // 64 for s in shards}
    start = dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist()))
    held = np.zeros(sum(sizes.values()), dtype=np.uint64)
    part = level.words.filter(F.col("shard").between(min(shards), max(shards))).toArrow()
    if part.num_rows:
        shard, word = part["shard"].to_numpy(), part["word"].to_numpy()
        held[np.array([start.get(s, 0) for s in range(max(shards) + 1)])[shard] + word] = part["value"].to_numpy().view(np.uint64)
    count = max(shards) + 1
    spread = lambda values: np.array([values.get(s, 0) for s in range(count)], dtype=np.uint64)
    return {"number": level.number, "start": spread(start), "bits": spread({s: int(level.bits[s]) for s in shards}),
            "hashes": spread({s: int(level.hashes[s]) for s in shards}), "words": held}


def passing(held: dict, h1: np.ndarray, h2: np.ndarray, shard: np.ndarray) -> np.ndarray:
    bits, hashes, start = held["bits"][shard], held["hashes"][shard], held["start"][shard]
    ok = bits > 0
    for t in range(int(hashes.max(initial=0))):
        live = np.flatnonzero(ok & (hashes > t))
        at = places(h1[live], h2[live], held["number"], bits[live], t)
        words = held["words"][(start[live] + (at >> np.uint64(6))).astype(np.int64)]
        ok[live] = (words >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def listed(levels: Iterable[dict], h1: np.ndarray, h2: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: an odd number of levels passed in a row."""
    depth = np.zeros(len(h1), dtype=np.int64)
    live = np.arange(len(h1))
    for held in levels:
        live = live[passing(held, h1[live], h2[live], shard[live])]
        depth[live] += 1
    return depth % 2 == 1


# cascades

def that_pass(keys: DataFrame, level: Level, groups: Sequence[Sequence[int]]) -> DataFrame:
    """Keys (h1, h2, shard) that pass a level; shards are broadcast one group after another."""
    def test(held):
        @F.pandas_udf("boolean")
        def ok(h1: pd.Series, h2: pd.Series, shard: pd.Series) -> pd.Series:
            return pd.Series(passing(held.value, longs(h1), longs(h2), shard.to_numpy(dtype=np.int64)))
        return ok("h1", "h2", "shard")

    out = keys.limit(0)
    for shards in groups:
        mine = keys.filter(F.col("shard").between(min(shards), max(shards)))
        out = out.unionByName(mine.filter(test(keys.sparkSession.sparkContext.broadcast(gathered(level, shards)))))
    return out


def per_shard(keys: DataFrame, shards: int) -> np.ndarray:
    counts = np.zeros(shards, dtype=np.int64)
    for r in keys.groupBy("shard").count().collect():
        counts[r["shard"]] = r["count"]
    return counts


def cascade(keys: DataFrame, universe: DataFrame, shards: int, groups: Sequence[Sequence[int]]) -> list[Level]:
    """Levels that tell ``keys`` from the rest of ``universe``; both are distinct (h1, h2, shard)."""
    inside, outside, levels = keys, universe, []
    n_in, n_out = per_shard(inside, shards), per_shard(outside, shards)
    while n_in.sum():
        if len(levels) == MAX_LEVELS:
            raise ValueError("two different keys have equal hashes")
        share = n_in / (math.sqrt(2) * np.maximum(n_out, 1)) if not levels else np.full(shards, 0.5)
        hashes = np.where(n_in > 0, np.maximum(1, np.ceil(-np.log2(np.clip(share, 2.0**-50, 0.5)))), 0).astype(np.int64)
        bits = np.ceil(n_in * hashes / math.log(2)).astype(np.int64)
        levels.append(encode(inside, len(levels), bits, hashes))
        passed = that_pass(outside, levels[-1], groups)
        if len(levels) == 1:
            # the truth about the few that pass; no other key takes part
            passed = passed.join(keys, ["h1", "h2", "shard"], "left_anti")
        inside, outside = materialize(passed), inside
        n_in = per_shard(inside, shards)
    return levels


def with_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def dealt(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select("h1", "h2", F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).distinct()


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``row`` (the page's columns), host, path, rule (``host + path`` of the rule that wins, else null), verdict (allow or block)."""
    spark = pages.sparkSession
    rule = materialize(rules.filter("host is not null and path is not null and host <> ''").filter(F.col("verdict").isin(*VERDICTS)).select(
        lowered(F.col("host")).alias("host"), "path", "verdict"))
    listing = rule.select("verdict", *with_hashes(F.concat("host", "path")))
    shapes = rule.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("n"), F.length("path").alias("len")).distinct().collect()
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    known = F.array(*[F.struct(F.lit(int(s["n"])).alias("n"), F.lit(int(s["len"])).alias("len")) for s in shapes])
    keyed = rows.withColumn("shapes", known).withColumn("labels", F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).withColumn("keys", F.expr(
        "transform(array_sort(transform(filter(shapes, s -> labels >= s.n and length(path) >= s.len and host <> ''), s -> named_struct("
        "'size', -length(substring_index(host, '.', -s.n)) - s.len, 'n', -s.n, 'key', concat(substring_index(host, '.', -s.n), substring(path, 1, s.len))))), x -> x.key)")) \
        .select("row", "host", "path", "keys")
    shards = max(1, math.ceil(rule.count() / shard_keys))
    # keys are dealt evenly by hash, so a shard holds about shard_keys and one is broadcast at a time
    groups = [[s] for s in range(shards)]
    universe = materialize(dealt(keyed.select(F.explode("keys").alias("key")).select(*with_hashes(F.col("key"))), shards))
    cascades = {v: cascade(materialize(dealt(listing.filter(F.col("verdict") == v), shards)), universe, shards, groups) for v in VERDICTS}

    def first_listed(shard: int, held):
        @F.pandas_udf("int")
        def first(h1: pd.Series, h2: pd.Series, before: pd.Series) -> pd.Series:
            """Twice the place of the first listed key, plus its verdict; keys of other shards wait for theirs."""
            sizes = h1.str.len().to_numpy(dtype=np.int64)
            a, b = (np.concatenate([*c, np.zeros(0, dtype=np.int64)]).astype(np.int64) for c in (h1, h2))
            place = np.concatenate([*map(np.arange, sizes), np.zeros(0, dtype=np.int64)]).astype(np.int64)
            mine = np.flatnonzero(np.mod(a, shards) == shard)
            a, b, place, owner = a[mine].view(np.uint64), b[mine].view(np.uint64), place[mine], np.repeat(np.arange(len(sizes)), sizes)[mine]
            found = before.astype("float64").fillna(np.inf).to_numpy(copy=True)
            for v, levels in enumerate(held.value):
                hit = listed(levels, a, b, np.full(len(a), shard)) if levels else np.zeros(len(a), dtype=bool)
                np.minimum.at(found, owner[hit], 2 * place[hit] + v)
            return pd.Series(found).replace(np.inf, np.nan).astype("Int32")

        return first(F.transform("keys", lambda k: with_hashes(k)[0]), F.transform("keys", lambda k: with_hashes(k)[1]), "best")

    best = keyed.withColumn("best", F.lit(None).cast("int"))
    for shard in range(shards):
        held = spark.sparkContext.broadcast([[gathered(level, [shard]) for level in cascades[v]] for v in VERDICTS])
        best = best.withColumn("best", first_listed(shard, held))
        if shard + 1 < shards:
            best = materialize(best)
    verdict = F.when(F.col("best") % 2 == 0, VERDICTS[0]).otherwise(VERDICTS[1])
    return best.select("row", "host", "path", F.expr("try_element_at(keys, cast(best div 2 as int) + 1)").alias("rule"), verdict.alias("verdict"))
