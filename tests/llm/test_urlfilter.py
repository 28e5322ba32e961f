"""URL rules against plain Python, the cascades' exactness, and awkward urls."""

import random
import re

import numpy as np

from tidepanel.llm import urlfilter as uf
from tidepanel.llm.registry import ship


def by_force(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), h.count("."), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    won = max(fits, default=None)
    return host, path, won and won[3], won[4] if won else "allow"


ODD = [None, "", "no scheme", "://", "http://", "http://Org", "http://org/", "HTTP://A.B.Example.ORG/es/x?y=/es/#z", "x://y://z/a", "http://example.org?/es/", "http://example.org#/es/",
       "http://exámple.COM/fr/É?", "http://.com/de/", "http://com./de/", "http://notcom/de/", "http://a..com/de/", "http://" + "a." * 5000 + "com/de/" + "p" * 20000, "http://u:p@h.com:80/fr/1"]


def test_rules(spark):
    ship(spark)
    rng = random.Random(3)
    hosts = ["".join(rng.choice("ab.") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6))) for _ in range(60)]
    rules = [(rng.choice(hosts), rng.choice([*paths, ""]), rng.choice(["allow", "block"])) for _ in range(700)]
    rules += [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), rules[0]]
    urls = ODD + [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#t'])}" for _ in range(3000)]
    urls += ["http://hot.com/de/1"] * 1500
    pages = spark.createDataFrame([(k, u, "r", 0) for k, u in enumerate(urls)], "page_id long, url string, host string, keys int")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("", "/", "block"), ("a", "/", "other")], "host string, path string, verdict string")
    for shard_keys in (uf.SHARD_KEYS, 250):  # one shard, and three that are broadcast in turn
        got = uf.judge(pages, listed, shard_keys=shard_keys).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == by_force(r.row.url, rules), r.row.url


def test_cascade_is_exact(spark):
    """40,000 keys, 3,000 of them listed: every level is used and no key is wrong."""
    ship(spark)
    keys = spark.range(40_000).selectExpr("xxhash64(id) h1", "xxhash64('b', id) h2", "id")
    all_keys = uf.dealt(keys, 2)
    chosen = uf.dealt(keys.filter("id % 13 = 5 and id < 39000"), 2)
    levels = uf.cascade(chosen, all_keys, 2, [[0], [1]])
    assert len(levels) > 3
    bits = sum(level.bits.sum() for level in levels)
    assert bits < chosen.count() * (1.44 * np.log2(13) + 6)
    want = {(r.h1, r.h2) for r in chosen.collect()}
    for s in (0, 1):
        rows = all_keys.filter(f"shard = {s}").toPandas()
        held = [uf.gathered(level, [s]) for level in levels]
        found = uf.listed(held, uf.longs(rows.h1), uf.longs(rows.h2), rows.shard.to_numpy(dtype=np.int64))
        assert [(a, b) in want for a, b in zip(rows.h1, rows.h2)] == found.tolist()


def test_nothing(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    assert uf.judge(pages.limit(0), rules).count() == 0
    assert [(r.rule, r.verdict) for r in uf.judge(pages, rules.limit(0)).collect()] == [(None, "allow")]
    assert [(r.rule, r.verdict) for r in uf.judge(pages, rules).collect()] == [("org/", "block")]
