"""The language model of op4 against plain Python, with each character a symbol of its own."""

import collections
import math
import random

import numpy as np
import pytest

from tidepanel.llm import perplexity
from tidepanel.llm.registry import ship


def model_by_force(texts):
    """Log perplexity of each text under modified Kneser-Ney over its characters, by dictionaries of strings."""
    start = "\udfff" * 3
    levels = [collections.Counter(t[k - 3:k + 1] for t in (start + x.lower() for x in texts) for k in range(3, len(t)))]
    while len(levels) < 4:
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    p = {"": 2.0 ** -(len(levels[0]) + 1).bit_length()}
    for level in levels:
        of = [sum(n == k for n in level.values()) for k in range(1, 5)]
        y = of[0] / max(1, of[0] + 2 * of[1])
        cut = [0] + [min(k, max(0.05 * k, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0.5 * k for k in (1, 2, 3)]
        total, dropped = collections.Counter(), collections.Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            dropped[g[:-1]] += cut[min(n, 3)]
        for g, n in level.items():
            p[g] = (n - cut[min(n, 3)] + dropped[g[:-1]] * p[g[1:]]) / total[g[:-1]]
    return [-sum(math.log(p[(start + t.lower())[k:k + 4]]) for k in range(len(t))) / len(t) for t in texts]


def rows_of(rng):
    words = ["мама", "мыла", "раму", "日本語", "wörd", "end", "\U0001f600", "a\x00b", "é", "42", "7\t"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]


@pytest.mark.parametrize("most_grams, most_points", [(1 << 20, 1 << 15), (10, 1 << 15), (1 << 20, 10)])
def test_model_against_plain_python(spark, monkeypatch, most_grams, most_points):
    """Models that are broadcast, and both kinds that are too large for it."""
    ship(spark)
    monkeypatch.setattr(perplexity, "HELD_GRAMS", most_grams)
    monkeypatch.setattr(perplexity, "MOST_POINTS", most_points)
    texts = rows_of(random.Random(5))
    docs = spark.createDataFrame([*enumerate(texts), (100, ""), (101, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'ru' lang")
    got = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert len(got) == 42 and got[100].log_perplexity is None and got[101].log_perplexity is None and got[101].n_words == 0
    for k, want in enumerate(model_by_force(texts)):
        assert got[k].log_perplexity == pytest.approx(want, rel=1e-5) and got[k].n_words == len(texts[k].split())


def test_letters_22_apart_are_different(spark):
    """Code points that a fold to 22 groups would merge."""
    ship(spark)
    rng = random.Random(7)
    plain = [" ".join("".join(rng.choice("абвгд") for _ in range(4)) + rng.choice("xyz") * rng.randrange(1, 5) for _ in range(90)) for _ in range(120)]
    moved = plain[0].translate({ord(c): chr(ord(c) + 22) for c in "абвгд"})
    docs = spark.createDataFrame([*enumerate([*plain, moved])], "doc_id long, text string").selectExpr("doc_id", "text", "'ru' lang")
    got = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert not got[120].base_failed and not got[120].kept and sum(got[k].kept for k in range(120)) >= 118
    assert got[120].log_perplexity > got[0].log_perplexity + 0.1


def test_ngrams_of_more_characters_than_numbers():
    """A text of 70,000 different characters: its n-grams are no 64-bit numbers."""
    text = np.random.default_rng(1).permutation(np.arange(0x10000, 0x10000 + 70000, dtype=np.uint32))
    before, last, times = perplexity.distinct_grams([text, text[:5]])
    assert len(last) == 70000 and times.sum() == 70005 and times.max() == 2
    at = {int(x): int(b) for x, b in zip(last, before)}
    assert all(at[int(text[k]) + 1] == sum((int(text[k - 1 - j]) + 1) << 21 * j for j in range(3)) for k in range(3, 2000))
