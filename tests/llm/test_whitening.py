"""Whitening against numpy's own eigenvectors and whole-number arithmetic, and on awkward vectors."""

import math

import numpy as np
import pytest

from tidepanel.llm import whitening as wh
from tidepanel.llm.queries import table
from tidepanel.llm.registry import QUERIES, ship

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("spectrum", [np.arange(1.0, 33), 2.0 ** -np.arange(30), np.array([5.0, 5, 5, 5, 1, 1, 1]), np.array([3.0, 3 * (1 - 1e-9), 2, 1, 0, 0]), np.ones(6),
                                      np.array([1.0]), np.array([1e12, 1.0, 1e-9]), np.zeros(4), np.array([2.0, 1, 1, 1, 1, 0])])
def test_components(spectrum):
    n = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    k = min(8, n)
    values, vectors = wh.components(a.astype(np.longdouble), k)
    assert np.allclose(values, np.sort(spectrum)[::-1][:k], rtol=1e-12, atol=1e-14 * n * spectrum.max())
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * n * max(spectrum.max(), 1e-300)


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((40, 40))
    a = a + a.T
    e, q = np.linalg.eigh(a)
    assert np.abs(wh.polar(a) - (q * np.sign(e)) @ q.T).max() < 1e-11


def by_force(rows):
    """Whole numbers by Python, eigenvectors by numpy."""
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in kept])
    e, q = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, dev, y @ q[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]), e[::-1][:8] / e.sum()


def test_query(spark):
    got = QUERIES["op11_whitening"](spark, SMALL).collect()
    ids, n, dev, white, explained = by_force([(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == 8 * n
    assert all(by[i, c + 1].deviation == d and by[i, c + 1].n == n for i, d in zip(ids, dev) for c in range(8))
    made = np.array([[by[i, c + 1].whitened for c in range(8)] for i in ids])
    signs = np.sign((made * white).sum(axis=0))
    assert np.abs(made - white * signs).max() < 1e-9
    assert np.allclose([by[ids[0], c + 1].explained for c in range(8)], explained, rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_awkward_vectors(spark):
    ship(spark)
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.25, -1.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]),
            (5, [float("-inf"), 1.0, 2.0]), (6, [0.1]), (7, []), (8, [0.3, 0.2, 0.1])]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, embedding array<float>, whitened double, x int")
    got = wh.whiten(df, "vec_id", "embedding").collect()
    fill = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, v in rows]
    fill = [(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v in fill]
    ids, n, dev, white, _ = by_force(fill)
    assert n == 6 and len(got) == 3 * n and {r.id for r in got} == {1, None, 6, 7, 8}
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(dev)
    assert got[0].identity_error < 1e-9
    first = {r.id: r.whitened for r in got if r.component == 1}
    sign = math.copysign(1, first[8] * white[ids.index(8), 0])
    assert all(abs(first[i] * sign - white[ids.index(i), 0]) < 1e-9 for i in first)
    for few in (rows[3:4], rows[:2], []):
        assert wh.whiten(spark.createDataFrame([r for r in few], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_huge_entries(spark):
    """Where whole numbers do not fit, doubles; the deviation stays whole, or null beyond 38 digits."""
    ship(spark)
    rows = [(k, [1e9 * math.sin(k), 1e30 if k == 3 else 0.0]) for k in range(40)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 2).collect()
    assert len(got) == 80 and got[0].identity_error < 1e-6 and all(r.deviation is not None for r in got)
