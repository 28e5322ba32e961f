"""Solvers against optimality conditions and against slow independent solutions."""

import numpy as np
import pytest

from tidepanel.operators import certificates, solvers
from tidepanel.operators.solvers import capped_simplex, equal_risk, equal_risk_capped, min_variance, solve
from tidepanel.operators.universe import Roster


def covariances(count, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 36, n)) * rng.uniform(0.02, 0.2, size=(count, 1, n)) + rng.normal(size=(count, 36, 1)) * 0.03
    return np.einsum("bti,btj->bij", x, x) / 36


@pytest.mark.parametrize("n,cap", [(2, 0.0), (5, 0.3), (8, 0.2), (8, 0.5), (4, 0.25), (3, 0.2)])
def test_projection_against_bisection(n, cap):
    v = np.random.default_rng(n).normal(size=(2000, n)) * 3
    w = capped_simplex(v, cap)
    top = cap if 0 < cap < 1 and n * cap >= 1 else 1.0
    lo, hi = v.min(axis=1) - 2, v.max(axis=1)
    for _ in range(200):
        mid = (lo + hi) / 2
        over = np.clip(v - mid[:, None], 0, top).sum(axis=1) > 1
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    assert np.abs(w - np.clip(v - lo[:, None], 0, top)).max() < 1e-9
    assert np.abs(w.sum(axis=1) - 1).max() < 1e-9


@pytest.mark.parametrize("n,cap", [(3, 0.0), (5, 0.35), (8, 0.35)])
def test_min_variance_is_optimal(n, cap):
    cov = covariances(300, n)
    w = min_variance(cov, cap)
    g = np.einsum("bij,bj->bi", cov, w)
    top = cap if cap else 1.0
    scale = np.abs(g).max(axis=1)
    # No feasible exchange of weight from i to j lowers the variance.
    can_drop, can_add = w > 1e-6, w < top - 1e-6
    worst = np.where(can_drop, g, -np.inf).max(axis=1) - np.where(can_add, g, np.inf).min(axis=1)
    assert (worst / scale).max() < 1e-3


def test_equal_risk_contributions():
    cov = covariances(500, 6)
    w = equal_risk(cov)
    share = w * np.einsum("bij,bj->bi", cov, w)
    share /= share.sum(axis=1, keepdims=True)
    assert np.abs(share - 1 / 6).max() < 1e-8
    assert np.abs(w.sum(axis=1) - 1).max() < 1e-12


def test_capped_equal_risk_kkt():
    cov = covariances(300, 5) * 400
    w = equal_risk_capped(cov, 0.25)
    g = np.einsum("bij,bj->bi", cov, w) - 1 / (5 * w)
    inner = w < 0.25 - 1e-7
    assert (w.max(axis=1) > 0.25 - 1e-9).any()
    inner_g = np.where(inner, g, np.nan)
    assert np.nanmax(np.nanmax(inner_g, axis=1) - np.nanmin(inner_g, axis=1)) < 1e-5
    # A capped member would like to grow: its gradient is not above the free ones.
    gap = np.where(inner, -np.inf, g).max(axis=1) - np.nanmax(inner_g, axis=1)
    assert gap.max() < 1e-5


def test_post_hoc_cap_and_infeasible_cap():
    cov = covariances(100, 5)
    assert solve("erc", cov, 0.22, "posthoc").max() <= 0.22 + 1e-9
    assert np.allclose(solve("erc", cov, 0.1, "capped"), 0.2)
    assert np.allclose(solve("minvar", cov, 0.1, "capped").sum(axis=1), 1.0)


def weight_rows(spark, kind, cap, mode, change=None):
    """Solved portfolios of the first sizes over one random covariance, optionally moved off their optimum."""
    rng = np.random.default_rng(8)
    n = 6
    x = rng.normal(size=(60, n)) * np.array([0.05, 0.1, 0.2, 0.1, 0.02, 0.3])
    c = np.cov(x.T)
    names = tuple("abcdef")
    roster = Roster(names, names[:2], names[2:4])
    cov = spark.createDataFrame([(0, 1, c.ravel().tolist())], "window_id int, refit_no int, cov array<double>")
    problems = spark.createDataFrame([(0, m, m.bit_count()) for m in range(1, 64) if m.bit_count() >= 4], "window_id int, mask bigint, n_sleeves int")
    w = solvers.solver_weights(problems, cov, roster, [kind], cap, mode, partitions=2).toPandas()
    if change:
        for r in range(len(w)):
            held = [f"b_{i}" for i in range(n) if w.at[r, "mask"] >> i & 1]
            lightest, heaviest = w.loc[r, held].astype(float).idxmin(), w.loc[r, held].astype(float).idxmax()
            moved = min(change, w.at[r, heaviest] / 2, cap - w.at[r, lightest] if cap else 1)
            w.at[r, heaviest] -= moved
            w.at[r, lightest] += moved
    return spark.createDataFrame(w), cov, roster


@pytest.mark.parametrize("kind,cap,mode,bound", [("minvar", 0.35, "capped", 1e-5), ("erc", 0.0, "none", 1e-7), ("erc", 0.35, "capped", 1e-7)])
def test_certificates_tell_solved_from_moved(spark, kind, cap, mode, bound):
    gap = {("minvar", "capped"): lambda *a: certificates.minimum_variance_gap(*a, cap), ("erc", "none"): certificates.equal_risk_gap,
           ("erc", "capped"): lambda *a: certificates.capped_risk_gap(*a, cap)}[kind, mode]
    good = gap(*weight_rows(spark, kind, cap, mode)).toPandas()
    assert len(good) == 22 and good["gap"].max() <= bound
    moved = gap(*weight_rows(spark, kind, cap, mode, 0.02)).toPandas()
    assert (moved["gap"] > 10 * bound).all()


def test_own_schemes_are_shipped_and_made_usable(spark):
    def odd(cov, vol, cap, mode):
        w = 1.0 / vol
        w[::3] = np.nan
        w[1::3, 0] = -1.0
        return w

    _, cov, roster = weight_rows(spark, "minvar", 0.35, "capped")
    problems = spark.createDataFrame([(0, m, m.bit_count()) for m in range(1, 64) if m.bit_count() >= 4], "window_id int, mask bigint, n_sleeves int")
    got = solvers.solver_weights(problems, cov, roster, [], 0.35, partitions=1, own={"odd": odd}).toPandas()
    w = got[[f"b_{i}" for i in range(6)]].to_numpy()
    assert len(got) == 22 and set(got["base"]) == {"odd"}
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w.max() <= 0.35 + 1e-9
    with pytest.raises(Exception, match="shape"):
        solvers.solver_weights(problems, cov, roster, [], 0.35, partitions=1, own={"bad": lambda cov, vol, cap, mode: vol[:, :1]}).count()


def test_matrices_beyond_the_bound_ride_along(spark, monkeypatch):
    _, cov, roster = weight_rows(spark, "minvar", 0.35, "capped")
    problems = spark.createDataFrame([(0, 15, 4), (0, 63, 6)], "window_id int, mask bigint, n_sleeves int")
    run = lambda: solvers.solver_weights(problems, cov, roster, ["minvar"], 0.35, partitions=1).orderBy("mask").toPandas()
    one = run()
    monkeypatch.setattr(solvers, "MATRIX_BYTES", 0)
    assert np.allclose(run()[["b_0", "b_3", "b_5"]], one[["b_0", "b_3", "b_5"]])
