"""Iterative weights (equal risk, minimum variance) as a distributed batch job.

Spark spreads the (portfolio, refit) rows; inside a task each Arrow batch is grouped by
portfolio size and all its problems step together as one stack of small matrices.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from tidepanel.operators.universe import Roster

FEASIBLE = 1e-12


def capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """Rows of ``v`` projected onto {0 <= w <= cap, sum w = 1}; an infeasible cap is dropped.

    sum(clip(v - tau, 0, cap)) falls piecewise linearly in tau, so the exact tau lies between
    two neighbouring kinks.
    """
    n = v.shape[1]
    if not 0.0 < cap < 1.0 or n * cap < 1.0 - FEASIBLE:
        cap = 1.0
    v = v - v.max(axis=1, keepdims=True)
    kinks = np.sort(np.concatenate([v, v - cap], axis=1), axis=1)
    mass = np.clip(v[:, None, :] - kinks[:, :, None], 0.0, cap).sum(axis=2)
    hi = np.clip((mass >= 1.0).sum(axis=1), 1, 2 * n - 1)
    row = np.arange(len(v))
    t0, t1, m0, m1 = kinks[row, hi - 1], kinks[row, hi], mass[row, hi - 1], mass[row, hi]
    drop = np.where(m0 - m1 > 0, m0 - m1, 1.0)
    tau = t0 + (m0 - 1.0) * (t1 - t0) / drop
    return np.clip(v - tau[:, None], 0.0, cap)


def min_variance(cov: np.ndarray, cap: float, steps: int = 800, tol: float = 1e-9) -> np.ndarray:
    """min w'Sw on the capped simplex: accelerated projected gradient with restarts."""
    risk = np.einsum("bii->bi", cov)
    start = 1.0 / np.maximum(risk, 1e-12)
    w = capped_simplex(start / start.sum(axis=1, keepdims=True), cap)
    rate = 1.0 / np.maximum(np.linalg.eigvalsh(cov)[:, -1], 1e-12)[:, None]
    y, speed = w.copy(), np.ones((len(w), 1))
    live = np.arange(len(w))
    for _ in range(steps):
        c, old = cov[live], w[live]
        new = capped_simplex(y[live] - rate[live] * np.einsum("bij,bj->bi", c, y[live]), cap)
        uphill = (np.einsum("bij,bj->bi", c, new) * new).sum(1) > (np.einsum("bij,bj->bi", c, old) * old).sum(1)
        s = np.where(uphill[:, None], 1.0, speed[live])
        s_next = (1.0 + np.sqrt(1.0 + 4.0 * s * s)) / 2.0
        y[live] = np.where(uphill[:, None], old, new + (s - 1.0) / s_next * (new - old))
        speed[live] = np.where(uphill[:, None], 1.0, s_next)
        new = np.where(uphill[:, None], old, new)
        done = (np.abs(new - old).max(axis=1) < tol) & ~uphill
        w[live] = new
        live = live[~done]
        if not len(live):
            break
    return w


def equal_risk(cov: np.ndarray, sweeps: int = 500, tol: float = 1e-10) -> np.ndarray:
    """min 0.5 w'Sw - (1/n) sum ln w by cyclic coordinate descent, then scaled to sum 1."""
    n = cov.shape[1]
    diag = np.maximum(np.einsum("bii->bi", cov), 1e-12)
    w = 1.0 / np.sqrt(diag)
    w /= w.sum(axis=1, keepdims=True)
    w /= np.sqrt(np.maximum(np.einsum("bi,bij,bj->b", w, cov, w), 1e-30))[:, None]
    live = np.arange(len(w))
    for _ in range(sweeps):
        x, c, d = w[live], cov[live], diag[live]
        before = x.copy()
        for i in range(n):
            cross = np.einsum("bj,bj->b", c[:, i, :], x) - c[:, i, i] * x[:, i]
            x[:, i] = (np.sqrt(cross * cross + 4.0 * d[:, i] / n) - cross) / (2.0 * d[:, i])
        w[live] = x
        moved = (np.abs(x - before) / np.maximum(before, 1e-12)).max(axis=1)
        live = live[moved >= tol]
        if not len(live):
            break
    return w / w.sum(axis=1, keepdims=True)


def equal_risk_capped(cov: np.ndarray, cap: float, steps: int = 1200, tol: float = 1e-9) -> np.ndarray:
    """min 0.5 w'Sw - (1/n) sum ln w over {w <= cap, sum w = 1}.

    Each step bounds the quadratic by its largest curvature and keeps the barrier exact, so
    the step separates into one scalar equation for the multiplier of the budget.
    """
    count, n = cov.shape[0], cov.shape[1]
    if n * cap < 1.0 - FEASIBLE:
        return np.full((count, n), 1.0 / n)
    curve = np.maximum(np.linalg.eigvalsh(cov)[:, -1], 1e-12)[:, None]
    w = np.full((count, n), 1.0 / n)
    live = np.arange(count)
    for _ in range(steps):
        x, lam = w[live], curve[live]
        z = x - np.einsum("bij,bj->bi", cov[live], x) / lam
        room = 4.0 / (n * lam)

        def member(tau):
            a = z - tau
            # The smaller root is written by its conjugate where a < 0, to keep its digits.
            root = np.sqrt(a * a + room)
            return np.minimum(np.where(a >= 0, (a + root) / 2.0, room / (2.0 * (root - a))), cap)

        # The multiplier is bracketed by the values that put every series at 1/n or the cap.
        at = lambda level: z - (level - 1.0 / (n * lam * level))
        lo, hi = at(cap).min(axis=1, keepdims=True), at(1.0 / n).max(axis=1, keepdims=True)
        lo = np.minimum(lo, at(1.0 / n).min(axis=1, keepdims=True))
        for _ in range(80):
            mid = (lo + hi) / 2.0
            over = member(mid).sum(axis=1, keepdims=True) > 1.0
            lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        new = member((lo + hi) / 2.0)
        w[live] = new
        live = live[np.abs(new - x).max(axis=1) >= tol]
        if not len(live):
            break
    return w


def _cap(w: np.ndarray, cap: float) -> np.ndarray:
    """Clip and spread the excess equally over the free members (rows of ``w``)."""
    n = w.shape[1]
    w = w / w.sum(axis=1, keepdims=True)
    if not 0.0 < cap < 1.0:
        return w
    if n * cap < 1.0:
        return np.full_like(w, 1.0 / n)
    for _ in range(n):
        over = w >= cap
        excess = np.maximum(w - cap, 0.0).sum(axis=1, keepdims=True)
        free = np.maximum((~over).sum(axis=1, keepdims=True), 1)
        w = np.where(over, cap, w + excess / free)
    return w / w.sum(axis=1, keepdims=True)


#: A caller's scheme: covariances (batch, n, n), volatilities (batch, n), the cap and the cap mode give weights (batch, n).
Scheme = Callable[[np.ndarray, np.ndarray, float, str], np.ndarray]


def allowed_weights(w: np.ndarray, cap: float) -> np.ndarray:
    """What any scheme returns, made usable: not finite or without a positive sum is equal weight, negative is zero, the rest sums to one under the cap."""
    n = w.shape[1]
    w = np.where(np.isfinite(w).all(axis=1, keepdims=True), np.maximum(w, 0.0), 0.0)
    w = np.where(w.sum(axis=1, keepdims=True) > 0, w, 1.0 / n)
    return _cap(w, cap)


def solve(kind: str, cov: np.ndarray, cap: float, erc_cap_mode: str, own: Mapping[str, Scheme] | None = None) -> np.ndarray:
    capped = 0.0 < cap < 1.0
    n = cov.shape[1]
    if own and kind in own:
        vol = np.sqrt(np.maximum(np.einsum("bii->bi", cov), 1e-12))
        w = np.asarray(own[kind](cov, vol, cap, erc_cap_mode), dtype=float)
        if w.shape != vol.shape:
            raise ValueError(f"{kind} gave weights of shape {w.shape} for {vol.shape}")
        return allowed_weights(w, cap)
    if kind == "minvar":
        w = min_variance(cov, cap if capped else 0.0)
        own_cap = True
    elif kind == "erc":
        own_cap = capped and erc_cap_mode == "capped"
        w = equal_risk_capped(cov, cap) if own_cap else equal_risk(cov)
    else:
        raise ValueError(f"unknown solver {kind}")
    bad = ~np.isfinite(w).all(axis=1) | (np.nan_to_num(w).sum(axis=1) <= 0)
    w = np.where(bad[:, None], 1.0 / n, w)
    if kind == "erc" and erc_cap_mode == "none":
        return w / w.sum(axis=1, keepdims=True)
    loose = (w.max(axis=1) > cap + 1e-6) if own_cap and capped else np.full(len(w), capped and not own_cap)
    scaled = w / w.sum(axis=1, keepdims=True)
    return np.where(loose[:, None], _cap(w, cap), scaled) if loose.any() else scaled


MATRIX_BYTES = 256 << 20  # covariances that are broadcast; beyond, each problem row carries its own


def solver_weights(problems: DataFrame, cov: DataFrame, roster: Roster, kinds: Sequence[str],
                   cap: float, erc_cap_mode: str = "capped", partitions: int | None = None, own: Mapping[str, Scheme] | None = None) -> DataFrame:
    """``(window_id, mask, n_sleeves, refit_no, base, b_0 ..)`` for every problem and kind.

    ``problems`` is ``(window_id, mask, n_sleeves)``; ``cov`` has one row per (window, refit): a calendar's worth, broadcast to the tasks once after its
    size is checked, so a problem is a few numbers and the task cuts the sub-matrix of its portfolio. ``own`` maps further
    kinds to callers' functions, which travel with the job by value and see all problems of one size in a batch at once.
    """
    # The solver functions travel with the job, so executors need no copy of the package.
    for module in {__name__, *(fn.__module__ for fn in (own or {}).values() if getattr(fn, "__module__", "__main__") != "__main__")}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    n, kinds, spark = roster.n, (*kinds, *(own or {})), problems.sparkSession
    schema = T.StructType([
        T.StructField("window_id", T.IntegerType()), T.StructField("mask", T.LongType()),
        T.StructField("n_sleeves", T.IntegerType()), T.StructField("refit_no", T.IntegerType()),
        T.StructField("base", T.StringType()),
        *[T.StructField(f"b_{i}", T.DoubleType()) for i in range(n)]])
    keys = [(r["window_id"], r["refit_no"]) for r in cov.select("window_id", "refit_no").distinct().limit(MATRIX_BYTES // (8 * n * n) + 1).collect()]
    if len(keys) * n * n * 8 <= MATRIX_BYTES:
        rows = cov.select("window_id", "refit_no", "cov").collect()
        held = spark.sparkContext.broadcast(np.array([r["cov"] for r in rows], dtype=float).reshape(-1, n, n))
        matrices = spark.createDataFrame([(r["window_id"], r["refit_no"], k) for k, r in enumerate(rows)], "window_id int, refit_no int, matrix int")
    else:
        held, matrices = None, cov.select("window_id", "refit_no", F.col("cov").alias("matrix"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            covs = held.value[batch["matrix"].to_numpy()] if held else np.stack(batch["matrix"].to_numpy()).reshape(-1, n, n)
            masks = batch["mask"].to_numpy()
            bits = (masks[:, None] >> np.arange(n)) & 1
            sizes = bits.sum(axis=1)
            for kind in kinds:
                weights = np.zeros((len(batch), n))
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    cols = np.nonzero(bits[rows])[1].reshape(-1, size)
                    sub = covs[rows[:, None, None], cols[:, :, None], cols[:, None, :]]
                    weights[rows[:, None], cols] = solve(kind, sub, cap, erc_cap_mode, own)
                out = batch[["window_id", "mask", "n_sleeves", "refit_no"]].reset_index(drop=True)
                out["base"] = kind
                yield pd.concat([out, pd.DataFrame(weights, columns=[f"b_{i}" for i in range(n)])], axis=1)

    partitions = partitions or spark.sparkContext.defaultParallelism
    # Neighbouring masks share their size, so the spread is by hash and not by range.
    spread = (problems.select("window_id", "mask", F.col("n_sleeves").cast("int").alias("n_sleeves"))
              .repartition(partitions, "window_id", "mask"))
    return spread.join(F.broadcast(matrices) if held else matrices, "window_id").mapInPandas(run, schema)
