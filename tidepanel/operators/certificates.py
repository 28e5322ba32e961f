"""Proofs that solver weights are optimal, as column expressions: what a better portfolio could gain at most.

For a convex objective f over {0 <= w <= cap, sum w = 1} the linear bound f(w) - f* <= g.(w - s) holds, with g the gradient and s the
portfolio that the gradient likes best, which fills the smallest entries of g up to the cap. Nothing is solved again, so
the check shares no code with the solvers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.universe import Roster


def with_gradients(weights: DataFrame, cov: DataFrame, roster: Roster) -> DataFrame:
    """Adds ``w`` and ``sw`` (S w), arrays over the members in roster order, and ``risk`` (w'Sw)."""
    n = roster.n
    row = lambda i: " + ".join(f"b_{j} * cov[{i * n + j}]" for j in range(n))
    entries = ", ".join(f"named_struct('i', {i}, 'w', b_{i}, 'sw', {row(i)})" for i in range(n))
    # one row per (window, refit): a calendar's worth
    df = weights.join(F.broadcast(cov.select("window_id", "refit_no", "cov")), ["window_id", "refit_no"])
    df = df.withColumn("_m", F.expr(f"filter(array({entries}), e -> shiftright(mask, e.i) & 1 = 1)")).drop("cov")
    df = df.withColumn("w", F.transform("_m", lambda e: e["w"])).withColumn("sw", F.transform("_m", lambda e: e["sw"])).drop("_m")
    return df.withColumn("risk", F.expr("aggregate(zip_with(w, sw, (a, b) -> a * b), 0D, (a, b) -> a + b)"))


def best_linear(gradient: str, cap: float) -> str:
    """SQL text of the least g.s over the capped simplex: the smallest entries up to the cap, then what is left of the next. No cap if it is infeasible."""
    if not 0.0 < cap < 1.0:
        return f"array_min({gradient})"
    full = int(1.0 / cap + 1e-12)
    rest = max(1.0 - full * cap, 0.0)
    ordered = f"array_sort({gradient})"
    filled = (f"{cap!r}D * aggregate(slice({ordered}, 1, {full}), 0D, (a, b) -> a + b) + {rest!r}D * coalesce(get({ordered}, {full}), 0D)")
    return f"if(size({gradient}) * {cap!r}D < 1D - 1e-12D, array_min({gradient}), {filled})"


def _bound(cap: float) -> Column:
    return F.expr(f"aggregate(zip_with(w, g, (a, b) -> a * b), 0D, (a, b) -> a + b) - ({best_linear('g', cap)})")


def minimum_variance_gap(weights: DataFrame, cov: DataFrame, roster: Roster, cap: float) -> DataFrame:
    """Adds ``gap``: the share of its variance that a portfolio could still lose, at most."""
    df = with_gradients(weights, cov, roster).withColumn("g", F.transform("sw", lambda x: 2 * x))
    return df.withColumn("gap", _bound(cap) / F.greatest("risk", F.lit(1e-30))).drop("w", "sw", "g", "risk")


def capped_risk_gap(weights: DataFrame, cov: DataFrame, roster: Roster, cap: float) -> DataFrame:
    """Adds ``gap``: how far 0.5 w'Sw - mean(ln w) is from its least value over the capped simplex, at most."""
    df = with_gradients(weights, cov, roster).withColumn("g", F.expr("zip_with(sw, w, (s, x) -> s - 1D / (size(w) * greatest(x, 1e-12D)))"))
    return df.withColumn("gap", _bound(cap)).drop("w", "sw", "g", "risk")


def equal_risk_gap(weights: DataFrame, cov: DataFrame, roster: Roster) -> DataFrame:
    """Adds ``gap``: the largest distance of a share of the variance from 1/n, which is the gradient of 0.5 x'Sx - mean(ln x) at the scaled optimum."""
    df = with_gradients(weights, cov, roster)
    return df.withColumn("gap", F.expr("array_max(zip_with(w, sw, (a, b) -> abs(a * b / greatest(risk, 1e-30D) - 1D / size(w))))")).drop("w", "sw", "risk")
