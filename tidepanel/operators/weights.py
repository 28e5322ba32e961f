"""Portfolio weights: closed forms in the JVM, iterative solves in Arrow batches.

Weights are held per (window, portfolio, refit) as one column per roster series
(``b_0 .. b_{n-1}``, 0 for absent series).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import safe_div
from tidepanel.operators.universe import Roster


def weight_columns(roster: Roster) -> list[str]:
    return [f"b_{i}" for i in range(roster.n)]


def equal_weight(combos: DataFrame, roster: Roster) -> DataFrame:
    """1/n each. A feasible cap leaves it unchanged and an infeasible cap falls back to it."""
    return combos.selectExpr("*", *[f"double(shiftright(mask, {i}) & 1) / n_sleeves AS b_{i}" for i in range(roster.n)])


def cap_and_redistribute(df: DataFrame, keys: Sequence[str], w: str, cap: float, out: str) -> DataFrame:
    """Clip to ``cap`` and spread the excess equally over the free members, until none is over.

    The rounds end in ``min(cap, w + d)`` with one common ``d``: sorted descending, ``d`` is
    fixed by the shortest capped prefix that leaves the next member at or under the cap. An
    infeasible cap gives equal weight; a cap outside (0, 1) only normalises.
    """
    group = Window.partitionBy(*keys)
    df = df.withColumn("_w", safe_div(F.col(w), F.sum(w).over(group)))
    if not 0.0 < cap < 1.0:
        return df.withColumn(out, F.col("_w")).drop("_w")
    ranked = group.orderBy(F.desc("_w"), "sleeve")
    df = (df.withColumn("_k", F.row_number().over(ranked) - 1)
          .withColumn("_size", F.count(F.lit(1)).over(group))
          .withColumn("_rest", F.sum("_w").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    df = df.withColumn("_d", (F.lit(1.0) - F.col("_k") * cap - F.col("_rest")) / (F.col("_size") - F.col("_k")))
    valid = F.col("_w") + F.col("_d") <= cap + 1e-12
    df = df.withColumn("_d", F.min_by("_d", F.when(valid, F.col("_k"))).over(group))
    spread = F.least(F.lit(cap), F.col("_w") + F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0)))
    df = df.withColumn("_c", F.when(F.col("_size") * cap < 1.0, F.lit(1.0) / F.col("_size")).otherwise(spread))
    df = df.withColumn(out, F.col("_c") / F.sum("_c").over(group))
    return df.drop("_w", "_k", "_size", "_rest", "_d", "_c")


def project_to_simplex(df: DataFrame, keys: Sequence[str], v: str, out: str) -> DataFrame:
    """Euclidean projection onto {w >= 0, sum w = 1} by the sorted-prefix threshold."""
    group = Window.partitionBy(*keys)
    ranked = group.orderBy(F.desc(v), "sleeve")
    df = (df.withColumn("_k", F.row_number().over(ranked))
          .withColumn("_tau", (F.sum(v).over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - 1.0)
                      / F.row_number().over(ranked)))
    active = F.when(F.col(v) - F.col("_tau") > 0, F.col("_k"))
    df = df.withColumn("_tau", F.max_by("_tau", active).over(group))
    return df.withColumn(out, F.greatest(F.col(v) - F.col("_tau"), F.lit(0.0))).drop("_k", "_tau")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def capped_shares(raw: Column, cap: float) -> Column:
    """An array divided by its sum and capped as in ``cap_and_redistribute``, row-locally."""
    zero = F.lit(0.0)

    def shares(w: Column) -> Column:
        return F.transform(w, lambda x: x / F.aggregate(w, zero, lambda a, b: a + b))

    if not 0.0 < cap < 1.0:
        return bind(raw, shares)

    def spread(w: Column) -> Column:
        size = F.size(w)

        def step(x: Column, k: Column) -> Column:
            rest = F.aggregate(F.slice(F.reverse(F.array_sort(w)), k + 1, size), zero, lambda a, b: a + b)
            d = (1.0 - k * cap - rest) / (size - k)
            return F.when(x + d <= cap + 1e-12, d)

        fits = F.filter(F.transform(F.reverse(F.array_sort(w)), step), lambda d: d.isNotNull())
        more = F.greatest(F.coalesce(F.get(fits, F.lit(0)), zero), zero)
        return F.when(size * cap < 1.0, F.transform(w, lambda _: F.lit(1.0) / size)).otherwise(F.transform(w, lambda x: F.least(F.lit(cap), x + more)))

    return bind(bind(bind(raw, shares), spread), shares)


def inverse_risk(combos: DataFrame, cov: DataFrame, roster: Roster, power: int, cap: float,
                 base: str) -> DataFrame:
    """Inverse volatility (power 1) or variance (power 2), capped, for every refit that has a covariance.

    The members of a portfolio are one array in one row: nothing is exploded or shuffled.
    """
    held = combos.join(F.broadcast(cov.select("window_id", "refit_no", "vol")), "window_id")
    members = F.expr(f"filter(sequence(0, {roster.n - 1}), s -> shiftright(mask, s) & 1 = 1)")
    risk = lambda s: F.pow(F.element_at("vol", s + 1), F.lit(float(power)))
    held = held.withColumn("raw", F.transform(members, lambda s: F.lit(1.0) / F.when(risk(s) > 0, risk(s)).otherwise(1e-12)))
    held = held.withColumn("w", capped_shares(F.col("raw"), cap))
    cells = [f"CASE WHEN shiftright(mask, {i}) & 1 = 1 THEN element_at(w, bit_count(mask & {(1 << i) - 1}L) + 1) ELSE 0D END AS b_{i}" for i in range(roster.n)]
    return held.selectExpr("window_id", "mask", "n_sleeves", "refit_no", *cells).withColumn("base", F.lit(base))
