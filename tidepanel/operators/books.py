"""Backtests of given portfolios in long form: ``(portfolio, period, entity, w, ret)``.

These tables are portfolios x months x members. They are laid out by portfolio once; every
window and aggregate below keeps that layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.scalar import safe_div
from tidepanel.operators import signals as sg


def fixed_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Static weights, renormalised to the series that exist in ``returns``."""
    present = returns.select("entity").distinct()
    kept = weights.join(present, "entity", "left_semi")
    total = F.sum("w").over(Window.partitionBy("portfolio"))
    return kept.withColumn("w", safe_div(F.col("w"), total))


def positions(weights: DataFrame, returns: DataFrame) -> DataFrame:
    return weights.join(returns, "entity").repartition("portfolio").select("portfolio", "period", "entity", "w", "ret")


def gross_months(book: DataFrame, cash: float = 0.0) -> DataFrame:
    """Monthly return without costs; what is not invested earns ``cash``."""
    return book.groupBy("portfolio", "period").agg(
        (F.sum(F.col("w") * F.col("ret")) + (1 - F.sum("w")) * cash).alias("net"))


def rebalanced_months(book: DataFrame, cost: float) -> DataFrame:
    """Gross return, turnover against the drifted holding and net return per month."""
    month = Window.partitionBy("portfolio", "period")
    series = Window.partitionBy("portfolio", "entity").orderBy("period")
    df = book.withColumn("g", F.sum(F.col("w") * F.col("ret")).over(month))
    drifted = F.when(1 + F.col("g") > 1e-6, F.col("w") * (1 + F.col("ret")) / (1 + F.col("g"))).otherwise(F.col("w"))
    df = df.withColumn("held", drifted)
    df = df.withColumn("before", F.coalesce(F.lag("held").over(series), F.lit(0.0)))
    out = df.groupBy("portfolio", "period").agg(
        F.sum(F.col("w") * F.col("ret")).alias("gross"), F.sum(F.abs(F.col("w") - F.col("before"))).alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * cost)


def momentum_exit(book: DataFrame, lookback: int) -> DataFrame:
    """A member is held only while its trailing return is positive; all are held in the warm-up."""
    return _overlay(book, lookback, lambda mom: F.when(mom > 0, 1.0).otherwise(0.0))


def momentum_sign(book: DataFrame, lookback: int) -> DataFrame:
    """A member is held long or short by the sign of its trailing return; long in the warm-up."""
    return _overlay(book, lookback, sg.direction)


def _overlay(book: DataFrame, lookback: int, rule) -> DataFrame:
    mom = sg.momentum(["portfolio", "entity"], lookback)
    return (book.withColumn("_mom", mom)
            .withColumn("w", F.col("w") * F.when(F.col("_mom").isNull(), 1.0).otherwise(rule(F.col("_mom"))))
            .drop("_mom"))


def benchmark_weights(legs: DataFrame, complete: DataFrame) -> DataFrame:
    """Era-fair weights: a leg uses its series if complete, else its alternate, else it is dropped.

    ``legs``: (portfolio, entity, alternate, w). Weights are renormalised to the legs left.
    """
    first = complete.select("entity").withColumn("has_first", F.lit(True))
    second = complete.select(F.col("entity").alias("alternate")).withColumn("has_second", F.lit(True))
    use = F.when(F.col("has_first"), F.col("entity")).when(F.col("has_second"), F.col("alternate"))
    df = (legs.join(first, "entity", "left").join(second, "alternate", "left")
          .withColumn("use", use).where(F.col("use").isNotNull())
          .groupBy("portfolio", "use").agg(F.sum("w").alias("w")).withColumnRenamed("use", "entity"))
    return df.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("portfolio")))


def blends(carry: DataFrame, trend: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Every carry x trend x share mix, month by month. The series meet on the period."""
    mixed = carry.select("period", F.col("portfolio").alias("carry"), F.col("net").alias("c")).join(
        trend.select("period", F.col("portfolio").alias("trend"), F.col("net").alias("t")), "period")
    mixed = mixed.withColumn("w_trend", F.explode(F.array(*[F.lit(x) for x in shares])))
    return mixed.select("carry", "trend", "w_trend", "period",
                        ((1 - F.col("w_trend")) * F.col("c") + F.col("w_trend") * F.col("t")).alias("net"))
