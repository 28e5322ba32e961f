"""Market references, both-down months and the four growth/inflation seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.signals import rolling_compound, step_difference

# Season names by (growth, inflation).
SEASONS = {
    ("up", "up"): "GrowthUp InfUp",
    ("up", "down"): "GrowthUp InfDown",
    ("down", "up"): "GrowthDown InfUp",
    ("down", "down"): "GrowthDown InfDown",
}
STAGFLATION = SEASONS["down", "up"]


def is_negative(x: Column) -> Column:
    return F.coalesce(x < 0, F.lit(False))


def basket_references(returns: DataFrame, equity: Sequence[str], bonds: Sequence[str]) -> DataFrame:
    """Equal-weight equity and bond baskets per period."""
    def basket(names: Sequence[str]) -> Column:
        return F.avg(F.when(F.col("entity").isin(list(names)), F.col("ret")))
    return returns.groupBy("period").agg(basket(equity).alias("eq_ref"), basket(bonds).alias("bd_ref"))


def external_references(baskets: DataFrame, external: DataFrame, equity: str, bond: str) -> DataFrame:
    """One outside series per side; months it lacks are filled from the baskets."""
    chosen = (external.where(F.col("entity").isin(equity, bond)).groupBy("period")
              .agg(F.max(F.when(F.col("entity") == equity, F.col("ret"))).alias("x_eq"),
                   F.max(F.when(F.col("entity") == bond, F.col("ret"))).alias("x_bd")))
    return baskets.join(F.broadcast(chosen), "period", "left").select(
        "period", F.coalesce("x_eq", "eq_ref").alias("eq_ref"), F.coalesce("x_bd", "bd_ref").alias("bd_ref"))


def with_both_down(refs: DataFrame) -> DataFrame:
    return refs.withColumn("both_down", is_negative(F.col("eq_ref")) & is_negative(F.col("bd_ref")))


def season_label(growth: Column, inflation: Column) -> Column:
    label = F.lit(None).cast("string")
    for (g, i), name in SEASONS.items():
        label = F.when((growth == g) & (inflation == i), name).otherwise(label)
    return label


def regime_labels(returns: DataFrame, yields: DataFrame, growth_entity: str, yield_entity: str) -> DataFrame:
    """``(period, growth, inflation, season)``: 12-row growth of one series, 12-row change of a yield level.

    Undefined comparisons count as "down". The label uses the current month, so it groups
    results and never feeds a weight.
    """
    growth = (returns.where(F.col("entity") == growth_entity)
              .select("period", rolling_compound(["entity"], 12).alias("g")))
    change = (yields.where((F.col("entity") == yield_entity) & F.col("level").isNotNull())
              .select("period", step_difference(["entity"], "level", 12).alias("i")))
    periods = returns.select("period").distinct()
    up = lambda c: F.when(F.col(c) > 0, "up").otherwise("down")
    joined = (periods.join(F.broadcast(growth), "period", "left")
              .join(F.broadcast(change), "period", "left")
              .select("period", up("g").alias("growth"), up("i").alias("inflation")))
    return joined.withColumn("season", season_label(F.col("growth"), F.col("inflation")))


def deflate(nominal: DataFrame, deflator: DataFrame) -> DataFrame:
    """Real return; months without a deflator count as no inflation. ``deflator`` is one series."""
    d = deflator.select("period", F.col("ret").alias("d"))
    return (nominal.join(F.broadcast(d), "period", "left")
            .withColumn("real_ret", (1 + F.col("ret")) / (1 + F.coalesce("d", F.lit(0.0))) - 1).drop("d"))


def choose_deflator(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Returns of the first listed series that has any, as one source for all periods; its holes stay holes."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("entity"))
    listed = candidates.where(F.col("entity").isin(list(order)) & F.col("ret").isNotNull())
    first = listed.agg(F.min(place).alias("first"))
    return listed.join(F.broadcast(first), place == F.col("first")).select("period", "ret")
