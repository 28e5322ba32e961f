"""Returns, composites and coverage over long panels.

Windows here run over one entity's own series, whose length is bounded by the calendar;
duplicates of a (period, entity) cell are folded by aggregation before any window sees them.
The calendar holds one row per distinct date, so it is broadcast; every other join is left to
the planner, which broadcasts a side only by its measured size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import safe_div


def by_entity():
    return Window.partitionBy("entity").orderBy("period")


def calendar(panel: DataFrame) -> DataFrame:
    """Union calendar: every period with its position and its predecessor (one row per period)."""
    order = Window.orderBy("period")
    return (panel.select("period").distinct()
            .select("period", F.lag("period").over(order).alias("prev_period"),
                    F.row_number().over(order).alias("cal_idx")))


def with_calendar(panel: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(calendar(panel)), "period")


def simple_returns(levels: DataFrame) -> DataFrame:
    """``(period, entity, ret)``; a hole gives null in the hole and on the row after it."""
    prev = F.lag("level").over(by_entity())
    adjacent = F.lag("period").over(by_entity()) == F.col("prev_period")
    return (with_calendar(levels).where(F.col("level").isNotNull())
            .select("period", "entity", F.when(adjacent, safe_div(F.col("level"), prev) - 1).alias("ret")))


def own_row_returns(levels: DataFrame) -> DataFrame:
    """Returns over an entity's own non-null rows, bridging holes (as the audit recomputes them)."""
    prev = F.lag("level").over(by_entity())
    return (levels.where(F.col("level").isNotNull())
            .select("period", "entity", (safe_div(F.col("level"), prev) - 1).alias("ret")))


def non_null(panel: DataFrame, column: str = "ret") -> DataFrame:
    return panel.where(F.col(column).isNotNull())


def keep_first(panel: DataFrame, order: str) -> DataFrame:
    """First row per (period, entity) by ``order``: an aggregate, so copies combine map-side."""
    rest = [c for c in panel.columns if c not in ("period", "entity", order)]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("first")
    return panel.groupBy("period", "entity").agg(first).select("period", "entity", "first.*")


def drop_empty(levels: DataFrame) -> DataFrame:
    """Entities with at least one value."""
    alive = levels.groupBy("entity").agg(F.count("level").alias("n")).where("n > 0").select("entity")
    return levels.join(alive, "entity", "left_semi")


def labelled_panel(returns: DataFrame, dim: DataFrame, value: str) -> DataFrame:
    return (non_null(returns).join(dim, "entity")
            .select("period", "entity", "name", "asset_class", "sector", F.col("ret").alias(value)))


def composite(labelled: DataFrame, group: Column, value: str = "ret") -> DataFrame:
    """Equal-weight mean of the members present in each period."""
    return (labelled.groupBy("period", group.alias("grp"))
            .agg(F.avg(value).alias("ret"), F.count(value).alias("n_members"))
            .where("n_members > 0"))


def is_composite_class(asset_class: Column) -> Column:
    """Sector funds and single stocks are not asset-class members."""
    return ~asset_class.startswith("Sector-") & (asset_class != "Equity (single stock)")


def sector_name(sector: Column) -> Column:
    return F.regexp_replace(sector, "^Sector-", "")


def coverage(returns: DataFrame, keys: list[str], per_year: int, positive: bool = True) -> DataFrame:
    """Span, count and annualised (arithmetic) statistics in percent."""
    stats = [
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.count("ret").alias("n_periods"),
        (F.avg("ret") * per_year * 100).alias("ann_return_pct"),
        (F.stddev_samp("ret") * math.sqrt(per_year) * 100).alias("ann_vol_pct"),
        (F.min("ret") * 100).alias("min_pct"), (F.max("ret") * 100).alias("max_pct"),
    ]
    if positive:
        stats.append((F.avg((F.col("ret") > 0).cast("double")) * 100).alias("pct_positive"))
    return non_null(returns).groupBy(*keys).agg(*stats)


def universe_coverage(levels: DataFrame, dim: DataFrame) -> DataFrame:
    spans = (levels.where(F.col("level").isNotNull()).groupBy("entity")
             .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"),
                  F.count(F.lit(1)).alias("n_periods")))
    return dim.join(spans, "entity", "left").select(
        *dim.columns, "first_period", "last_period",
        F.coalesce("n_periods", F.lit(0).cast("bigint")).alias("n_periods"),
        F.col("n_periods").isNotNull().alias("present"))


def month_end_levels(daily: DataFrame) -> DataFrame:
    """Last non-null level of each month."""
    return (daily.where(F.col("level").isNotNull())
            .groupBy(F.last_day("period").alias("month"), "entity")
            .agg(F.max_by("level", "period").alias("level"))
            .withColumnRenamed("month", "period"))


def complete_entities(returns: DataFrame, start: str, end: str) -> DataFrame:
    """Entities with a value in every calendar period of the inclusive window."""
    window = returns.where(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    n = window.agg(F.count_distinct("period").alias("n_window"))
    counts = window.groupBy("entity").agg(F.count("ret").alias("n_ret"))
    return counts.join(F.broadcast(n), F.col("n_ret") == F.col("n_window")).select("entity")


def complete_panel(returns: DataFrame, start: str, end: str) -> DataFrame:
    window = returns.where(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return window.join(complete_entities(returns, start, end), "entity", "left_semi")


def augment(returns: DataFrame, extra: DataFrame, entity: str, sleeve: str) -> DataFrame:
    """Add one series of ``extra`` as a new sleeve, limited to the periods already known."""
    known = returns.select("period").distinct()
    added = extra.where(F.col("entity") == entity).join(F.broadcast(known), "period", "left_semi")
    return returns.unionByName(added.select("period", F.lit(sleeve).alias("entity"), "ret"))
