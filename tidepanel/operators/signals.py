"""Trailing signals over return series.

Every trading signal at row t reads rows before t only. Frames are row frames over one
series, so they are bounded by the calendar. ``keys`` lets one job hold many windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import safe_div, zero_if_null

HISTORY_ROWS = 72


@dataclass(frozen=True)
class SignalSpec:
    """One signal with its parameters; ``key`` names it in the long signal table."""
    kind: str
    params: tuple = ()

    @property
    def key(self) -> str:
        return ":".join([self.kind, *(str(p) for p in self.params)])


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("period")


def before(keys: Sequence[str], length: int):
    """The ``length`` rows strictly before the current one."""
    return _order(keys).rowsBetween(-length, -1)


def through(keys: Sequence[str], length: int | None = None):
    """Rows up to and including the current one (all of them, or the last ``length``)."""
    lo = Window.unboundedPreceding if length is None else 1 - length
    return _order(keys).rowsBetween(lo, 0)


def full(frame, length: int, value: Column, column: str = "ret") -> Column:
    return F.when(F.count(column).over(frame) == length, value)


def compound(frame, column: str = "ret") -> Column:
    return F.product(1 + F.col(column)).over(frame) - 1


def rolling_compound(keys: Sequence[str], length: int) -> Column:
    frame = through(keys, length)
    return full(frame, length, compound(frame))


def wealth(keys: Sequence[str], column: str = "ret") -> Column:
    return F.product(1 + F.col(column)).over(through(keys))


def momentum(keys: Sequence[str], lookback: int) -> Column:
    frame = before(keys, lookback)
    return full(frame, lookback, compound(frame))


def step_difference(keys: Sequence[str], column: str, k: int) -> Column:
    return F.col(column) - F.lag(column, k).over(_order(keys))


def direction(x: Column) -> Column:
    """+1, -1 or 0; null counts as 0."""
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def with_levels(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the row number ``t``, the price index ``lvl`` and the realised volatility ``rv``."""
    t = F.row_number().over(_order(keys)) - 1
    return (history.withColumn("t", t)
            .withColumn("lvl", wealth(keys))
            .withColumn("lvl1", F.lag("lvl").over(_order(keys))))


def _with_rv(df: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    rv = F.stddev_pop("ret").over(before(keys, window)) * math.sqrt(12.0)
    return (df.withColumn("rv", F.when(F.col("t") >= window, rv).otherwise(0.0))
            .withColumn("rv1", F.lag("rv").over(_order(keys))))


def hysteresis(df: DataFrame, keys: Sequence[str], exit_: Column, enter: Column, out: str) -> DataFrame:
    """Two-state machine (starts +1, leaves on ``exit_``, returns on ``enter``) as window passes.

    A month with one trigger fixes the state; a month with both flips it; a month with none
    keeps it. So the state is the last fixed value, flipped once per flip since then.
    """
    exit_, enter = F.coalesce(exit_, F.lit(False)), F.coalesce(enter, F.lit(False))
    so_far = through(keys)
    df = df.withColumn("_const", F.when(exit_ & ~enter, -1.0).when(enter & ~exit_, 1.0))
    df = df.withColumn("_flips", F.sum(F.when(exit_ & enter, 1).otherwise(0)).over(so_far))
    last_const = F.last("_const", ignorenulls=True).over(so_far)
    flips_then = F.last(F.when(F.col("_const").isNotNull(), F.col("_flips")), ignorenulls=True).over(so_far)
    flips_since = F.col("_flips") - F.coalesce(flips_then, F.lit(0))
    state = F.coalesce(last_const, F.lit(1.0)) * F.when(flips_since % 2 == 0, 1.0).otherwise(-1.0)
    return df.withColumn(out, state).drop("_const", "_flips")


def add_signal(df: DataFrame, keys: Sequence[str], spec: SignalSpec, out: str) -> DataFrame:
    """Adds one signal column to a frame prepared by ``with_levels``."""
    kind, p = spec.kind, spec.params
    t, lvl1 = F.col("t"), F.col("lvl1")

    def mean_level(length: int) -> Column:
        return F.avg("lvl").over(before(keys, length))

    if kind == "none":
        return df.withColumn(out, F.lit(0.0))
    if kind == "mom":
        return df.withColumn(out, momentum(keys, p[0]))
    if kind == "ma":
        return df.withColumn(out, F.when(t >= p[0], direction(lvl1 - mean_level(p[0]))).otherwise(0.0))
    if kind == "dma":
        fast, slow = p
        return df.withColumn(out, F.when(t >= slow, direction(mean_level(fast) - mean_level(slow))).otherwise(0.0))
    if kind == "vol":
        window, median = p
        df = _with_rv(df, keys, window)
        med = F.percentile("rv", F.lit(0.5)).over(before(keys, median))
        df = df.withColumn(out, F.when(t >= median, direction(med - F.col("rv1"))).otherwise(0.0))
        return df.drop("rv", "rv1")
    if kind == "asym_ma":
        fast, slow = p
        ready = t >= slow
        df = df.withColumn("_fast", mean_level(fast)).withColumn("_slow", mean_level(slow))
        df = hysteresis(df, keys, ready & (lvl1 < F.col("_fast")), ready & (lvl1 > F.col("_slow")), out)
        return df.drop("_fast", "_slow")
    if kind in ("dd_stop", "eq_dd"):
        window, leave, back = p
        peak = F.max("lvl").over(before(keys, window))
        df = df.withColumn("_dd", F.when(t >= window, safe_div(lvl1 - peak, peak)))
        down, near = F.col("_dd") < -leave, F.col("_dd") > -back
        if kind == "eq_dd":
            df = df.withColumn(out, F.when(down, -1.0).when(near, 1.0).otherwise(0.0))
        else:
            df = hysteresis(df, keys, down, near, out)
        return df.drop("_dd")
    if kind == "asym_vol":
        window, median, hi, lo = p
        df = _with_rv(df, keys, window)
        df = df.withColumn("_med", F.percentile("rv", F.lit(0.5)).over(before(keys, median)))
        ready = t >= median
        df = hysteresis(df, keys, ready & (F.col("rv1") > hi * F.col("_med")),
                        ready & (F.col("rv1") < lo * F.col("_med")), out)
        return df.drop("rv", "rv1", "_med")
    raise ValueError(f"unknown signal {kind}")


def signal_table(history: DataFrame, keys: Sequence[str], specs: Sequence[SignalSpec]) -> DataFrame:
    """All signals in long form: ``(*keys, period, sig_key, sig)``."""
    df = with_levels(history, keys)
    names = []
    for i, spec in enumerate(specs):
        df = add_signal(df, keys, spec, f"sig_{i}")
        names.append((spec.key, f"sig_{i}"))
    entries = F.array(*[F.struct(F.lit(k).alias("sig_key"), F.col(c).alias("sig")) for k, c in names])
    return df.select(*keys, "period", F.explode(entries).alias("e")).select(*keys, "period", "e.*")


def realised_volatility(keys: Sequence[str], lookback: int) -> Column:
    """Annualised sample deviation of the previous rows; 0 until they are all there."""
    frame = before(keys, lookback)
    return zero_if_null(full(frame, lookback, F.stddev_samp("ret").over(frame))) * math.sqrt(12.0)


def drawdown_in_order(df: DataFrame, keys: Sequence[str], column: str = "ret") -> DataFrame:
    """Adds ``wealth`` and ``dd``; the start value 1.0 is not part of the running peak.

    One frame per series: for trials, whose months are laid out together and must not move.
    """
    return (df.withColumn("wealth", wealth(keys, column))
            .withColumn("dd", safe_div(F.col("wealth"), F.max("wealth").over(through(keys))) - 1))


def drawdown(df: DataFrame, keys: Sequence[str], column: str = "ret", block: Column | None = None) -> DataFrame:
    """The same ``wealth`` and ``dd``, and ``peak`` (wealth and period of the running peak), with no task per series.

    A block of periods (a year, if not given) is summed up as its growth and the highest and lowest growth reached inside it. Such states combine:
    growths multiply, and a block's top is its highest growth, or its lowest after a negative one, times the growth before it. Only states, one per series and
    block, are put in order by series; rows are ordered inside their block and meet the state before it. ``block`` must rise with the period.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_block").orderBy("period")
    w = F.product(1 + F.col(column)).over(inside)
    rows = df.withColumn("_block", F.year("period") if block is None else block).withColumn("_w", w)
    states = rows.groupBy(*keys, "_block").agg(
        F.product(1 + F.col(column)).alias("_g"), F.max(F.when(F.col("_w").isNotNull(), F.struct("_w", "period"))).alias("_hi"),
        F.max(F.when(F.col("_w").isNotNull(), F.struct((-F.col("_w")).alias("_w"), "period"))).alias("_lo"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_grown", F.product("_g").over(earlier))
    before = F.coalesce("_grown", F.lit(1.0))
    top = F.when(before >= 0, F.struct((before * F.col("_hi._w")).alias("wealth"), F.col("_hi.period").alias("period"))) \
        .otherwise(F.struct((-before * F.col("_lo._w")).alias("wealth"), F.col("_lo.period").alias("period")))
    states = states.withColumn("_peak", F.max(F.when(F.col("_hi").isNotNull(), top)).over(earlier))
    carried = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_grown", "_peak")
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    grown = F.when(F.col("_w").isNotNull() | F.col("_grown").isNotNull(), F.coalesce("_grown", F.lit(1.0)) * F.coalesce("_w", F.lit(1.0)))
    own = F.max(F.when(F.col("_w").isNotNull(), F.struct("wealth", "period"))).over(inside)
    out = rows.join(carried, same).withColumn("wealth", grown).withColumn("peak", F.greatest("_peak", own))
    return out.withColumn("dd", safe_div(F.col("wealth"), F.col("peak.wealth")) - 1).select(*df.columns, "wealth", "dd", "peak")
