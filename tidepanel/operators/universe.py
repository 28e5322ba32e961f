"""Sleeve rosters, date windows and the portfolio space."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.operators.returns import calendar


@dataclass(frozen=True)
class Roster:
    """The candidate series in order; a portfolio is a bitmask over their positions."""
    names: tuple[str, ...]
    equity: tuple[str, ...]
    bonds: tuple[str, ...]
    inflation_proxies: tuple[str, ...] = ()
    equity_proxies: tuple[str, ...] = ()

    def __post_init__(self):
        if len(self.names) > 62:
            raise ValueError("a roster holds at most 62 series")

    @property
    def n(self) -> int:
        return len(self.names)

    def mask(self, names: Sequence[str]) -> int:
        return sum(1 << self.names.index(x) for x in names)

    def others(self) -> tuple[str, ...]:
        return tuple(x for x in self.names if x not in self.equity and x not in self.bonds)


def roster_position(roster: Roster) -> Column:
    pairs = [x for i, name in enumerate(roster.names) for x in (F.lit(name), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.col("entity"))


CHUNK = 4096  # portfolios that one row of the plan stands for


def _members(roster: Roster, names: Sequence[str], available: int) -> list[int]:
    """Bits of the available series among ``names``."""
    return [1 << i for i, x in enumerate(roster.names) if x in names and available >> i & 1]


def combination_classes(roster: Roster, lo: int, hi: int, available: dict[int, int]) -> list[tuple]:
    """(window_id, equity bits, bond bits, other bits, i, j, k, counts of the bond and other parts, count): the ways to take i, j and k of each role.

    At most windows x hi^3 rows, however many portfolios they stand for.
    """
    rows = []
    for window, mask in available.items():
        e, b, o = (_members(roster, x, mask) for x in (roster.equity, roster.bonds, roster.others()))
        for i in range(1, len(e) + 1):
            for j in range(1, len(b) + 1):
                for k in range(max(lo - i - j, 0), min(hi - i - j, len(o)) + 1):
                    of_b, of_o = math.comb(len(b), j), math.comb(len(o), k)
                    rows.append((int(window), e, b, o, i, j, k, of_b, of_o, math.comb(len(e), i) * of_b * of_o))
    return rows


def _unranked(bits: str, size: str, rank: str, choose: str, width: int) -> str:
    """Mask of the ``rank``-th subset of ``size`` of ``bits``: from the last member down, one is taken if the subsets without it are too few."""
    before = f"element_at({choose}, cast(n * {width} + s.c + 1 as int))"
    step = (f"if(s.c > 0 and s.r >= {before}, named_struct('r', s.r - {before}, 'c', s.c - 1, 'm', s.m | element_at({bits}, n + 1)), s)")
    return f"if({size} = 0, 0L, aggregate(sequence(size({bits}) - 1, 0, -1), named_struct('r', {rank}, 'c', {size}, 'm', 0L), (s, n) -> {step}, s -> s.m))"


def portfolio_space(spark: SparkSession, roster: Roster, lo: int, hi: int, available: dict[int, int]) -> DataFrame:
    """Allowed portfolios ``(window_id, mask, n_sleeves)``: at least one equity and one bond series, ``lo..hi`` in all, available in the window.

    Portfolios are numbered within their class and read back from the number (combinatorial number system), so the work
    is their count, not the number of subsets of the roster, and no duplicates arise.
    """
    rows = combination_classes(roster, lo, hi, available)
    if sum(r[-1] for r in rows) >= 1 << 62:
        raise ValueError("too many portfolios to number")
    kind = "window_id int, e array<bigint>, b array<bigint>, o array<bigint>, i int, j int, k int, of_b bigint, of_o bigint, n bigint"
    if not rows:
        return spark.createDataFrame([], "window_id int, mask bigint, n_sleeves int")
    width = hi + 1
    choose = "array(" + ", ".join(f"{math.comb(n, c)}L" for n in range(max(map(len, (roster.equity, roster.bonds, roster.others()))) + 1) for c in range(width)) + ")"
    # chunks of a class follow one another; a range deals them out, so nothing is shuffled
    starts = [0, *itertools.accumulate(-(-r[-1] // CHUNK) for r in rows)]
    classes = spark.createDataFrame([(at, at_chunk, *r) for at, (at_chunk, r) in enumerate(zip(starts, rows))], f"class int, first_chunk bigint, {kind}")
    of_class = f"size(filter(array({', '.join(f'{x}L' for x in starts[:-1])}), x -> x <= id)) - 1"
    chunks = spark.range(starts[-1]).selectExpr("id", f"{of_class} AS class").join(F.broadcast(classes), "class").withColumn("chunk", F.col("id") - F.col("first_chunk"))
    ranks = chunks.withColumn("rank", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)))
    parts = [_unranked("e", "i", "rank div (of_b * of_o)", choose, width), _unranked("b", "j", "(rank div of_o) % of_b", choose, width),
             _unranked("o", "k", "rank % of_o", choose, width)]
    return ranks.selectExpr("window_id", " | ".join(parts) + " AS mask", "i + j + k AS n_sleeves")


def combinations(spark: SparkSession, roster: Roster, lo: int, hi: int, available: int | None = None) -> DataFrame:
    """The portfolios ``(mask, n_sleeves)`` of one window."""
    available = (1 << roster.n) - 1 if available is None else available
    return portfolio_space(spark, roster, lo, hi, {0: available}).drop("window_id")


def combination_count(roster: Roster, lo: int, hi: int, available: int) -> int:
    """Closed form of the number of allowed portfolios."""
    e = (available & roster.mask(roster.equity)).bit_count()
    b = (available & roster.mask(roster.bonds)).bit_count()
    o = (available & roster.mask(roster.others())).bit_count()
    return sum(math.comb(e, i) * math.comb(b, j) * math.comb(o, k)
               for i in range(1, e + 1) for j in range(1, b + 1) for k in range(o + 1) if lo <= i + j + k <= hi)


def combo_text(roster: Roster, mask: Column) -> Column:
    """Comma list: equity first, then bonds, then the others, each in roster order."""
    ordered = [*(x for x in roster.names if x in roster.equity),
               *(x for x in roster.names if x in roster.bonds), *roster.others()]
    members = [F.when(mask.bitwiseAND(F.lit(1 << roster.names.index(x))) != 0, F.lit(x)) for x in ordered]
    return F.concat_ws(",", *members)


def windows_frame(spark: SparkSession, windows: Sequence[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame([(int(i), str(a), str(b)) for i, a, b in windows],
                                 "window_id int, start_d string, end_d string").select(
        "window_id", F.col("start_d").cast("date").alias("start_d"), F.col("end_d").cast("date").alias("end_d"))


def month_ends_between(start: Column, end: Column) -> Column:
    """Month-ends inside an inclusive date range, as an array: turns the range join into an equi-join."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    ends = F.transform(months, lambda d: F.last_day(d))
    return F.filter(ends, lambda d: (d >= start) & (d <= end))


def window_months(returns: DataFrame, windows: DataFrame, cadence: str = "A", cal: DataFrame | None = None) -> DataFrame:
    """Months of every window with their position, refit number and the row of that refit.

    ``cadence`` A refits in the first month of each calendar year of the window, M every month.
    """
    cal = (calendar(returns) if cal is None else cal).select("period", "cal_idx")
    months = (windows.withColumn("period", F.explode(month_ends_between(F.col("start_d"), F.col("end_d"))))
              .join(F.broadcast(cal), "period"))
    by_window = Window.partitionBy("window_id").orderBy("period")
    first_of_year = F.row_number().over(Window.partitionBy("window_id", F.year("period")).orderBy("period")) == 1
    is_refit = first_of_year if cadence == "A" else F.lit(True)
    return (months.withColumn("is_refit", is_refit)
            .withColumn("refit_no", F.sum(F.col("is_refit").cast("int")).over(by_window).cast("int"))
            .withColumn("m_idx", F.row_number().over(by_window) - 1)
            .withColumn("refit_idx", F.last(F.when(F.col("is_refit"), F.col("cal_idx")), ignorenulls=True).over(by_window))
            .select("window_id", "period", "cal_idx", "m_idx", "is_refit", "refit_no", "refit_idx"))


def window_days(returns: DataFrame, windows: DataFrame, cadence: str = "D", cal: DataFrame | None = None) -> DataFrame:
    """Calendar rows of every window, for panels of days: a refit at each (D), or at the first of each month (M).

    Windows are exploded to days, so meeting the calendar is an equi-join.
    """
    cal = (calendar(returns) if cal is None else cal).select("period", "cal_idx")
    days = windows.withColumn("period", F.explode(F.sequence("start_d", "end_d"))).join(F.broadcast(cal), "period")
    by_window = Window.partitionBy("window_id").orderBy("period")
    first = F.row_number().over(Window.partitionBy("window_id", F.trunc("period", "MM")).orderBy("period")) == 1
    return (days.withColumn("is_refit", F.lit(True) if cadence == "D" else first)
            .withColumn("refit_no", F.sum(F.col("is_refit").cast("int")).over(by_window).cast("int"))
            .withColumn("m_idx", F.row_number().over(by_window) - 1)
            .select("window_id", "period", "cal_idx", "m_idx", "is_refit", "refit_no"))


def availability(returns: DataFrame, months: DataFrame, roster: Roster) -> dict[int, int]:
    """Bitmask of the complete series per window. One row per window comes back, no series data."""
    n = months.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_window"))
    counts = (returns.where(F.col("entity").isin(list(roster.names)))
              .join(F.broadcast(months.select("window_id", "period")), "period")
              .groupBy("window_id", "entity").agg(F.count("ret").alias("n_ret")))
    complete = counts.join(F.broadcast(n), "window_id").where("n_ret = n_window")
    bits = F.pow(F.lit(2.0), roster_position(roster).cast("double")).cast("bigint")
    rows = complete.groupBy("window_id").agg(F.sum(bits).alias("available")).collect()
    return {r.window_id: r.available for r in rows}
