"""Performance metrics: one aggregate per series over its months.

The statistics share their counts and moments on purpose: the aggregate stays in generated
code only while its keys and buffers are at most 100 fields.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import annual_sharpe, safe_div, zero_if_null
from tidepanel.operators import signals as sg
from tidepanel.operators.regimes import SEASONS, STAGFLATION
from tidepanel.operators.universe import Roster, month_ends_between

Windows = Mapping[str, tuple[str, str]]


def mean(x: Column, n: Column) -> Column:
    """Average over a count that other statistics use too; null over no rows."""
    return safe_div(F.sum(x), n.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation, null when a side is flat."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def paired_correlation(x: Column, y: Column) -> Column:
    """The same for columns that are null together."""
    return safe_div(F.covar_samp(x, y), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)))


def basic(net: str = "net") -> list[Column]:
    x = F.col(net)
    n = F.count(x)
    return [
        n.alias("n_months"),
        (mean(x, n) * 12).alias("ann_return_net"),
        (F.stddev_samp(x) * math.sqrt(12)).alias("ann_vol"),
        annual_sharpe(mean(x, n), F.stddev_samp(x), n).alias("sharpe_net"),
    ]


def costs(net: str = "net") -> list[Column]:
    g, n = F.col("gross"), F.count(net)
    return [
        (mean(g, n) * 12).alias("ann_return_gross"),
        annual_sharpe(mean(g, n), F.stddev_samp(g), n).alias("sharpe_gross"),
        mean(F.col("turnover"), n).alias("avg_turnover"),
        (mean(F.col("turnover"), n) * 12).alias("ann_turnover"),
    ]


def references(net: str = "net") -> list[Column]:
    x = F.col(net)
    return [zero_if_null(correlation(x, F.col("eq_ref"))).alias("corr_eq"),
            zero_if_null(correlation(x, F.col("bd_ref"))).alias("corr_bd")]


def both_down(net: str = "net") -> list[Column]:
    hit = F.coalesce(F.col("both_down"), F.lit(False))
    x, eq = F.when(hit, F.col(net)), F.when(hit, F.col("eq_ref"))
    n = F.count(x)
    return [
        n.alias("n_both_down"),
        zero_if_null(mean(x, n)).alias("both_down_avg_monthly"),
        zero_if_null(mean(x, n) * 12).alias("both_down_annualized"),
        zero_if_null(F.min(x)).alias("both_down_worst_monthly"),
        zero_if_null(mean((x > 0).cast("double"), n)).alias("both_down_hit_rate"),
        zero_if_null(paired_correlation(x, eq)).alias("corr_eq_bothdown"),
    ]


def up_down(net: str = "net") -> list[Column]:
    """Beta, correlation and mean on months the equity reference rose or fell."""
    def side(test: Column) -> tuple[Column, Column]:
        return F.when(test, F.col(net)), F.when(test, F.col("eq_ref"))

    def beta(x: Column, eq: Column) -> Column:
        ok = (F.count(eq) >= 3) & (F.var_samp(x) > 0)
        return zero_if_null(F.when(ok, safe_div(F.covar_samp(x, eq), F.var_samp(eq))))

    xu, eu = side(F.col("eq_ref") > 0)
    xd, ed = side(F.col("eq_ref") < 0)
    return [
        beta(xu, eu).alias("upside_beta"), beta(xd, ed).alias("downside_beta"),
        zero_if_null(F.when(F.count(ed) >= 3, paired_correlation(xd, ed))).alias("downside_corr_eq"),
        zero_if_null(mean(xu, F.count(eu)) * 12).alias("up_market_ann"),
        zero_if_null(mean(xd, F.count(ed)) * 12).alias("down_market_ann"),
        F.count(eu).alias("n_up_market"), F.count(ed).alias("n_down_market"),
    ]


def season_column(season: str) -> str:
    return "season_" + season.replace(" ", "_")


def seasons(net: str = "net") -> list[Column]:
    def of(name: str) -> Column:
        return F.when(F.col("season") == name, F.col(net))
    stag = of(STAGFLATION)
    n = F.count(stag)
    means = {name: mean(of(name), F.count(of(name))) for name in SEASONS.values()}
    return [*[m.alias(season_column(name)) for name, m in means.items()],
            means[STAGFLATION].alias("season_Stagflation"),
            F.when(n >= 6, annual_sharpe(means[STAGFLATION], F.stddev_samp(stag), n)).alias("stag_sharpe"),
            n.alias("stag_n")]


def crisis_average(windows: Windows, net: str = "net") -> Column:
    """Mean of the compounded returns of the windows that have months."""
    total, n = F.lit(0.0), F.lit(0)
    for start, end in windows.values():
        inside = F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        growth = F.product(F.when(inside, 1 + F.col(net)))
        total = total + zero_if_null(growth - 1)
        n = n + growth.isNotNull().cast("int")
    return zero_if_null(safe_div(total, n.cast("double"))).alias("crisis_avg_ret")


def trial_metrics(trials: DataFrame, keys: Sequence[str], crisis: Windows | None = None) -> DataFrame:
    """One row per trial. Needs ``net, gross, turnover`` and the reference columns that are present."""
    have = set(trials.columns)
    df = sg.drawdown_in_order(trials, list(keys), "net")
    stats = [*basic(), *costs(), F.min("dd").alias("max_drawdown"),
             F.sqrt(mean(F.col("dd") * F.col("dd"), F.count("net"))).alias("ulcer")]
    if {"eq_ref", "bd_ref"} <= have:
        stats += references()
    if {"both_down", "eq_ref"} <= have:
        stats += both_down()
    if "eq_ref" in have:
        stats += up_down()
    if "season" in have:
        stats += seasons()
    if crisis:
        stats.append(crisis_average(crisis))
    stats += [F.max_by("notional", "period").alias("gross_notional_last")] if "notional" in have else []
    out = df.groupBy(*keys).agg(*stats)
    if "upside_beta" in out.columns:
        out = out.withColumn("updown_beta_diff", F.col("upside_beta") - F.col("downside_beta"))
    return out


def sortino(net: str = "net") -> Column:
    """Mean over the deviation of the negative months only."""
    down = F.when(F.col(net) < 0, F.col(net))
    ratio = safe_div(F.avg(net), F.stddev_samp(down)) * math.sqrt(12)
    return zero_if_null(F.when(F.count(down) > 1, ratio)).alias("sortino")


def drawdown_stats(series: DataFrame, keys: Sequence[str], net: str = "net") -> DataFrame:
    """Depth, peak and trough month, ulcer index and Calmar ratio (null without a drawdown)."""
    df = sg.drawdown(series, list(keys), net).withColumn("_peak", F.col("peak.period"))
    out = df.groupBy(*keys).agg(
        F.min("dd").alias("max_drawdown"), F.min("period").alias("_first"),
        F.min_by("period", F.struct("dd", "period")).alias("_trough"),
        F.min_by("_peak", F.struct("dd", "period")).alias("_at"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), (F.avg(net) * 12).alias("ann_return"))
    fell = F.col("max_drawdown") < 0
    return out.select(*keys, "max_drawdown", F.when(fell, F.col("_at")).otherwise(F.col("_first")).alias("peak"),
                      F.when(fell, F.col("_trough")).otherwise(F.col("_first")).alias("trough"), "ulcer",
                      safe_div(F.col("ann_return"), F.abs("max_drawdown")).alias("calmar"))


def cagr(net: str = "net") -> Column:
    growth = F.product(1 + F.col(net))
    n = F.count(net)
    return F.when((n >= 2) & (growth > 0), F.pow(growth, safe_div(F.lit(12.0), n.cast("double"))) - 1).alias("cagr")


def cumulative_return(net: str = "net") -> Column:
    return F.product(1 + F.col(net)) - 1


def window_rows(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each series inside each named window ``(name, start_d, end_d)``.

    The catalog is exploded to month-ends, so the range join is an equi-join on the period.
    """
    months = windows.select("name", F.explode(month_ends_between(F.col("start_d"), F.col("end_d"))).alias("period"))
    return series.join(F.broadcast(months), "period")


def episode_stats(series: DataFrame, windows: DataFrame, keys: Sequence[str], net: str = "net") -> DataFrame:
    """Compounded return and drawdown per series and window."""
    inside = [*keys, "name"]
    df = sg.drawdown(window_rows(series, windows), inside, net)
    return df.groupBy(*inside).agg(F.count(net).alias("n_months"), cumulative_return(net).alias("cum_ret"),
                                   F.min("dd").alias("max_drawdown"))


def catalog(spark, windows: Windows) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in windows.items()], "name string, a string, b string").select(
        "name", F.col("a").cast("date").alias("start_d"), F.col("b").cast("date").alias("end_d"))


def moments(keys: Sequence[str], df: DataFrame, x: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis (null for short or flat series)."""
    d = df.groupBy(*keys).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                              F.when(F.var_pop(x) > 0, F.skewness(x)).alias("g1"),
                              F.when(F.var_pop(x) > 0, F.kurtosis(x)).alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, safe_div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return d.select(*keys, n.cast("bigint").alias("n"), "mean", "std", skew.alias("skew"), kurt.alias("kurt"))


def diversification_ratio(weights: DataFrame, cov: DataFrame, roster: Roster, refit: str = "refit_no") -> DataFrame:
    """w·vol / sqrt(w'Sw) per weight row, joined on (window_id, refit)."""
    n = roster.n
    df = weights.join(F.broadcast(cov.select("window_id", F.col("refit_no").alias(refit), "cov", "vol")),
                      ["window_id", refit])
    spread = " + ".join(f"b_{i} * vol[{i}]" for i in range(n))
    quad = " + ".join(f"{1 if i == j else 2} * b_{i} * b_{j} * cov[{i * n + j}]" for i in range(n) for j in range(i, n))
    return df.withColumn("div_ratio", F.expr(f"({spread}) / sqrt(greatest({quad}, 1e-30D))")).drop("cov", "vol")


def both_down_drawdown(series: DataFrame, keys: Sequence[str], net: str = "net") -> DataFrame:
    """Drawdown of the curve made of the both-down months only."""
    only = sg.drawdown(series.where(F.coalesce("both_down", F.lit(False))), list(keys), net)
    return only.groupBy(*keys).agg(F.min("dd").alias("both_down_maxdd"))
