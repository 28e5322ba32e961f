"""Trailing signals and window functions over every brand series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.ranks import competition_rank_desc, percentile_average, value_ranks
from tidepanel.operators import metrics as mt
from tidepanel.operators import returns as rt
from tidepanel.operators import signals as sg
from tidepanel.operators.signals import SignalSpec
from tidepanel.operators.trials import macro_table
from tidepanel.operators.universe import window_months
from tidepanel.plans import fixtures as fx
from tidepanel.plans.oracle import levels, q, returns, with_
from tidepanel.plans.registry import query
from tidepanel.sources import panels
from tidepanel.sources.panels import table

KEYS = ["entity"]
BRAND = returns("brand")
ORDER = "PARTITION BY entity ORDER BY period"


def brand_returns(spark, sf_dir):
    return rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir)))


def before(length: int) -> str:
    return f"OVER ({ORDER} ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"


THROUGH = f"OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BASE = [*BRAND, ("h", f"SELECT *, row_number() OVER ({ORDER}) - 1 AS t, product(1 + ret) {THROUGH} AS lvl FROM ret"),
        ("h1", f"SELECT *, lag(lvl) OVER ({ORDER}) AS lvl1 FROM h")]
RV = [*BASE, ("h2", f"SELECT *, CASE WHEN t >= 6 THEN stddev_pop(ret) {before(6)} * sqrt(12.0) ELSE 0.0 END AS rv FROM h1"),
      ("h3", f"SELECT *, lag(rv) OVER ({ORDER}) AS rv1, median(rv) {before(60)} AS med FROM h2")]


def sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 ELSE 0.0 END::DOUBLE"


def machine(source: str, exit_: str, enter: str) -> list[tuple[str, str]]:
    """Two-state machine as a recursive walk, row by row: an independent form of the window one."""
    return [("trig", f"SELECT period, entity, t, coalesce({exit_}, false) AS x, coalesce({enter}, false) AS e FROM {source}"),
            ("walk", "SELECT entity, t, period, CASE WHEN x THEN -1.0 ELSE 1.0 END::DOUBLE AS sig FROM trig WHERE t = 0 UNION ALL "
             "SELECT n.entity, n.t, n.period, CASE WHEN walk.sig > 0 AND n.x THEN -1.0 WHEN walk.sig < 0 AND n.e THEN 1.0 "
             "ELSE walk.sig END::DOUBLE FROM walk JOIN trig n ON n.entity = walk.entity AND n.t = walk.t + 1")]


def recursive(ctes, select: str) -> str:
    return with_(ctes, select).replace("WITH ", "WITH RECURSIVE ", 1)


def signal(name: str, spec: SignalSpec, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        history = sg.with_levels(brand_returns(spark, sf_dir), KEYS)
        return sg.add_signal(history, KEYS, spec, "sig").select("period", "entity", "sig")


def plain(value: str, ctes=BASE, source: str = "h1") -> str:
    return with_(ctes, f"SELECT period, entity, CAST({value} AS DOUBLE) AS sig FROM {source}")


MOM12 = f"CASE WHEN count(ret) {before(12)} = 12 THEN product(1 + ret) {before(12)} - 1 END"
signal("sig_tsmom", SignalSpec("mom", (12,)), plain(q(MOM12)))
signal("sig_ma", SignalSpec("ma", (10,)), plain(
    f"CASE WHEN t >= 10 THEN {sign(f'(lvl1 - avg(lvl) {before(10)})')} ELSE 0.0 END"))
signal("sig_dma", SignalSpec("dma", (3, 10)), plain(
    f"CASE WHEN t >= 10 THEN {sign(f'(avg(lvl) {before(3)} - avg(lvl) {before(10)})')} ELSE 0.0 END"))
signal("sig_vol", SignalSpec("vol", (6, 60)), plain(
    f"CASE WHEN t >= 60 THEN {sign('(med - rv1)')} ELSE 0.0 END", RV, "h3"))
AVG = [*BASE, ("h4", f"SELECT *, avg(lvl) {before(3)} AS fast, avg(lvl) {before(12)} AS slow FROM h1")]
signal("sig_asym_ma", SignalSpec("asym_ma", (3, 12)), recursive(
    [*AVG, *machine("h4", "t >= 12 AND lvl1 < fast", "t >= 12 AND lvl1 > slow")], "SELECT period, entity, sig FROM walk"))
DD = [*BASE, ("h5", f"SELECT *, CASE WHEN t >= 6 THEN (lvl1 - max(lvl) {before(6)}) / max(lvl) {before(6)} END AS dd FROM h1")]
signal("sig_dd_stop", SignalSpec("dd_stop", (6, 0.10, 0.03)), recursive(
    [*DD, *machine("h5", "dd < -0.10", "dd > -0.03")], "SELECT period, entity, sig FROM walk"))
signal("sig_eq_dd", SignalSpec("eq_dd", (6, 0.10, 0.03)), plain(
    "CASE WHEN dd < -0.10 THEN -1.0 WHEN dd > -0.03 THEN 1.0 ELSE 0.0 END", DD, "h5"))
signal("sig_asym_vol", SignalSpec("asym_vol", (6, 60, 1.0, 0.85)), recursive(
    [*RV, *machine("h3", "t >= 60 AND rv1 > 1.0 * med", "t >= 60 AND rv1 < 0.85 * med")],
    "SELECT period, entity, sig FROM walk"))


@query("roll_ret_12", with_(BRAND, f"""SELECT period, entity, {q(f'''CASE WHEN count(ret) OVER ({ORDER} ROWS 11 PRECEDING) = 12
 THEN product(1 + ret) OVER ({ORDER} ROWS 11 PRECEDING) - 1 END''')} AS r12 FROM ret"""))
def roll_ret_12(spark, sf_dir):
    return brand_returns(spark, sf_dir).select("period", "entity", sg.rolling_compound(KEYS, 12).alias("r12"))


@query("diff_12", with_(levels("nation"), f"SELECT period, entity, {q(f'level - lag(level, 12) OVER ({ORDER})')} AS d12 "
                        "FROM lv WHERE level IS NOT NULL"))
def diff_12(spark, sf_dir):
    lv = panels.nation_month(spark, sf_dir).where(F.col("level").isNotNull())
    return lv.select("period", "entity", sg.step_difference(KEYS, "level", 12).alias("d12"))


@query("wealth", with_(BASE, f"SELECT period, entity, {q('lvl')} AS wealth FROM h1"))
def wealth(spark, sf_dir):
    return brand_returns(spark, sf_dir).select("period", "entity", sg.wealth(KEYS).alias("wealth"))


PEAK = [*BASE, ("d", f"SELECT *, lvl / max(lvl) {THROUGH} - 1 AS dd FROM h1")]


@query("drawdown", with_(PEAK, f"SELECT period, entity, {q('lvl')} AS wealth, {q('dd')} AS dd FROM d"))
def drawdown(spark, sf_dir):
    return sg.drawdown(brand_returns(spark, sf_dir), KEYS).select("period", "entity", "wealth", "dd")


@query("dd_dates", with_(
    [*PEAK, ("m", "SELECT entity, min(dd) AS mdd, arg_min(period, dd) AS trough, min(period) AS first FROM d GROUP BY 1"),
     ("p", "SELECT d.entity, arg_max(d.period, d.lvl) AS peak FROM d JOIN m ON d.entity = m.entity AND d.period <= m.trough GROUP BY 1")],
    f"SELECT entity, {q('mdd')} AS max_drawdown, CASE WHEN mdd < 0 THEN peak ELSE first END AS peak, "
    "CASE WHEN mdd < 0 THEN trough ELSE first END AS trough FROM m JOIN p USING (entity)"))
def dd_dates(spark, sf_dir):
    series = brand_returns(spark, sf_dir).withColumnRenamed("ret", "net")
    return mt.drawdown_stats(series, KEYS).select("entity", "max_drawdown", "peak", "trough")


@query("drawdown_stats", with_(
    PEAK, f"SELECT entity, {q('min(dd)')} AS max_drawdown, {q('sqrt(avg(dd * dd))')} AS ulcer, "
    f"{q('avg(ret) * 12 / nullif(abs(min(dd)), 0)')} AS calmar FROM d GROUP BY 1"))
def drawdown_stats(spark, sf_dir):
    series = brand_returns(spark, sf_dir).withColumnRenamed("ret", "net")
    return mt.drawdown_stats(series, KEYS).select("entity", "max_drawdown", "ulcer", "calmar")


def proxy(entity: str, kind: str, value: str) -> str:
    return with_(BRAND, f"SELECT period, {value} AS flag FROM ret WHERE entity = '{entity}'")


def proxy_mom(length: int) -> str:
    return f"coalesce(CASE WHEN count(ret) {before(length)} = {length} THEN product(1 + ret) {before(length)} - 1 END, 0.0)"


@query("sig_infl", proxy("Brand#9", "infl", f"{proxy_mom(12)} > 0"))
def sig_infl(spark, sf_dir):
    table_ = macro_table(brand_returns(spark, sf_dir), fx.ROSTER, [fx.BY_NAME["EW-Infl-Dur"]])
    return table_.where("key = 'infl:12'").select("period", (F.col("value") > 0).alias("flag"))


@query("sig_eq_confirm", with_(BRAND, "SELECT period, 3 AS lookback, " + f"{proxy_mom(3)} < 0 AS flag FROM ret WHERE entity = 'Brand#1' "
                               f"UNION ALL SELECT period, 6, {proxy_mom(6)} < 0 FROM ret WHERE entity = 'Brand#1'"))
def sig_eq_confirm(spark, sf_dir):
    schemes = [fx.BY_NAME["EW-InflC-Both"], fx.BY_NAME["EW-InflC-Both6"]]
    df = macro_table(brand_returns(spark, sf_dir), fx.ROSTER, schemes).where(F.col("key").startswith("eq:"))
    return df.select("period", F.split("key", ":")[1].cast("int").alias("lookback"), (F.col("value") < 0).alias("flag"))


@query("refit_dates", with_(
    [*BRAND, ("m", "SELECT DISTINCT period FROM ret"), ("r", "SELECT period, row_number() OVER (PARTITION BY year(period) ORDER BY period) AS k FROM m")],
    "SELECT period FROM r WHERE k = 1"))
def refit_dates(spark, sf_dir):
    r = brand_returns(spark, sf_dir)
    span = r.agg(F.lit(0).alias("window_id"), F.min("period").alias("start_d"), F.max("period").alias("end_d"))
    return window_months(r, span).where("is_refit").select("period")


@query("asof_target", with_(
    [*BRAND, ("m", "SELECT DISTINCT period FROM ret"),
     ("r", "SELECT min(period) AS refit FROM m GROUP BY year(period)"),
     ("t", "SELECT refit, entity, ret AS target FROM r JOIN ret ON ret.period = r.refit")],
    f"SELECT m.period, t.entity, {q('t.target')} AS target FROM m ASOF JOIN (SELECT DISTINCT refit FROM t) x ON m.period >= x.refit "
    "JOIN t ON t.refit = x.refit"))
def asof_target(spark, sf_dir):
    r = brand_returns(spark, sf_dir)
    span = r.agg(F.lit(0).alias("window_id"), F.min("period").alias("start_d"), F.max("period").alias("end_d"))
    months = window_months(r, span)
    targets = (r.join(F.broadcast(months.where("is_refit").select("period", "refit_no")), "period")
               .select("refit_no", "entity", F.col("ret").alias("target")))
    return months.join(targets, "refit_no").select("period", "entity", "target")


@query("moments", with_(BRAND, f"SELECT entity, count(ret) AS n, {q('avg(ret)')} AS mean, {q('stddev_samp(ret)')} AS std, "
                        f"{q('skewness(ret)')} AS skew, {q('kurtosis(ret)')} AS kurt FROM ret GROUP BY 1"))
def moments(spark, sf_dir):
    return mt.moments(KEYS, brand_returns(spark, sf_dir), "ret")


@query("cumret", with_(BRAND, f"SELECT entity, {q('product(1 + ret) - 1')} AS cum_ret FROM ret GROUP BY 1"))
def cumret(spark, sf_dir):
    return brand_returns(spark, sf_dir).groupBy("entity").agg(mt.cumulative_return("ret").alias("cum_ret"))


@query("cagr", with_(BRAND, f"SELECT entity, {q('CASE WHEN count(ret) >= 2 AND product(1 + ret) > 0 THEN pow(product(1 + ret), 12.0 / count(ret)) - 1 END')} "
                     "AS cagr FROM ret GROUP BY 1"))
def cagr(spark, sf_dir):
    return brand_returns(spark, sf_dir).groupBy("entity").agg(mt.cagr("ret"))


@query("sortino", with_(BRAND, "SELECT entity, " + q(
    "coalesce(CASE WHEN count(*) FILTER (ret < 0) > 1 THEN avg(ret) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) * sqrt(12.0) END, 0.0)")
    + " AS sortino FROM ret GROUP BY 1"))
def sortino(spark, sf_dir):
    return brand_returns(spark, sf_dir).groupBy("entity").agg(mt.sortino("ret"))


@query("pct_rank_avg", "WITH r AS (SELECT l_extendedprice AS v, rank() OVER (ORDER BY l_extendedprice) AS k, "
       "count(*) OVER (PARTITION BY l_extendedprice) AS ties, count(*) OVER () AS n FROM lineitem) "
       f"SELECT v, ties AS n_equal, {q('(k + (ties - 1) / 2.0) / n')} AS pct FROM r GROUP BY v, ties, k, n")
def pct_rank_avg(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v"))
    return value_ranks(values, [], "v").select("v", "n_equal", percentile_average().alias("pct"))


@query("rank_min", "SELECT DISTINCT o_totalprice AS v, rank() OVER (ORDER BY o_totalprice DESC) AS rank FROM orders")
def rank_min(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    return value_ranks(values, [], "v").select("v", competition_rank_desc().alias("rank"))
