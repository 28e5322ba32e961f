"""Market references, both-down months, seasons and real returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import metrics as mt
from tidepanel.operators import regimes as rg
from tidepanel.operators import returns as rt
from tidepanel.plans import fixtures as fx
from tidepanel.plans.oracle import levels, names, q, returns, with_
from tidepanel.plans.registry import query
from tidepanel.plans.signal_queries import BRAND, ORDER, brand_returns
from tidepanel.sources import panels

REFS = ("refs", f"SELECT period, avg(ret) FILTER (entity IN {names(fx.EQUITY_REFERENCE)}) AS eq_ref, "
        f"avg(ret) FILTER (entity IN {names(fx.BOND_REFERENCE)}) AS bd_ref FROM ret GROUP BY 1")
DOWN = ("down", "SELECT *, coalesce(eq_ref < 0, false) AND coalesce(bd_ref < 0, false) AS both_down FROM refs")
LABELS = [("yl", "SELECT * FROM prio_lv"), ("g", f"SELECT period, CASE WHEN count(ret) OVER (ORDER BY period ROWS 11 PRECEDING) = 12 "
           f"THEN product(1 + ret) OVER (ORDER BY period ROWS 11 PRECEDING) - 1 END AS g FROM ret WHERE entity = '{fx.EQUITY[0]}'"),
          ("y", f"SELECT period, level - lag(level, 12) OVER (ORDER BY period) AS i FROM yl WHERE entity = '{fx.YIELD_ENTITY}' AND level IS NOT NULL"),
          ("gi", "SELECT period, CASE WHEN g > 0 THEN 'up' ELSE 'down' END AS growth, CASE WHEN i > 0 THEN 'up' ELSE 'down' END AS inflation "
           "FROM (SELECT DISTINCT period FROM ret) LEFT JOIN g USING (period) LEFT JOIN y USING (period)"),
          ("labels", "SELECT *, CASE WHEN growth = 'up' THEN CASE WHEN inflation = 'up' THEN 'GrowthUp InfUp' ELSE 'GrowthUp InfDown' END "
           "ELSE CASE WHEN inflation = 'up' THEN 'GrowthDown InfUp' ELSE 'GrowthDown InfDown' END END AS season FROM gi")]
CONTEXT = [*BRAND, REFS, DOWN, *levels("priority", "prio_lv"), *LABELS,
           ("ctx", "SELECT down.*, season FROM down LEFT JOIN labels USING (period)")]


@query("both_down_sleeves", with_([*BRAND, REFS, DOWN], f"SELECT period, {q('eq_ref')} AS eq_ref, {q('bd_ref')} AS bd_ref, both_down FROM down"))
def both_down_sleeves(spark, sf_dir):
    return fx.references(brand_returns(spark, sf_dir))


EXTERNAL = [*BRAND, REFS, *returns("segment", "ext"),
            ("x", "SELECT period, max(ret) FILTER (entity = 'BUILDING') AS xe, max(ret) FILTER (entity = 'MACHINERY') AS xb FROM ext GROUP BY 1"),
            ("ref2", "SELECT period, coalesce(xe, eq_ref) AS eq_ref, coalesce(xb, bd_ref) AS bd_ref FROM refs LEFT JOIN x USING (period)")]


def external(spark, sf_dir):
    baskets = rg.basket_references(brand_returns(spark, sf_dir), fx.EQUITY_REFERENCE, fx.BOND_REFERENCE)
    segment = rt.non_null(rt.simple_returns(panels.segment_month(spark, sf_dir)))
    return rg.external_references(baskets, segment, "BUILDING", "MACHINERY")


@query("ref_external", with_(EXTERNAL, f"SELECT period, {q('eq_ref')} AS eq_ref, {q('bd_ref')} AS bd_ref FROM ref2"))
def ref_external(spark, sf_dir):
    return external(spark, sf_dir)


@query("both_down_external", with_(EXTERNAL, "SELECT period, coalesce(eq_ref < 0, false) AND coalesce(bd_ref < 0, false) AS both_down FROM ref2"))
def both_down_external(spark, sf_dir):
    return rg.with_both_down(external(spark, sf_dir)).select("period", "both_down")


@query("regime_labels", with_(CONTEXT, "SELECT period, growth, inflation, season FROM labels"))
def regime_labels(spark, sf_dir):
    return fx.labels(spark, sf_dir, brand_returns(spark, sf_dir))


@query("season_counts", with_(CONTEXT, "SELECT season, count(*) AS n FROM labels GROUP BY 1"))
def season_counts(spark, sf_dir):
    return regime_labels(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


SEASON_SQL = ", ".join(q(f"avg(ret) FILTER (season = '{s}')") + f" AS {mt.season_column(s)}" for s in rg.SEASONS.values())
STAG = "FILTER (season = 'GrowthDown InfUp')"


@query("season_means", with_(CONTEXT, f"""SELECT entity, {SEASON_SQL}, {q(f'avg(ret) {STAG}')} AS "season_Stagflation",
 {q(f'CASE WHEN count(ret) {STAG} >= 6 THEN coalesce(avg(ret) {STAG} / nullif(stddev_samp(ret) {STAG}, 0) * sqrt(12.0), 0.0) END')} AS stag_sharpe,
 count(ret) {STAG} AS stag_n FROM ret LEFT JOIN labels USING (period) GROUP BY 1"""))
def season_means(spark, sf_dir):
    r = brand_returns(spark, sf_dir)
    joined = r.join(F.broadcast(fx.labels(spark, sf_dir, r).select("period", "season")), "period", "left")
    return joined.groupBy("entity").agg(*mt.seasons("ret"))


@query("overlap_regime", with_(CONTEXT, """SELECT count(*) FILTER (both_down) AS n_both_down, count(*) FILTER (season = 'GrowthDown InfUp') AS n_stag,
 count(*) FILTER (both_down AND season = 'GrowthDown InfUp') AS n_overlap,
 round(count(*) FILTER (both_down AND season = 'GrowthDown InfUp') / greatest(count(*) FILTER (both_down), 1), 8) AS share FROM ctx"""))
def overlap_regime(spark, sf_dir):
    r = brand_returns(spark, sf_dir)
    df = fx.references(r).join(F.broadcast(fx.labels(spark, sf_dir, r)), "period", "left")
    down, stag = F.col("both_down"), F.col("season") == rg.STAGFLATION
    counts = df.agg(F.count_if(down).alias("n_both_down"), F.count_if(stag).alias("n_stag"),
                    F.count_if(down & stag).alias("n_overlap"))
    return counts.withColumn("share", F.col("n_overlap") / F.greatest(F.col("n_both_down"), F.lit(1)))


@query("real_return", with_(
    [*BRAND, *returns("priority", "cpi"),
     ("d", "SELECT period, ret AS d FROM cpi WHERE entity = (SELECT min(entity) FROM cpi WHERE entity IN ('4-NOT SPECIFIED', '5-LOW') AND ret IS NOT NULL) "
      "AND NOT (entity = '4-NOT SPECIFIED' AND month(period) = 7)")],
    f"SELECT period, entity, {q('ret')} AS ret, {q('(1 + ret) / (1 + coalesce(d, 0)) - 1')} AS real_ret FROM ret LEFT JOIN d USING (period)"))
def real_return(spark, sf_dir):
    """The first source has a hole every July, which counts as no inflation and isn't filled from the second."""
    candidates = rt.non_null(rt.simple_returns(panels.priority_month(spark, sf_dir)))
    holed = candidates.where((F.col("entity") != "4-NOT SPECIFIED") | (F.month("period") != 7))
    deflator = rg.choose_deflator(holed, ["6-NONE", "4-NOT SPECIFIED", "5-LOW"])
    return rg.deflate(brand_returns(spark, sf_dir), deflator)


PAIR = "CASE WHEN eq_ref IS NOT NULL THEN ret END"
METRICS_SQL = f"""SELECT entity, count(ret) AS n_months, {q('avg(ret) * 12')} AS ann_return_net, {q('stddev_samp(ret) * sqrt(12.0)')} AS ann_vol,
 {q('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12.0), 0.0)')} AS sharpe_net,
 {q('coalesce(covar_samp(ret, eq_ref) / nullif(stddev_samp(ret) * stddev_samp(eq_ref), 0), 0.0)')} AS corr_eq,
 {q('coalesce(covar_samp(ret, bd_ref) / nullif(stddev_samp(ret) * stddev_samp(bd_ref), 0), 0.0)')} AS corr_bd FROM j GROUP BY 1"""
JOINED = [*BRAND, REFS, DOWN, ("j", "SELECT * FROM ret JOIN down USING (period)")]


def joined(spark, sf_dir):
    r = brand_returns(spark, sf_dir)
    return r.join(F.broadcast(fx.references(r)), "period")


@query("metrics_core", with_(JOINED, METRICS_SQL))
def metrics_core(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("entity").agg(*mt.basic("ret"), *mt.references("ret"))


BD = "FILTER (both_down)"


@query("both_down_stats", with_(JOINED, f"""SELECT entity, count(ret) {BD} AS n_both_down, {q(f'coalesce(avg(ret) {BD}, 0.0)')} AS both_down_avg_monthly,
 {q(f'coalesce(avg(ret) {BD} * 12, 0.0)')} AS both_down_annualized, {q(f'coalesce(min(ret) {BD}, 0.0)')} AS both_down_worst_monthly,
 {q(f'coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) {BD}, 0.0)')} AS both_down_hit_rate,
 {q(f'coalesce(covar_samp(ret, eq_ref) {BD} / nullif(stddev_samp(ret) {BD} * stddev_samp(eq_ref) {BD}, 0), 0.0)')} AS corr_eq_bothdown,
 {q('min(bdd)')} AS both_down_maxdd FROM (SELECT j.*, z.bdd FROM j LEFT JOIN (SELECT entity, period, w / max(w) OVER (PARTITION BY entity ORDER BY period) - 1 AS bdd
 FROM (SELECT entity, period, product(1 + ret) OVER (PARTITION BY entity ORDER BY period) AS w FROM j WHERE both_down)) z USING (entity, period)) GROUP BY 1"""))
def both_down_stats(spark, sf_dir):
    df = joined(spark, sf_dir)
    inside = mt.both_down_drawdown(df, ["entity"], "ret")
    return df.groupBy("entity").agg(*mt.both_down("ret")).join(inside, "entity", "left")


def side_sql(test: str) -> str:
    f = f"FILTER (eq_ref {test} 0)"
    return (f"coalesce(CASE WHEN count(*) {f} >= 3 AND var_samp(ret) {f} > 0 "
            f"THEN covar_samp(ret, eq_ref) {f} / nullif(var_samp(eq_ref) {f}, 0) END, 0.0)")


DN = "FILTER (eq_ref < 0)"


@query("beta_updown", with_(JOINED, f"""SELECT entity, {q(side_sql('>'))} AS upside_beta, {q(side_sql('<'))} AS downside_beta,
 {q(f'coalesce(CASE WHEN count(*) {DN} >= 3 THEN covar_samp(ret, eq_ref) {DN} / nullif(stddev_samp(ret) {DN} * stddev_samp(eq_ref) {DN}, 0) END, 0.0)')} AS downside_corr_eq,
 {q('coalesce(avg(ret) FILTER (eq_ref > 0) * 12, 0.0)')} AS up_market_ann, {q(f'coalesce(avg(ret) {DN} * 12, 0.0)')} AS down_market_ann,
 count(*) FILTER (eq_ref > 0) AS n_up_market, count(*) {DN} AS n_down_market FROM j GROUP BY 1"""))
def beta_updown(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("entity").agg(*mt.up_down("ret"))


def inside(x: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, {x}.* FROM {x} WHERE period BETWEEN DATE '{a}' AND DATE '{b}'"
                              for k, (a, b) in fx.CRISES.items())


CRISIS = [*BRAND, ("i", inside("ret")),
          ("w", "SELECT *, product(1 + ret) OVER (PARTITION BY entity, name ORDER BY period) AS lvl FROM i"),
          ("d", "SELECT *, lvl / max(lvl) OVER (PARTITION BY entity, name ORDER BY period) - 1 AS dd FROM w"),
          ("e", "SELECT entity, name, count(ret) AS n_months, product(1 + ret) - 1 AS cum_ret, min(dd) AS max_drawdown FROM d GROUP BY 1, 2")]


@query("episode_stats", with_(CRISIS, f"SELECT entity, name, n_months, {q('cum_ret')} AS cum_ret, {q('max_drawdown')} AS max_drawdown FROM e"))
def episode_stats(spark, sf_dir):
    return mt.episode_stats(brand_returns(spark, sf_dir), mt.catalog(spark, fx.CRISES), ["entity"], "ret")


@query("crisis_stats", with_(CRISIS, f"SELECT entity, {q('avg(cum_ret)')} AS crisis_avg_ret FROM e GROUP BY 1"))
def crisis_stats(spark, sf_dir):
    return brand_returns(spark, sf_dir).groupBy("entity").agg(mt.crisis_average(fx.CRISES, "ret"))
