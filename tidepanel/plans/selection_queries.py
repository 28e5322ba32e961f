"""Scores, train/test evaluation, walk-forward and rolling selection, overfit statistics."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.scalar import fixed_text, percent_text
from tidepanel.operators import books as bk
from tidepanel.operators import returns as rt
from tidepanel.operators import selection as sl
from tidepanel.operators import stats as st
from tidepanel.operators.metrics import trial_metrics
from tidepanel.operators.scoring import quick_score, score_and_rank
from tidepanel.operators.search import evaluate, plan_metrics, search, top, winners
from tidepanel.operators.trials import TRIAL_KEYS, plan_trials, trial_months
from tidepanel.operators.universe import Roster, combo_text
from tidepanel.plans import book_queries as bq
from tidepanel.plans import fixtures as fx
from tidepanel.plans import trial_sql as ts
from tidepanel.plans.oracle import q, recursive, with_
from tidepanel.plans.registry import query
from tidepanel.plans.regime_queries import CONTEXT
from tidepanel.plans.signal_queries import BRAND
from tidepanel.plans.trial_queries import SEARCH_SCHEMES
from tidepanel.session import materialize
from tidepanel.sources import panels

R, S = fx.ROSTER, fx.SETTINGS
SCORED = [fx.BY_NAME[x] for x in ("EW", "InvVol", "InvVar", "LS-TSMOM", "EW-Short")]
COV3 = SCORED[:3]
TRIAL = ["window_id", "scheme", "mask"]


def ranked(spark, sf_dir, schemes, mode: str, spans=(fx.TRAIN,), r=None, ctx=None, also=None) -> DataFrame:
    r = fx.brand_returns(spark, sf_dir) if r is None else r
    ctx = fx.context(spark, sf_dir, r) if ctx is None else ctx
    return search(r, fx.window(spark, *spans), R, schemes, S, ctx, mode, also=also)


for _mode, _name in (("v1", "score_v1"), ("default", "score_default"), ("asymmetric", "score_asym"),
                     ("asymmetric2", "score_asym2"), ("seasons", "score_seasons")):
    query(_name, recursive(ts.search_ctes((fx.TRAIN,), SCORED, _mode), f"SELECT scheme, mask, rank, {q('resilience_score', 6)} AS resilience_score FROM sco"), digits=6)(
        lambda spark, sf_dir, m=_mode: ranked(spark, sf_dir, SCORED, m).select("scheme", "mask", "rank", "resilience_score"))


def quick_sql(mode: str, zero: bool) -> str:
    wrap = lambda x: f"coalesce({x}, 0)" if zero else x
    return " + ".join(f"{w} * {'-' if t.startswith('-') else ''}{wrap(t.lstrip('-'))}" for t, w in ts.SCORES[mode].items())


@query("score_quick", recursive(ts.search_ctes((fx.TRAIN,), SCORED, "default"),
                                f"SELECT scheme, mask, {q(quick_sql('default', False), 7)} AS quick, {q(quick_sql('seasons', True), 7)} AS quick_seasons FROM metd"), digits=7)
def score_quick(spark, sf_dir):
    df = ranked(spark, sf_dir, SCORED, "default")
    return df.select("scheme", "mask", quick_score("default").alias("quick"), quick_score("seasons", True).alias("quick_seasons"))


TOP_COLUMNS = ["resilience_score", "sharpe_net", "max_drawdown"]
EWS = [s for s in fx.EW_SCHEMES]
TRAIN_SQL = ts.search_ctes((fx.TRAIN,), EWS, "asymmetric2")


@query("topk_trials", recursive(TRAIN_SQL, "SELECT " + ts.pick(TOP_COLUMNS, ["scheme", "mask", "rank"]) + " FROM sco ORDER BY rank, mask, scheme LIMIT 50"), digits=6)
def topk_trials(spark, sf_dir):
    return top(ranked(spark, sf_dir, EWS, "asymmetric2"), 50).select("scheme", "mask", "rank", *TOP_COLUMNS)


BEST = ("best", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY rank, mask) AS k FROM sco) WHERE k = 1")


@query("best_per_family", recursive([*TRAIN_SQL, BEST], "SELECT " + ts.pick(TOP_COLUMNS, ["scheme", "mask", "rank"]) + " FROM best"), digits=6)
def best_per_family(spark, sf_dir):
    best = winners(ranked(spark, sf_dir, EWS, "asymmetric2"), ["window_id", "scheme"])
    return best.select("scheme", "mask", "rank", *TOP_COLUMNS)


def rename(ctes, prefix: str):
    """The same CTEs under other names, so that two grids fit into one statement."""
    import re
    names = [n for n, _ in ctes]
    pattern = re.compile(r"\b(" + "|".join(sorted((re.escape(n) for n in names), key=len, reverse=True)) + r")\b(?!\s*\()")
    return [(prefix + n, pattern.sub(lambda m: prefix + m.group(1), b)) for n, b in ctes]


def test_grid(only: str, schemes, spans=(fx.TEST,), win=None) -> list:
    """Test-window months and metrics of the trials listed in ``only``; CTE names get a prefix.

    The context is shared with the training grid, the rest is built again for the test window.
    """
    grid = [*ts.trial_ctes(spans, R, schemes, S, win=win, only="zz_only"), *ts.metric_ctes(), *ts.div_ctes(schemes)]
    done = rename(grid, "te_")
    return [(n, b.replace("zz_only", only)) for n, b in done]


AT_TRAIN = ("atr", "SELECT *, 0 AS one FROM sco WHERE window_id = 0 ORDER BY rank, mask, scheme LIMIT 50")
SWAP = ("pickd", "SELECT 0 AS window_id, scheme, mask FROM atr")
EVAL = [*ts.search_ctes((fx.TRAIN,), SCORED, "asymmetric2", also=fx.TEST), AT_TRAIN, SWAP, *test_grid("pickd", SCORED),
        *ts.score_ctes("asymmetric2", "te_metd", "tsc"),
        ("ev", "SELECT tsc.*, tsc.rank AS test_rank, tsc.resilience_score AS test_score, atr.rank AS train_rank, atr.resilience_score AS train_score, atr.sharpe_net AS train_sharpe, "
         "atr.both_down_annualized AS train_both_down_ann FROM tsc JOIN atr USING (scheme, mask)")]
EV_COLUMNS = ["train_score", "train_sharpe", "sharpe_net", "ann_return_net", "both_down_annualized", "max_drawdown", "upside_beta", "downside_beta", "test_score"]


def evaluation(spark, sf_dir, schemes=SCORED) -> tuple[DataFrame, DataFrame]:
    r = fx.brand_returns(spark, sf_dir)
    ctx = fx.context(spark, sf_dir, r)
    train = ranked(spark, sf_dir, schemes, "asymmetric2", r=r, ctx=ctx, also=fx.window(spark, fx.TEST))
    return train, sl.test_of_top(r, train, 50, fx.window(spark, fx.TEST), R, schemes, S, ctx, "asymmetric2")


@query("test_eval", recursive(EVAL, "SELECT " + ts.pick(EV_COLUMNS, ["scheme", "mask", "train_rank", "test_rank"]) + " FROM ev"), digits=6)
def test_eval(spark, sf_dir):
    return evaluation(spark, sf_dir)[1].select("scheme", "mask", "train_rank", "test_rank", *EV_COLUMNS)


COMPARE = {"test_sharpe_mean": "sharpe_net", "test_both_down_ann_mean": "both_down_annualized", "test_maxdd_mean": "max_drawdown",
           "test_divratio_mean": "div_ratio", "test_score_mean": "test_score", "train_rank_mean": "train_rank"}


@query("scheme_comparison", recursive(EVAL, "SELECT scheme, count(*) AS n, " + ", ".join(f"{q(f'avg({c})', 6)} AS {k}" for k, c in COMPARE.items())
                                      + " FROM ev GROUP BY 1 ORDER BY test_score_mean DESC"), digits=6)
def scheme_comparison(spark, sf_dir):
    df = evaluation(spark, sf_dir)[1]
    return (df.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in COMPARE.items()])
            .orderBy(F.desc("test_score_mean")))


T10 = ("t10", "SELECT scheme, mask FROM ev ORDER BY train_rank, mask, scheme LIMIT 10")
T20 = ("t20", "SELECT scheme, mask FROM ev ORDER BY test_rank, mask, scheme LIMIT 20")


@query("topk_overlap", recursive([*EVAL, T10, T20], "SELECT count(*) AS n_shared FROM t10 JOIN t20 USING (scheme, mask)"))
def topk_overlap(spark, sf_dir):
    df = materialize(evaluation(spark, sf_dir)[1].select("scheme", "mask", "train_rank", "test_rank"))
    ten = df.orderBy("train_rank", "mask", "scheme").limit(10)
    twenty = df.orderBy("test_rank", "mask", "scheme").limit(20).select("scheme", "mask")
    return ten.join(twenty, ["scheme", "mask"]).agg(F.count(F.lit(1)).alias("n_shared"))


ROUND8 = lambda c: f"CASE WHEN round({c}, 8) = 0 THEN 0.0 ELSE round({c}, 8) END"
DIAG = [*EVAL, T10, T20,
        ("sp", "SELECT avg(resilience_score) AS m, stddev_samp(resilience_score) AS sd, count(*) AS n FROM sco WHERE window_id = 0"),
        ("wn", "SELECT * FROM ev ORDER BY train_rank, mask, scheme LIMIT 1"), ("ov", "SELECT count(*) / 10.0 AS sh FROM t10 JOIN t20 USING (scheme, mask)"),
        ("rk", f"SELECT rank() OVER (ORDER BY {ROUND8('train_score')}) + (count(*) OVER (PARTITION BY {ROUND8('train_score')}) - 1) / 2.0 AS a, "
         f"rank() OVER (ORDER BY {ROUND8('test_score')}) + (count(*) OVER (PARTITION BY {ROUND8('test_score')}) - 1) / 2.0 AS b FROM ev"),
        ("rh", "SELECT covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS rho FROM rk")]
DIAG_COLUMNS = {"train_score_mean": "m", "train_score_std": "sd", "winner_train_score": "train_score", "winner_train_sharpe": "train_sharpe",
                "winner_test_sharpe": "sharpe_net", "winner_train_both_down": "train_both_down_ann", "winner_test_both_down": "both_down_annualized",
                "top10_train_in_top20_test": "sh", "spearman_train_test_score": "rho", "winner_train_score_z": "(train_score - m) / greatest(sd, 1e-9)",
                "winner_sharpe_degradation": "sharpe_net - train_sharpe", "winner_both_down_degradation": "both_down_annualized - train_both_down_ann"}


@query("overfit_diag", recursive(DIAG, "SELECT sp.n AS n_trials, " + ", ".join(f"{q(v, 6)} AS {k}" for k, v in DIAG_COLUMNS.items()) + " FROM sp, wn, ov, rh"), digits=6)
def overfit_diag(spark, sf_dir):
    train, ev = evaluation(spark, sf_dir)
    return st.overfit_diagnostics(train, materialize(ev))


MENU_SQL = [*ts.search_ctes((fx.TRAIN,), EWS, "asymmetric2", also=fx.TEST), BEST, ("pickd", "SELECT 0 AS window_id, scheme, mask FROM best"),
            *rename([*ts.trial_ctes((fx.TEST,), R, EWS, S, only="zz_only"), *ts.metric_ctes()], "te_")]
MENU_SQL = [(n, b.replace("zz_only", "pickd")) for n, b in MENU_SQL]


def menu_metrics(spark, sf_dir) -> DataFrame:
    r = fx.brand_returns(spark, sf_dir)
    ctx = fx.context(spark, sf_dir, r)
    best = winners(ranked(spark, sf_dir, EWS, "asymmetric2", r=r, ctx=ctx, also=fx.window(spark, fx.TEST)), ["window_id", "scheme"])
    return plan_metrics(evaluate(r, fx.window(spark, fx.TEST), best.select(*TRIAL), R, EWS, S, ctx))


@query("fmt_menu", recursive(MENU_SQL, "SELECT scheme, coalesce(printf('%.2f%%', ann_return_net * 100), 'n/a') AS ann_ret, coalesce(printf('%.2f', sharpe_net), 'n/a') AS sharpe, "
                             "coalesce(printf('%.2f%%', max_drawdown * 100), 'n/a') AS maxdd, coalesce(printf('%.2f%%', \"season_GrowthDown_InfUp\" * 100), 'n/a') AS stagflation, "
                             "coalesce(printf('%.2f', gross_notional_last), 'n/a') AS gross FROM te_met ORDER BY sharpe_net DESC NULLS LAST"))
def fmt_menu(spark, sf_dir):
    df = menu_metrics(spark, sf_dir).orderBy(F.desc_nulls_last("sharpe_net"))
    return df.select("scheme", percent_text(F.col("ann_return_net")).alias("ann_ret"), fixed_text(F.col("sharpe_net")).alias("sharpe"),
                     percent_text(F.col("max_drawdown")).alias("maxdd"), percent_text(F.col("season_GrowthDown_InfUp")).alias("stagflation"),
                     fixed_text(F.col("gross_notional_last")).alias("gross"))


@query("gross_cost", recursive(MENU_SQL, f"SELECT scheme, mask, {q('gross_notional_last', 6)} AS gross_notional_last, "
                               f"{q(f'greatest(gross_notional_last - 1, 0) * {S.lev_rate}', 6)} AS lev_cost_ann FROM te_met"), digits=6)
def gross_cost(spark, sf_dir):
    df = menu_metrics(spark, sf_dir)
    return df.select("scheme", "mask", "gross_notional_last",
                     (F.greatest(F.col("gross_notional_last") - 1, F.lit(0.0)) * S.lev_rate).alias("lev_cost_ann"))


#: The whole menu: the benchmark and the training winner of every scheme, on the test window.
BENCH = [bq.sql_weights({"All-Weather": fx.STATIC}), ("bk", f"SELECT portfolio, period, entity, w, ret FROM wr JOIN ret USING (entity) WHERE period BETWEEN DATE '{fx.TEST[0]}' AND DATE '{fx.TEST[1]}'"),
         *bq.cost_ctes(S.cost), ("bmt", "SELECT 0 AS window_id, portfolio AS scheme, 0::BIGINT AS mask, period, 0 AS n_sleeves, gross, turnover, 1.0::DOUBLE AS notional, net FROM fc"),
         *ts.metric_ctes("bmt", "bmm")]
FULL_MENU_SQL = [*ts.search_ctes((fx.TRAIN,), SEARCH_SCHEMES, "asymmetric2", also=fx.TEST), BEST, ("pickd", "SELECT 0 AS window_id, scheme, mask FROM best"),
                 *rename([*ts.trial_ctes((fx.TEST,), R, SEARCH_SCHEMES, S, only="zz_only"), *ts.metric_ctes()], "te_"), *BENCH,
                 ("allm", "SELECT * FROM te_met UNION ALL BY NAME SELECT * FROM bmm"),
                 ("nc", "SELECT greatest(count(*), 2) AS nt FROM combos"),
                 ("sm", "SELECT scheme, count(net) AS n, skewness(net) AS sk, kurtosis(net) AS ku, avg(net) / stddev_samp(net) AS sr, any_value(nt) AS nt FROM te_tm, nc GROUP BY 1"),
                 ("ds", "SELECT scheme, (sr - (sqrt(2 * ln(nt)) - 0.5772156649015329 / sqrt(2 * ln(nt))) / sqrt(n)) * sqrt(12.0) AS dsr FROM sm")]
FULL_MENU_SQL = [(n, b.replace("zz_only", "pickd")) for n, b in FULL_MENU_SQL]
SHOWN = {"ann_ret": ("ann_return_net", "%.2f%%", 100), "sharpe": ("sharpe_net", "%.2f", 1), "maxdd": ("max_drawdown", "%.2f%%", 100), "both_down": ("both_down_annualized", "%.2f%%", 100),
         "up_beta": ("upside_beta", "%.2f", 1), "dn_beta": ("downside_beta", "%.2f", 1), "dn_corr": ("downside_corr_eq", "%.2f", 1), "gross": ("gross_notional_last", "%.2f", 1)}
NAMES_OF = ", ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN '{x}' END" for i, x in enumerate(R.names))


@query("menu_ranked", recursive(FULL_MENU_SQL, f"SELECT scheme, CASE WHEN mask = 0 THEN 'benchmark' ELSE concat_ws(',', {NAMES_OF}) END AS combo, "
                                + ", ".join(f"coalesce(printf('{f}', {c} * {k}), 'n/a') AS {n}" for n, (c, f, k) in SHOWN.items())
                                + f", printf('%.2f%%', greatest(gross_notional_last - 1, 0) * {S.lev_rate} * 100) AS lev_cost, coalesce(printf('%.2f', dsr), 'n/a') AS dsr, "
                                "'n/a' AS sharpe_ci FROM allm LEFT JOIN ds USING (scheme)"))
def menu_ranked(spark, sf_dir):
    """The benchmark and 41 schemes; ``menu_ranked_full`` takes all 50."""
    return full_menu(spark, sf_dir, SEARCH_SCHEMES)


@query("menu_ranked_full")
def menu_ranked_full(spark, sf_dir):
    return full_menu(spark, sf_dir, fx.SCHEMES)


def full_menu(spark, sf_dir, schemes, n_boot: int = 1000) -> DataFrame:
    """Text table by falling Sharpe ratio. The trials of a scheme are its portfolios; an interval needs 24 months."""
    r = fx.brand_returns(spark, sf_dir)
    ctx, test = fx.context(spark, sf_dir, r), fx.window(spark, fx.TEST)
    searched = ranked(spark, sf_dir, schemes, "asymmetric2", r=r, ctx=ctx, also=test)
    best = winners(searched, ["window_id", "scheme"])
    plan = evaluate(r, test, best.select(*TRIAL), R, schemes, S, ctx)
    n_trials = max(searched.select("mask").distinct().count(), 2)
    months = materialize(trial_months(plan))
    weights = bk.fixed_weights(bq.weight_rows(spark, {"All-Weather": fx.STATIC}), r)
    inside = F.col("period").between(*(F.lit(d).cast("date") for d in fx.TEST))
    bench = bk.rebalanced_months(bk.positions(weights, r.where(inside)), S.cost).join(F.broadcast(ctx), "period", "left").select(
        F.lit(0).alias("window_id"), F.col("portfolio").alias("scheme"), F.lit(0).cast("bigint").alias("mask"), "period", "gross", "net", "turnover", F.lit(1.0).alias("notional"),
        *[c for c in ctx.columns if c != "period"])
    rows = trial_metrics(months.select(*bench.columns).unionByName(bench), TRIAL_KEYS)
    dsr = st.deflated_sharpe(months, ["scheme"], F.lit(n_trials)).select("scheme", "deflated_sr_ann")
    ci = st.block_bootstrap(months, ["scheme"], {"sharpe": st.sharpe_stat()}, n_boot=n_boot).where("n >= 24").select("scheme", "sharpe_lo", "sharpe_hi")
    df = rows.join(F.broadcast(dsr), "scheme", "left").join(F.broadcast(ci), "scheme", "left").orderBy(F.desc_nulls_last("sharpe_net"))  # a row per scheme
    shown = [(percent_text if k == 100 else fixed_text)(F.col(c)).alias(n) for n, (c, _, k) in SHOWN.items()]
    return df.select("scheme", F.when(F.col("mask") == 0, "benchmark").otherwise(combo_text(R, F.col("mask"))).alias("combo"), *shown,
                     percent_text(F.greatest(F.col("gross_notional_last") - 1, F.lit(0.0)) * S.lev_rate).alias("lev_cost"), fixed_text(F.col("deflated_sr_ann")).alias("dsr"),
                     F.when(F.col("sharpe_lo").isNotNull(), F.format_string("[%.2f, %.2f]", "sharpe_lo", "sharpe_hi")).otherwise("n/a").alias("sharpe_ci"))


FOLDS = f"""SELECT row_number() OVER (ORDER BY k)::INTEGER AS window_id, DATE '{fx.FULL[0]}' AS start_d, train_end, test_start, test_end,
 (SELECT count(*) FROM rcal0 WHERE period BETWEEN DATE '{fx.FULL[0]}' AND train_end) AS n_train, (SELECT count(*) FROM rcal0 WHERE period BETWEEN test_start AND test_end) AS n_test
 FROM (SELECT k, last_day(DATE '{fx.FULL[0]}' + to_months(35 + 12 * k::INTEGER)) AS train_end, last_day(DATE '{fx.FULL[0]}' + to_months(36 + 12 * k::INTEGER)) AS test_start,
 least(last_day(DATE '{fx.FULL[0]}' + to_months(47 + 12 * k::INTEGER)), DATE '{fx.FULL[1]}') AS test_end FROM (SELECT range AS k FROM range(0, 8)))
 WHERE test_start <= DATE '{fx.FULL[1]}'"""
FOLD_CTES = [("rcal0", "SELECT DISTINCT period FROM ret"), ("folds0", FOLDS), ("folds", "SELECT * FROM folds0 WHERE n_train >= 24 AND n_test >= 6")]


def folds_of(spark, r: DataFrame) -> DataFrame:
    return sl.make_folds(spark, r, *fx.FULL, min_train_years=3, test_years=1, step_years=1)


@query("folds", with_([*BRAND, *FOLD_CTES], "SELECT * FROM folds"))
def folds(spark, sf_dir):
    return folds_of(spark, rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir))))


def hold_ctes(fold_ctes, mode: str, schemes, also=None) -> list:
    n = len(BRAND)
    train = [*CONTEXT, *fold_ctes,
             *ts.trial_ctes((), R, schemes, S, win=("win", "SELECT window_id, start_d, train_end AS end_d FROM folds"), also=also),
             *ts.metric_ctes(), *ts.div_ctes(schemes), *ts.score_ctes(mode, "metd"),
             ("pickd", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY rank, mask, scheme) AS k FROM sco) WHERE k = 1")]
    test = rename([*ts.trial_ctes((), R, schemes, S, win=("win", "SELECT window_id, test_start AS start_d, test_end AS end_d FROM folds"), only="zz_only"), *ts.metric_ctes()], "te_")
    return [*train, *[(a, b.replace("zz_only", "pickd")) for a, b in test]]


HOLD_COLUMNS = ["train_score", "train_sharpe", "test_sharpe", "test_both_down_ann", "test_maxdd"]
HOLD = ("hold", "SELECT p.window_id, p.scheme, p.mask, p.n_sleeves::INTEGER AS n_sleeves, p.resilience_score AS train_score, p.sharpe_net AS train_sharpe, t.n_months AS test_months, "
        "t.sharpe_net AS test_sharpe, t.both_down_annualized AS test_both_down_ann, t.max_drawdown AS test_maxdd FROM pickd p JOIN te_met t USING (window_id, scheme, mask)")
HOLD_SQL = "SELECT " + ts.pick(HOLD_COLUMNS, ["window_id", "scheme", "mask", "n_sleeves", "test_months"]) + " FROM hold"


def walk(spark, sf_dir, rolling: bool, schemes=None):
    r = fx.brand_returns(spark, sf_dir)
    ctx = fx.context(spark, sf_dir, r)
    folds_ = sl.rolling_windows(r, *fx.TEST, trailing_years=3) if rolling else folds_of(spark, r)
    schemes, mode = (schemes or EWS, "asymmetric2") if rolling else (schemes or COV3, "seasons")
    also = None if rolling else fx.window(spark, fx.FULL)
    return (*sl.select_and_hold(r, folds_, R, schemes, S, ctx, mode, also), schemes)


def hold_report(spark, sf_dir, rolling: bool, schemes=None) -> DataFrame:
    chosen, months, _, _ = walk(spark, sf_dir, rolling, schemes)
    return sl.hold_log(chosen, months).select("window_id", "scheme", "mask", "n_sleeves", "test_months", *HOLD_COLUMNS)


WALK = hold_ctes(FOLD_CTES, "seasons", COV3, fx.FULL)


@query("walk_forward", recursive([*WALK, HOLD], HOLD_SQL), digits=6)
def walk_forward(spark, sf_dir):
    return hold_report(spark, sf_dir, False)


@query("oos_concat", recursive(WALK, "SELECT window_id, period, " + ts.pick(["gross", "net", "turnover"], digits=7) + " FROM te_tm"), digits=7)
def oos_concat(spark, sf_dir):
    return walk(spark, sf_dir, False)[1].select("window_id", "period", "gross", "net", "turnover").orderBy("period")


ROLL = [("rcal0", "SELECT DISTINCT period FROM ret"),
        ("yrs", f"SELECT year(period) AS y, max(period) AS test_end FROM rcal0 WHERE period BETWEEN DATE '{fx.TEST[0]}' AND DATE '{fx.TEST[1]}' GROUP BY 1"),
        ("fst", "SELECT year(period) AS y, min(period) AS test_start FROM rcal0 GROUP BY 1"),
        ("folds", "SELECT y::INTEGER AS window_id, CAST(test_start - to_years(3) AS DATE) AS start_d, last_day(test_start - to_months(1)) AS train_end, test_start, test_end FROM yrs JOIN fst USING (y)")]


@query("rolling_select", recursive([*hold_ctes(ROLL, "asymmetric2", EWS), HOLD], HOLD_SQL), digits=6)
def rolling_select(spark, sf_dir):
    return hold_report(spark, sf_dir, True)


# The same reports over whole scheme sets. Equal risk and minimum variance have no SQL form: certificates judge their weights, tests their selection.
FIVE = [fx.BY_NAME[x] for x in ("EW", "InvVol", "InvVar", "ERC", "MinVar")]


@query("walk_forward_five", digits=6)
def walk_forward_five(spark, sf_dir):
    return hold_report(spark, sf_dir, False, FIVE)


@query("rolling_select_full", digits=6)
def rolling_select_full(spark, sf_dir):
    return hold_report(spark, sf_dir, True, fx.SCHEMES)


@query("best_per_family_full", digits=6)
def best_per_family_full(spark, sf_dir):
    return winners(ranked(spark, sf_dir, fx.SCHEMES, "asymmetric2"), ["window_id", "scheme"]).select("scheme", "mask", "rank", *TOP_COLUMNS)


@query("test_eval_full", digits=6)
def test_eval_full(spark, sf_dir):
    return evaluation(spark, sf_dir, fx.SCHEMES)[1].select("scheme", "mask", "train_rank", "test_rank", *EV_COLUMNS)


@query("overfit_diag_full", digits=6)
def overfit_diag_full(spark, sf_dir):
    train, ev = evaluation(spark, sf_dir, fx.SCHEMES)
    return st.overfit_diagnostics(train, materialize(ev))


@query("avg_fold_weights", recursive(
    [*WALK, ("lastw", "SELECT p.window_id, b.i, b.b FROM pickd p JOIN bw b ON b.window_id = p.window_id AND b.mask = p.mask AND b.base = CASE p.scheme WHEN 'EW' THEN 'ew' WHEN 'InvVol' THEN 'invvol' ELSE 'invvar' END "
              "WHERE b.refit_no = (SELECT max(refit_no) FROM rf WHERE rf.window_id = p.window_id)")],
    f"SELECT entity AS sleeve, count(*) AS n_folds, {q('avg(b)')} AS avg_weight FROM lastw JOIN ros USING (i) GROUP BY 1"))
def avg_fold_weights(spark, sf_dir):
    """Mean weight of each series over the folds whose winner holds it (last refit of the training window)."""
    r = fx.brand_returns(spark, sf_dir)
    ctx = fx.context(spark, sf_dir, r)
    folds_ = materialize(folds_of(spark, r))
    chosen = materialize(winners(search(r, sl.train_windows(folds_), R, COV3, S, ctx, "seasons", also=fx.window(spark, fx.FULL))))
    plan = evaluate(r, sl.train_windows(folds_), chosen.select(*TRIAL), R, COV3, S, ctx)
    weights = sl.last_weights(plan, chosen, COV3)
    return weights.groupBy("sleeve").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("w").alias("avg_weight"))


ALT = Roster(tuple(f"Brand#{i}" for i in range(13, 20)), ("Brand#13", "Brand#14", "Brand#15"), ("Brand#16", "Brand#17", "Brand#18"),
             inflation_proxies=R.inflation_proxies, equity_proxies=R.equity_proxies)
ALT_SETTINGS = dataclasses.replace(S, min_sleeves=5, max_sleeves=7)


@query("search_alt", recursive([*CONTEXT, *ts.trial_ctes((fx.FULL,), ALT, COV3, ALT_SETTINGS), *ts.metric_ctes(), *ts.div_ctes(COV3), *ts.score_ctes("default", "metd")],
                               "SELECT " + ts.pick(TOP_COLUMNS, ["scheme", "mask", "rank"]) + " FROM sco"), digits=6)
def search_alt(spark, sf_dir):
    """The same search over another universe and window: 29 portfolios of seven series."""
    r = fx.brand_returns(spark, sf_dir)
    df = search(r, fx.window(spark, fx.FULL), ALT, COV3, ALT_SETTINGS, fx.context(spark, sf_dir, r), "default")
    return df.select("scheme", "mask", "rank", *TOP_COLUMNS)


@query("search_full", digits=6)
def search_full(spark, sf_dir):
    """The whole grid: every allowed portfolio under all 50 schemes on the training window."""
    df = ranked(spark, sf_dir, fx.SCHEMES, "asymmetric2")
    return df.select("scheme", "mask", "rank", *TOP_COLUMNS)


V1 = dataclasses.replace(S, cap=0.0, cost_bps=0.0, lev_rate=0.0, shrink="none", erc_cap_mode="none", min_sleeves=2, max_sleeves=8,
                         history_inside_window=True)


@query("bt_erc_v1", digits=6)
def bt_erc_v1(spark, sf_dir):
    """In-sample equal-risk search: sample covariance of the window's own past, equal weight until 12 months exist."""
    r = fx.brand_returns(spark, sf_dir)
    df = search(r, fx.window(spark, fx.FULL), R, [fx.BY_NAME["ERC"]], V1, fx.context(spark, sf_dir, r), "v1")
    return df.select("mask", "n_sleeves", "rank", *TOP_COLUMNS)


#: The months x months matrix of all trials and 400 power steps on it: the long way round to the same two numbers.
SPECTRUM = [*BRAND, *ts.trial_ctes((fx.TRAIN,), R, SEARCH_SCHEMES, S),
            ("dm", "SELECT window_id, scheme, mask, period, net - avg(net) OVER (PARTITION BY window_id, scheme, mask) AS d, "
             "dense_rank() OVER (PARTITION BY window_id ORDER BY period) AS t FROM tm"),
            ("gm", "SELECT a.window_id, a.t AS i, b.t AS j, sum(a.d * b.d) AS g FROM dm a JOIN dm b USING (window_id, scheme, mask) GROUP BY 1, 2, 3"),
            ("gl", "SELECT window_id, list(r ORDER BY i) AS g, list(start ORDER BY i) AS v0, sum(dg) AS trace FROM (SELECT window_id, i, list(g ORDER BY j) AS r, cos(1.0 + i) AS start, "
             "sum(g) FILTER (i = j) AS dg FROM gm GROUP BY 1, 2) GROUP BY 1"),
            ("pw", "SELECT window_id, 0 AS step, g, trace, v0 AS v FROM gl UNION ALL SELECT window_id, step + 1, g, trace, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) "
             "FROM (SELECT *, list_transform(g, lambda r: list_dot_product(r, v)) AS u FROM pw WHERE step < 400)")]


@query("effective_n", recursive(SPECTRUM, f"SELECT window_id, {q('trace / list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v)))')} AS effective_n, "
                                          "(SELECT count(DISTINCT (scheme, mask)) FROM tm) AS n_trials FROM pw WHERE step = 400"))
def effective_n(spark, sf_dir):
    """Over the 41 schemes that SQL can follow; ``effective_n_full`` takes all 50."""
    return effective(spark, sf_dir, SEARCH_SCHEMES)


@query("effective_n_full")
def effective_n_full(spark, sf_dir):
    return effective(spark, sf_dir, fx.SCHEMES)


def effective(spark, sf_dir, schemes) -> DataFrame:
    plan = plan_trials(fx.brand_returns(spark, sf_dir), fx.window(spark, fx.TRAIN), R, schemes, S)
    return st.effective_trials(trial_months(plan), TRIAL_KEYS)


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TYPE_ROSTER = Roster(TYPES, TYPES[:2], TYPES[2:4])
TYPE_SETTINGS = dataclasses.replace(S, min_sleeves=2, max_sleeves=6)
FLAG_COLUMNS = ["ann_return_net", "ann_vol", "sharpe_net", "max_drawdown", "ann_turnover"]


@query("flagship", recursive(
    [*[(n, b.replace("p_brand", "p_type")) for n, b in BRAND], ("ctx", "SELECT DISTINCT period, NULL::DOUBLE AS eq_ref, NULL::DOUBLE AS bd_ref, false AS both_down, '' AS season FROM ret"),
     *ts.trial_ctes((fx.FULL,), TYPE_ROSTER, [fx.BY_NAME["EW"]], TYPE_SETTINGS), *ts.metric_ctes()],
    "SELECT " + ts.pick(FLAG_COLUMNS, ["mask", "n_sleeves", "n_months"], 8) + " FROM met"))
def flagship(spark, sf_dir):
    """One row per portfolio of the type panel: equal weight, net of costs."""
    r = materialize(rt.non_null(rt.simple_returns(panels.type_month(spark, sf_dir))))
    plan = plan_trials(r, fx.window(spark, fx.FULL), TYPE_ROSTER, [fx.BY_NAME["EW"]], TYPE_SETTINGS)
    return plan_metrics(plan).select("mask", "n_sleeves", "n_months", *FLAG_COLUMNS)
