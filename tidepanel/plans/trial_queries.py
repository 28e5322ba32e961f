"""Portfolios, covariances, weights and backtests over the brand panel."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.operators import certificates as ct
from tidepanel.operators import covariance as cv
from tidepanel.operators import metrics as mt
from tidepanel.operators import returns as rt
from tidepanel.operators import weights as wt
from tidepanel.operators.search import diversification, plan_metrics, search
from tidepanel.operators.solvers import solver_weights
from tidepanel.operators.trials import TRIAL_KEYS, plan_trials, trial_months
from tidepanel.operators.universe import Roster, availability, combo_text, portfolio_space, window_days, window_months
from tidepanel.plans import fixtures as fx
from tidepanel.plans import trial_sql as ts
from tidepanel.plans.oracle import levels, q, recursive, returns, with_
from tidepanel.plans.registry import query
from tidepanel.plans.regime_queries import CONTEXT
from tidepanel.plans.signal_queries import BRAND
from tidepanel.session import materialize
from tidepanel.sources import panels

R, S = fx.ROSTER, fx.SETTINGS
SPANS = (fx.TRAIN, fx.TEST)


#: Portfolios of the train and the test window, from the series that are complete in each.
COMBOS = [*BRAND, ts.roster_cte(R), *ts.months_ctes(ts.windows_cte(SPANS)), *ts.availability_ctes(False), *ts.combos_ctes(R, 5, 8)]


def _ordered_names() -> str:
    return ", ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN '{x}' END" for i, x in enumerate(R.names))


def space(spark, sf_dir, roster=R, lo: int = 5, hi: int = 8, spans=SPANS) -> DataFrame:
    r = fx.brand_returns(spark, sf_dir)
    return portfolio_space(spark, roster, lo, hi, availability(r, windows_of(spark, r, *spans), roster))


@query("combos", with_(COMBOS, "SELECT window_id, mask, n_sleeves::INTEGER AS n_sleeves FROM combos"))
def combos(spark, sf_dir):
    return space(spark, sf_dir)


#: All 25 brands: subsets of 2 to 5 grow series by series in the SQL, never a filter over 2^25 masks.
WIDE = Roster(tuple(f"Brand#{i}" for i in range(1, 26)), tuple(f"Brand#{i}" for i in range(1, 7)), tuple(f"Brand#{i}" for i in range(7, 12)))
WIDE_SQL = [*BRAND, ts.roster_cte(WIDE), *ts.months_ctes(ts.windows_cte(SPANS)), *ts.availability_ctes(False),
            ("grow", "SELECT window_id, i AS last, 1 << i AS mask, 1 AS n, is_eq AS eq, is_bd AS bd FROM ok JOIN ros USING (entity) UNION ALL "
             "SELECT g.window_id, r.i, g.mask | (1 << r.i), n + 1, eq OR is_eq, bd OR is_bd FROM grow g JOIN ok USING (window_id) JOIN ros r ON r.entity = ok.entity AND r.i > g.last WHERE n < 5")]


@query("combos_wide", recursive(WIDE_SQL, "SELECT window_id, n::INTEGER AS n_sleeves, (mask % 97)::BIGINT AS part, count(*) AS n_portfolios, sum(mask)::BIGINT AS mask_sum FROM grow WHERE n >= 2 AND eq AND bd GROUP BY 1, 2, 3"))
def combos_wide(spark, sf_dir):
    """Portfolios of two to five of all 25 brands, counted by size and by their mask modulo 97."""
    return space(spark, sf_dir, WIDE, 2, 5).groupBy("window_id", "n_sleeves", (F.col("mask") % 97).alias("part")).agg(
        F.count(F.lit(1)).alias("n_portfolios"), F.sum("mask").alias("mask_sum"))


@query("combo_str", with_(COMBOS, f"SELECT window_id, mask, concat_ws(',', {_ordered_names()}) AS combo, n_sleeves::INTEGER AS n_parts FROM combos"))
def combo_str(spark, sf_dir):
    df = combos(spark, sf_dir).select("window_id", "mask", combo_text(R, F.col("mask")).alias("combo"))
    return df.withColumn("n_parts", F.size(F.split("combo", ",")))


SCHEME_ROWS = ", ".join(f"('{s.name}')" for s in fx.SCHEMES)


@query("trial_space", with_([*COMBOS, ("sch", f"SELECT * FROM (VALUES {SCHEME_ROWS}) v(scheme)")], "SELECT window_id, mask, scheme FROM combos, sch"))
def trial_space(spark, sf_dir):
    names = F.array(*[F.lit(s.name) for s in fx.SCHEMES])
    return combos(spark, sf_dir).select("window_id", "mask", F.explode(names).alias("scheme"))


def windows_of(spark, returns_: DataFrame, *spans) -> DataFrame:
    return materialize(window_months(returns_, fx.window(spark, *spans)))


def cov_sql(spans, trailing: int, mode: str, select: str) -> str:
    return with_([*BRAND, ts.roster_cte(R), *ts.months_ctes(ts.windows_cte(spans)), *ts.availability_ctes(False), *ts.covariance_ctes(trailing, mode)], select)


ENTRIES = ("SELECT window_id, refit_no::INTEGER AS refit_no, a.entity AS i, b.entity AS j, {c} AS c FROM cv JOIN ros a ON a.i = cv.i JOIN ros b ON b.i = cv.j WHERE cv.i <= cv.j")


@query("cov_pairs", with_(
    [*BRAND, ts.roster_cte(R), ("x", "SELECT period, i, entity, ret FROM ret JOIN ros USING (entity)")],
    f"SELECT a.entity AS i, b.entity AS j, {q('covar_samp(a.ret, b.ret)', 10)} AS c FROM x a JOIN x b USING (period) WHERE a.i <= b.i GROUP BY 1, 2"), digits=10)
def cov_pairs(spark, sf_dir):
    r = rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir)))
    wide = cv.wide_returns(r.where(F.col("entity").isin(list(R.names))), R)
    cells = wide.agg(*[F.covar_samp(f"r_{i}", f"r_{j}").alias(cv.pair(i, j)) for i in range(R.n) for j in range(i, R.n)])
    rows = F.array(*[F.struct(F.lit(R.names[i]).alias("i"), F.lit(R.names[j]).alias("j"), F.col(cv.pair(i, j)).alias("c"))
                     for i in range(R.n) for j in range(i, R.n)])
    return cells.select(F.explode(rows).alias("e")).select("e.*")


def covariances(spark, sf_dir, mode: str, spans=SPANS):
    r = fx.brand_returns(spark, sf_dir)
    months = windows_of(spark, r, *spans)
    return r, months, materialize(cv.refit_covariance(r, months, R, S.trailing, mode, available=availability(r, months, R)))


@query("cov_trailing", cov_sql(SPANS, 36, "none", ENTRIES.format(c=q("c", 10))), digits=10)
def cov_trailing(spark, sf_dir):
    return cv.long_entries(covariances(spark, sf_dir, "none")[2], R)


@query("cov_shrunk", cov_sql(SPANS, 36, "lw", ENTRIES.format(c=q("c", 10))), digits=10)
def cov_shrunk(spark, sf_dir):
    return cv.long_entries(covariances(spark, sf_dir, "lw")[2], R)


@query("refit_cov", cov_sql((fx.FULL,), 36, "lw", f"SELECT window_id, refit_no::INTEGER AS refit_no, any_value(t) AS n_rows, {q('any_value(delta)')} AS delta, "
                            f"{q('avg(v)')} AS mean_vol FROM cv JOIN vol USING (window_id, refit_no, i) WHERE cv.i = cv.j GROUP BY 1, 2"))
def refit_cov(spark, sf_dir):
    cov = covariances(spark, sf_dir, "lw", (fx.FULL,))[2]
    mean = F.aggregate("vol", F.lit(0.0), lambda a, v: a + v) / R.n
    return cov.select("window_id", "refit_no", "n_rows", "delta", mean.alias("mean_vol"))


def often(refit: str, select: str) -> str:
    """SQL of covariances with a refit as often as ``refit`` (an expression over the period) changes."""
    return select.replace("PARTITION BY window_id ORDER BY year(period)", f"PARTITION BY window_id ORDER BY {refit}")


@query("cov_monthly", often("last_day(period)", cov_sql((fx.TRAIN,), 36, "lw", ENTRIES.format(c=q("c", 10)))), digits=10)
def cov_monthly(spark, sf_dir):
    """A refit every month: 23 overlapping histories of 36 months."""
    r = fx.brand_returns(spark, sf_dir)
    months = materialize(window_months(r, fx.window(spark, fx.TRAIN), "M"))
    return cv.long_entries(cv.refit_covariance(r, months, R, S.trailing, "lw", available=availability(r, months, R)), R)


EVENTS = Roster(("click", "error", "purchase", "signup", "view"), ("click",), ("error",))
EVENT_SPAN = ("2024-01-14", "2024-01-30")


@query("cov_daily", often("period", with_([*returns("event_day"), ts.roster_cte(EVENTS), *ts.months_ctes(ts.windows_cte((EVENT_SPAN,))), *ts.availability_ctes(False),
                                           *ts.covariance_ctes(14, "lw")], ENTRIES.format(c=q("c", 10)))), digits=10)
def cov_daily(spark, sf_dir):
    """A refit every day over a daily calendar, each with the 14 days before it."""
    r = materialize(rt.non_null(rt.simple_returns(panels.event_day(spark, sf_dir))))
    days = materialize(window_days(r, fx.window(spark, EVENT_SPAN)))
    return cv.long_entries(cv.refit_covariance(r, days, EVENTS, 14, "lw", available=availability(r, days, EVENTS)), EVENTS)


def trial_combos(spark, returns_, months, partitions: int = 8) -> DataFrame:
    """Portfolios of every window, laid out by (window, mask)."""
    return portfolio_space(spark, R, S.min_sleeves, S.max_sleeves, availability(returns_, months, R)).repartition(partitions, "window_id", "mask")


def long_weights(weights: DataFrame, keys: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(x).alias("sleeve"), F.col(f"b_{i}").alias("w"), F.lit(1 << i).alias("bit"))
                      for i, x in enumerate(R.names)])
    member = F.filter(cells, lambda c: F.col("mask").bitwiseAND(c["bit"]) != 0)
    return weights.select(*keys, F.explode(member).alias("e")).select(*keys, "e.sleeve", "e.w")


WEIGHT_BASE = [*BRAND, ts.roster_cte(R), *ts.months_ctes(ts.windows_cte(SPANS)), *ts.availability_ctes(False),
               *ts.combos_ctes(R, S.min_sleeves, S.max_sleeves), *ts.covariance_ctes(S.trailing)]


@query("w_ew", with_(COMBOS, f"SELECT window_id, mask, entity AS sleeve, {q('1.0 / n_sleeves')} AS w FROM mem"))
def w_ew(spark, sf_dir):
    return long_weights(wt.equal_weight(combos(spark, sf_dir), R), ["window_id", "mask"])


def inverse(base: str, power: int):
    # capped rows exist only where a refit has a covariance
    sql = with_([*WEIGHT_BASE, *ts.weights_ctes([base], S.cap)],
                f"SELECT window_id, mask, refit_no::INTEGER AS refit_no, entity AS sleeve, {q('w')} AS w FROM cap_{base} JOIN ros USING (i)")

    @query(f"w_{base}", sql)
    def run(spark, sf_dir):
        r, months, cov = covariances(spark, sf_dir, "lw")
        out = wt.inverse_risk(trial_combos(spark, r, months), cov, R, power, S.cap, base)
        return long_weights(out, ["window_id", "mask", "refit_no"])
    return run


w_invvol, w_invvar = inverse("invvol", 1), inverse("invvar", 2)


@query("w_capped", with_(
    [*levels("priority"), ("src", "SELECT period, entity AS sleeve, level * level AS w0 FROM lv"), *ts.capped_ctes("src", "period", 0.25, "cp", "sleeve")],
    f"SELECT period, sleeve, {q('w')} AS w FROM cp"))
def w_capped(spark, sf_dir):
    raw = panels.priority_month(spark, sf_dir).select("period", F.col("entity").alias("sleeve"), (F.col("level") * F.col("level")).alias("raw"))
    return wt.cap_and_redistribute(raw, ["period"], "raw", 0.25, "w").select("period", "sleeve", "w")


@query("proj_simplex", with_(
    [*BRAND, ("s", "SELECT period, entity, ret * 4 AS v, row_number() OVER w AS k, sum(ret * 4) OVER w AS c FROM ret WINDOW w AS (PARTITION BY period ORDER BY ret DESC, entity)"),
     ("th", "SELECT period, arg_max((c - 1) / k, k) FILTER (v - (c - 1) / k > 0) AS tau FROM s GROUP BY 1")],
    f"SELECT period, entity AS sleeve, {q('greatest(v - tau, 0)')} AS w FROM s JOIN th USING (period)"))
def proj_simplex(spark, sf_dir):
    r = rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir)))
    v = r.select("period", F.col("entity").alias("sleeve"), (F.col("ret") * 4).alias("v"))
    return wt.project_to_simplex(v, ["period"], "v", "w").select("period", "sleeve", "w")


def solved(spark, sf_dir, kinds, mode: str = "capped", cap: float = S.cap) -> tuple[DataFrame, DataFrame]:
    r, months, cov = covariances(spark, sf_dir, "lw")
    problems = trial_combos(spark, r, months)
    return solver_weights(problems, cov, R, kinds, cap, mode), cov


KEYS = ["window_id", "mask", "refit_no", "base"]


@query("w_erc")
def w_erc(spark, sf_dir):
    return long_weights(solved(spark, sf_dir, ["erc"], "none", 0.0)[0], KEYS)


@query("w_erc_capped")
def w_erc_capped(spark, sf_dir):
    return long_weights(solved(spark, sf_dir, ["erc"])[0], KEYS)


@query("w_minvar")
def w_minvar(spark, sf_dir):
    return long_weights(solved(spark, sf_dir, ["minvar"])[0], KEYS)


@query("solve_weights")
def solve_weights(spark, sf_dir):
    return solved(spark, sf_dir, ["erc", "minvar"])[0]


GROUPS = "SELECT base, combos.window_id, mask, rf.refit_no FROM combos JOIN rf USING (window_id), (VALUES ('erc'), ('minvar')) v(base)"


@query("w_constraints", with_([*WEIGHT_BASE, ("g", GROUPS)], "SELECT base, count(*) AS n, count(*) AS n_sum_one, count(*) AS n_cap_ok, count(*) AS n_non_negative FROM g GROUP BY 1"))
def w_constraints(spark, sf_dir):
    """Solver weights that sum to one, respect the cap and are not negative: the SQL expects all of them."""
    weights = solved(spark, sf_dir, ["erc", "minvar"])[0]
    cells = [F.col(c) for c in wt.weight_columns(R)]
    total = sum(cells[1:], cells[0])
    return weights.groupBy("base").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_one"),
        F.count_if(F.greatest(*cells) <= S.cap + 1e-6).alias("n_cap_ok"), F.count_if(F.least(*cells) >= 0).alias("n_non_negative"))


@query("erc_self_check", with_([*WEIGHT_BASE], "SELECT window_id, mask, rf.refit_no::INTEGER AS refit_no, 0.0::DOUBLE AS max_gap FROM combos JOIN rf USING (window_id)"), digits=6)
def erc_self_check(spark, sf_dir):
    """Largest distance of a relative risk contribution from 1/n, for every equal-risk portfolio: 0 to six places."""
    weights, cov = solved(spark, sf_dir, ["erc"], "none", 0.0)
    contrib = risk_contributions(weights, cov)
    return contrib.groupBy("window_id", "mask", "refit_no").agg(
        F.max(F.abs(F.col("share") - F.lit(1.0) / F.col("n_sleeves"))).alias("max_gap"))


#: Largest gap that counts as solved, per certificate.
BOUNDS = {"cert_minvar": 1e-5, "cert_erc": 1e-7, "cert_erc_capped": 1e-7}
LISTED = [*WEIGHT_BASE, ("lst", "SELECT combos.window_id, mask, rf.refit_no::INTEGER AS refit_no, true AS solved FROM combos JOIN rf USING (window_id)")]


def certificate(name: str, gap) -> None:
    @query(name, with_(LISTED, "SELECT * FROM lst"))
    def run(spark, sf_dir):
        return gap(spark, sf_dir).select("window_id", "mask", "refit_no", (F.col("gap") <= BOUNDS[name]).alias("solved"))


# The SQL lists every portfolio and refit as solved: none may be missing, none above its bound.
certificate("cert_minvar", lambda spark, sf_dir: ct.minimum_variance_gap(*solved(spark, sf_dir, ["minvar"]), R, S.cap))
certificate("cert_erc", lambda spark, sf_dir: ct.equal_risk_gap(*solved(spark, sf_dir, ["erc"], "none", 0.0), R))
certificate("cert_erc_capped", lambda spark, sf_dir: ct.capped_risk_gap(*solved(spark, sf_dir, ["erc"]), R, S.cap))


def root_volatility(cov, vol, cap, mode):
    """A caller's scheme: weights fall with the root of the volatility."""
    return vol ** -0.5


@query("w_own_scheme", with_(
    [*WEIGHT_BASE, ("raw_own", "SELECT m.window_id, mask, refit_no, m.i, 1.0 / sqrt(v) AS w0 FROM mem m JOIN vol ON vol.window_id = m.window_id AND vol.i = m.i"),
     *ts.capped_ctes("raw_own", "window_id, mask, refit_no", S.cap, "cap_own")],
    f"SELECT window_id, mask, refit_no::INTEGER AS refit_no, 'root-vol' AS base, entity AS sleeve, {q('w')} AS w FROM cap_own JOIN ros USING (i)"))
def w_own_scheme(spark, sf_dir):
    """A scheme that the library does not know, given as a function."""
    r, months, cov = covariances(spark, sf_dir, "lw")
    return long_weights(solver_weights(trial_combos(spark, r, months), cov, R, [], S.cap, own={"root-vol": root_volatility}), KEYS)


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Share of the variance per member, w·(Sw) / w'Sw."""
    n = R.n
    rows = (long_weights(weights, ["window_id", "mask", "n_sleeves", "refit_no"])
            .withColumn("i", F.element_at(F.create_map(*[x for i, s in enumerate(R.names) for x in (F.lit(s), F.lit(i))]), F.col("sleeve"))))
    book = weights.select("window_id", "mask", "refit_no", F.array(*wt.weight_columns(R)).alias("b"))
    df = rows.join(book, ["window_id", "mask", "refit_no"]).join(F.broadcast(cov.select("window_id", "refit_no", "cov")), ["window_id", "refit_no"])
    sw = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, j: a + F.get("b", j) * F.get("cov", F.col("i") * n + j))
    df = df.withColumn("rc", F.col("w") * sw)
    total = F.sum("rc").over(Window.partitionBy("window_id", "mask", "refit_no"))
    return df.select("window_id", "mask", "n_sleeves", "refit_no", "sleeve", (F.col("rc") / total).alias("share"))


@query("risk_contrib", with_(
    [*WEIGHT_BASE, *ts.weights_ctes(["invvol"], S.cap),
     ("rc", "SELECT x.window_id, x.mask, x.refit_no, x.i, x.b * sum(y.b * c.c) AS rc FROM bw x JOIN bw y USING (window_id, mask, refit_no) "
      "JOIN cv c ON c.window_id = x.window_id AND c.refit_no = x.refit_no AND c.i = x.i AND c.j = y.i GROUP BY x.window_id, x.mask, x.refit_no, x.i, x.b")],
    f"SELECT window_id, mask, refit_no::INTEGER AS refit_no, entity AS sleeve, {q('rc / sum(rc) OVER (PARTITION BY window_id, mask, refit_no)')} AS share FROM rc JOIN ros USING (i)"))
def risk_contrib(spark, sf_dir):
    r, months, cov = covariances(spark, sf_dir, "lw")
    weights = materialize(wt.inverse_risk(trial_combos(spark, r, months), cov, R, 1, S.cap, "invvol"))
    return risk_contributions(weights, cov).drop("n_sleeves")


COV3 = [fx.BY_NAME[x] for x in ("EW", "InvVol", "InvVar")]


@query("div_ratio", with_([*CONTEXT, *ts.trial_ctes(SPANS, R, COV3, S), ("met", "SELECT DISTINCT window_id, scheme, mask FROM tm"), *ts.div_ctes(COV3)],
                          f"SELECT window_id, scheme, mask, {q('div_ratio')} AS div_ratio FROM dr"))
def div_ratio(spark, sf_dir):
    r = fx.brand_returns(spark, sf_dir)
    plan = plan_trials(r, fx.window(spark, *SPANS), R, COV3, S)
    return diversification(plan, plan.combos, COV3, plan.weights)


def series_sql(spans, schemes) -> str:
    return recursive([*CONTEXT, *ts.trial_ctes(spans, R, schemes, S)],
                     "SELECT window_id, scheme, mask, period, " + ts.pick(["gross", "net", "turnover"], digits=8) + " FROM tm")


def months_of(spark, sf_dir, spans, schemes) -> DataFrame:
    plan = plan_trials(fx.brand_returns(spark, sf_dir), fx.window(spark, *spans), R, schemes, S)
    return trial_months(plan).select(*TRIAL_KEYS, "period", "gross", "net", "turnover")


for _name, _scheme in (("bt_ew", "EW"), ("bt_invvol", "InvVol"), ("bt_invvar", "InvVar"), ("bt_ls_tsmom", "LS-TSMOM")):
    query(_name, series_sql((fx.TRAIN,), [fx.BY_NAME[_scheme]]))(
        lambda spark, sf_dir, s=_scheme: months_of(spark, sf_dir, (fx.TRAIN,), [fx.BY_NAME[s]]))

for _name, _schemes in (("bt_minvar", ["MinVar"]), ("bt_erc", ["ERC"]),
                        ("bt_flavor_minvar_base", [s.name for s in fx.SCHEMES if s.flavor and s.base == "minvar"])):
    query(_name)(lambda spark, sf_dir, s=tuple(_schemes): months_of(spark, sf_dir, (fx.TRAIN,), [fx.BY_NAME[x] for x in s]))


FAMILIES = {
    "short": [s for s in fx.EW_SCHEMES if s.gate_mode == "short"],
    "hedge": [s for s in fx.EW_SCHEMES if s.gate_mode == "overlay" and s.gate_signal != "infl_regime"],
    "infl": [s for s in fx.EW_SCHEMES if s.gate_signal == "infl_regime"],
    "scale": [s for s in fx.EW_SCHEMES if s.scale_signal],
    # The same rules as the minimum-variance overlays, on the equal-weight base that SQL can follow.
    "trend": [dataclasses.replace(s, base="ew") for s in fx.SCHEMES if s.flavor and s.base == "minvar"],
}
TOTALS = {"gross": "sum(gross)", "net": "sum(net)", "turnover": "sum(turnover)", "notional": "max(notional)"}

for _family, _schemes in FAMILIES.items():
    _sql = recursive([*CONTEXT, *ts.trial_ctes(SPANS, R, _schemes, S)],
                     "SELECT window_id, scheme, mask, count(*) AS n_months, " + ", ".join(f"{q(v)} AS {k}" for k, v in TOTALS.items()) + " FROM tm GROUP BY 1, 2, 3")

    @query(f"bt_flavor_{_family}", _sql)
    def _run(spark, sf_dir, schemes=tuple(_schemes)):
        plan = plan_trials(fx.brand_returns(spark, sf_dir), fx.window(spark, *SPANS), R, schemes, S)
        out = None
        for branch in plan.branches:
            part = branch.groupBy(*TRIAL_KEYS).agg(
                F.count(F.lit(1)).alias("n_months"), F.sum("gross").alias("gross"), F.sum("net").alias("net"),
                F.sum("turnover").alias("turnover"), F.max("notional").alias("notional"))
            out = part if out is None else out.unionByName(part)
        return out


METRICS = ["ann_return_net", "ann_vol", "sharpe_net", "max_drawdown", "both_down_annualized", "upside_beta", "downside_beta",
           "downside_corr_eq", "gross_notional_last", "resilience_score"]
SEARCH_SCHEMES = [*[s for s in fx.EW_SCHEMES], *[fx.BY_NAME[x] for x in ("InvVol", "InvVar")]]


@query("search", recursive(ts.search_ctes((fx.TRAIN,), SEARCH_SCHEMES, "asymmetric2"),
                           "SELECT " + ts.pick(METRICS, ["scheme", "mask", "n_sleeves", "rank"]) + " FROM sco"), digits=6)
def run_search(spark, sf_dir):
    r = fx.brand_returns(spark, sf_dir)
    out = search(r, fx.window(spark, fx.TRAIN), R, SEARCH_SCHEMES, S, fx.context(spark, sf_dir, r), "asymmetric2")
    return out.select("scheme", "mask", "n_sleeves", "rank", *METRICS)
