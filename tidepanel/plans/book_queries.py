"""Given portfolios: static mixes, momentum overlays, candidates, blends and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.scalar import ERF_A, ERF_P, safe_div
from tidepanel.operators import books as bk
from tidepanel.operators import metrics as mt
from tidepanel.operators import returns as rt
from tidepanel.operators import signals as sg
from tidepanel.operators import stats as st
from tidepanel.operators import weights as wt
from tidepanel.operators.covariance import long_entries, pair, wide_returns
from tidepanel.operators.solvers import solver_weights
from tidepanel.operators.universe import Roster, availability, combination_count, window_months
from tidepanel.plans import fixtures as fx
from tidepanel.plans import trial_sql as ts
from tidepanel.plans.oracle import q, recursive, with_
from tidepanel.plans.registry import query
from tidepanel.plans.regime_queries import CONTEXT, inside
from tidepanel.plans.signal_queries import BRAND
from tidepanel.session import materialize

# Candidate mixes over the six-series vintage set.
VINTAGE = Roster(("Brand#1", "Brand#2", "Brand#5", "Brand#6", "Brand#9", "Brand#3"),
                 ("Brand#1", "Brand#2", "Brand#3"), ("Brand#5", "Brand#6"))
CLASSIC = {"Brand#1": 0.30, "Brand#5": 0.55, "Brand#9": 0.15}
SPREAD = {"Brand#1": 0.22, "Brand#2": 0.13, "Brand#5": 0.30, "Brand#6": 0.10, "Brand#9": 0.10, "Brand#3": 0.15}
EQUAL = {name: 1.0 / fx.ROSTER.n for name in fx.ROSTER.names}
BOOKS = {"static": fx.STATIC, "equal": EQUAL, "classic": CLASSIC, "spread": SPREAD}
COST = 0.001
IN_FULL = f"period BETWEEN DATE '{fx.FULL[0]}' AND DATE '{fx.FULL[1]}'"


def weight_rows(spark, books: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(p, e, w) for p, mix in books.items() for e, w in mix.items()],
                                 "portfolio string, entity string, w double")


def sql_weights(books) -> tuple[str, str]:
    rows = ", ".join(f"('{p}', '{e}', {w!r}::DOUBLE)" for p, mix in books.items() for e, w in mix.items())
    return ("wr", f"SELECT portfolio, entity, w / sum(w) OVER (PARTITION BY portfolio) AS w FROM (VALUES {rows}) v(portfolio, entity, w) WHERE entity IN (SELECT entity FROM ret)")


def full_returns(spark, sf_dir) -> DataFrame:
    """Series complete over the full window."""
    return rt.complete_panel(fx.brand_returns(spark, sf_dir), *fx.FULL)


FULL_RET = [*BRAND[:-1], ("ret_nn", "SELECT * FROM ret_all WHERE ret IS NOT NULL"),
            ("ret", f"SELECT * FROM ret_nn WHERE {IN_FULL} AND entity IN (SELECT entity FROM ret_nn WHERE {IN_FULL} GROUP BY 1 "
             f"HAVING count(*) = (SELECT count(DISTINCT period) FROM ret_nn WHERE {IN_FULL}))")]
FULL_CONTEXT = [*FULL_RET, *CONTEXT[len(BRAND):]]


def book_ctes(books) -> list:
    return [sql_weights(books), ("bk", "SELECT portfolio, period, entity, w, ret FROM wr JOIN ret USING (entity)")]


FIXED = [("fx", "SELECT portfolio, period, sum(w * ret) AS net FROM bk GROUP BY 1, 2")]


def cost_ctes(cost: float = COST) -> list:
    return [("g0", "SELECT *, sum(w * ret) OVER (PARTITION BY portfolio, period) AS g FROM bk"),
            ("g1", "SELECT *, lag(w * (1 + ret) / (1 + g)) OVER (PARTITION BY portfolio, entity ORDER BY period) AS prev FROM g0"),
            ("fc", "SELECT portfolio, period, sum(w * ret) AS gross, sum(abs(w - coalesce(prev, 0))) AS turnover, "
             f"sum(w * ret) - sum(abs(w - coalesce(prev, 0))) * {cost} AS net FROM g1 GROUP BY 1, 2")]


def book(spark, sf_dir, books=BOOKS, returns_=None) -> DataFrame:
    r = full_returns(spark, sf_dir) if returns_ is None else returns_
    return bk.positions(bk.fixed_weights(weight_rows(spark, books), r), r)


@query("bt_fixed", with_([*FULL_RET, *book_ctes(BOOKS), *FIXED], f"SELECT portfolio, period, {q('net')} AS net FROM fx"))
def bt_fixed(spark, sf_dir):
    return bk.gross_months(book(spark, sf_dir))


COSTED = "SELECT portfolio, period, " + ", ".join(f"{q(c)} AS {c}" for c in ("gross", "turnover", "net")) + " FROM fc"


@query("bt_fixed_cost", with_([*FULL_RET, *book_ctes(BOOKS), *cost_ctes()], COSTED))
def bt_fixed_cost(spark, sf_dir):
    return bk.rebalanced_months(book(spark, sf_dir), COST)


# Benchmark legs (series, alternate, weight); two legs need their alternate or drop out.
LEGS = [("bench", "Brand#1", None, 0.30), ("bench", "Brand#5", None, 0.55), ("bench", "Brand#99", "Brand#9", 0.075),
        ("bench", "Brand#98", None, 0.075)]


@query("bt_benchmark", with_([*FULL_RET, ("wr", "SELECT 'bench' AS portfolio, entity, w / 0.925 AS w FROM (VALUES ('Brand#1', 0.30::DOUBLE), ('Brand#5', 0.55), ('Brand#9', 0.075)) v(entity, w)"),
                              ("bk", "SELECT portfolio, period, entity, w, ret FROM wr JOIN ret USING (entity)"), *cost_ctes()], COSTED))
def bt_benchmark(spark, sf_dir):
    r = full_returns(spark, sf_dir)
    legs = spark.createDataFrame(LEGS, "portfolio string, entity string, alternate string, w double")
    weights = bk.benchmark_weights(legs, r.select("entity").distinct())
    return bk.rebalanced_months(bk.positions(weights, r), COST)


def overlay_cte(lookback: str, exit_: bool, source: str = "bk", out: str = "ov") -> list:
    frame = f"OVER (PARTITION BY portfolio, entity ORDER BY period ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    mom = f"CASE WHEN count(ret) {frame} = {lookback} THEN product(1 + ret) {frame} - 1 END"
    rule = "CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END" if exit_ else "sign(m)"
    return [(f"{out}_m", f"SELECT *, {mom} AS m FROM {source}"),
            (out, f"SELECT portfolio, period, sum(w * CASE WHEN m IS NULL THEN 1.0 ELSE {rule} END * ret) AS net FROM {out}_m GROUP BY 1, 2")]


@query("bt_tsmom_cash", with_([*FULL_RET, *book_ctes(BOOKS), *overlay_cte("12", True)], f"SELECT portfolio, period, {q('net')} AS net FROM ov"))
def bt_tsmom_cash(spark, sf_dir):
    return bk.gross_months(bk.momentum_exit(book(spark, sf_dir), 12))


@query("bt_tsmom_ls", with_([*FULL_RET, *book_ctes(BOOKS), *overlay_cte("12", False)], f"SELECT portfolio, period, {q('net')} AS net FROM ov"))
def bt_tsmom_ls(spark, sf_dir):
    return bk.gross_months(bk.momentum_sign(book(spark, sf_dir), 12))


STATS = f"{q('CASE WHEN count(net) >= 2 AND product(1 + net) > 0 THEN pow(product(1 + net), 12.0 / count(net)) - 1 END')} AS cagr, " \
        f"{q('coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.0), 0.0)')} AS sharpe"
W2, W3 = (f"period BETWEEN DATE '{fx.CRISES[k][0]}' AND DATE '{fx.CRISES[k][1]}'" for k in ("w2", "w3"))
EPISODES = f"{q(f'coalesce(product(1 + net) FILTER ({W2}) - 1, 0.0)')} AS first_cum, {q(f'coalesce(product(1 + net) FILTER ({W3}) - 1, 0.0)')} AS second_cum"


def series_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    def episode(name: str):
        a, b = (F.lit(d).cast("date") for d in fx.CRISES[name])
        return F.coalesce(F.product(F.when(F.col("period").between(a, b), 1 + F.col("net"))) - 1, F.lit(0.0))
    return df.groupBy(*keys).agg(
        mt.cagr(), mt.annual_sharpe(F.avg("net"), F.stddev_samp("net"), F.count("net")).alias("sharpe"),
        episode("w2").alias("first_cum"), episode("w3").alias("second_cum"))


SHARES = [0.3, 0.4, 0.5, 0.6, 0.7]
CARRY_TREND = [*FULL_RET, *book_ctes({"classic": CLASSIC, "spread": SPREAD}), *FIXED, *overlay_cte("12", False),
               ("bl", "SELECT c.portfolio AS carry, t.portfolio AS trend, s AS w_trend, period, (1 - s) * c.net + s * t.net AS net FROM fx c JOIN ov t USING (period), "
                "(SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS s)")]


@query("blend_grid", with_([*CARRY_TREND, ("r", f"SELECT carry, trend, w_trend, {STATS}, {EPISODES} FROM bl GROUP BY 1, 2, 3"),
                            ("b", "SELECT *, first_cum > 0 AND second_cum > 0 AS positive_both FROM r")],
                           "SELECT *, positive_both AND cagr = (SELECT max(cagr) FROM b WHERE positive_both) AS best FROM b"))
def blend_grid(spark, sf_dir):
    base = materialize(book(spark, sf_dir, {"classic": CLASSIC, "spread": SPREAD}))
    mixed = bk.blends(bk.gross_months(base), bk.gross_months(bk.momentum_sign(base, 12)), SHARES)
    df = series_stats(mixed, ["carry", "trend", "w_trend"])
    df = materialize(df.select("carry", "trend", "w_trend", *[F.round(c, 8).alias(c) for c in ("cagr", "sharpe", "first_cum", "second_cum")])
                     .withColumn("positive_both", (F.col("first_cum") > 0) & (F.col("second_cum") > 0)))
    top = df.where("positive_both").agg(F.max("cagr").alias("top"))
    return df.join(F.broadcast(top), F.col("cagr") == F.col("top"), "left").withColumn(
        "best", F.col("positive_both") & F.col("top").isNotNull()).drop("top")


@query("lookback_grid", with_([*FULL_RET, *book_ctes({"spread": SPREAD}), *[c for n in (6, 9, 12) for c in overlay_cte(str(n), True, out=f"ov{n}")],
                               ("u", " UNION ALL ".join(f"SELECT {n} AS lookback, * FROM ov{n}" for n in (6, 9, 12)))],
                              f"SELECT lookback, {STATS}, {EPISODES} FROM u GROUP BY 1"))
def lookback_grid(spark, sf_dir):
    base = book(spark, sf_dir, {"spread": SPREAD})
    out = None
    for n in (6, 9, 12):
        part = bk.gross_months(bk.momentum_exit(base, n)).withColumn("lookback", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return series_stats(out, ["lookback"])


@query("bt_candidates")
def bt_candidates(spark, sf_dir):
    """Eight candidates: given or equal-risk weights (from the whole window, so in-sample), static, exit or sign."""
    r = materialize(full_returns(spark, sf_dir))
    wide = wide_returns(r.where(F.col("entity").isin(list(VINTAGE.names))), VINTAGE)
    n = VINTAGE.n
    cells = wide.agg(*[F.covar_samp(f"r_{i}", f"r_{j}").alias(pair(i, j)) for i in range(n) for j in range(i, n)])
    cov = cells.select(F.lit(0).alias("window_id"), F.lit(1).alias("refit_no"),
                       F.array(*[F.col(pair(i, j)) for i in range(n) for j in range(n)]).alias("cov"))
    whole = spark.range(1).select(F.lit(0).alias("window_id"), F.lit((1 << n) - 1).cast("bigint").alias("mask"), F.lit(n).alias("n_sleeves"))
    solved = solver_weights(whole, cov, VINTAGE, ["erc"], 0.20, "posthoc", partitions=1)
    members = F.array(*[F.struct(F.lit(x).alias("entity"), F.col(f"b_{i}").alias("w")) for i, x in enumerate(VINTAGE.names)])
    erc = solved.select(F.lit("erc").alias("portfolio"), F.explode(members).alias("e")).select("portfolio", "e.*")
    given = bk.fixed_weights(weight_rows(spark, {"classic": CLASSIC, "spread": SPREAD}), r)
    base = materialize(bk.positions(given.unionByName(erc), r))
    label = lambda df, name: df.withColumn("overlay", F.lit(name))
    runs = (label(bk.gross_months(base), "none").unionByName(label(bk.gross_months(bk.momentum_exit(base, 12)), "exit"))
            .unionByName(label(bk.gross_months(bk.momentum_sign(base, 12)), "sign")))
    # The pairs that make up the candidate list.
    kept = (F.col("overlay") != "sign") | F.col("portfolio").isin("spread", "erc")
    return series_stats(runs.where(kept), ["portfolio", "overlay"])


DRILL_BOOKS = {"equal": EQUAL, "static": fx.STATIC}
PAIRED = "SELECT period, max(net) FILTER (portfolio = 'equal') AS a, max(net) FILTER (portfolio = 'static') AS b FROM fx GROUP BY 1"


@query("stress_drilldown", with_(
    [*FULL_CONTEXT, *book_ctes(DRILL_BOOKS), *FIXED, ("p", PAIRED), ("i", inside("p")),
     ("u", "SELECT 'both_down_month' AS type, CAST(p.period AS VARCHAR) AS window_name, a, b FROM p JOIN ctx USING (period) WHERE both_down "
      "UNION ALL SELECT 'crisis_window', name, product(1 + a) - 1, product(1 + b) - 1 FROM i GROUP BY name")],
    f"SELECT type, window_name, {q('a')} AS winner_ret, {q('b')} AS benchmark_ret, {q('a - b')} AS diff FROM u"))
def stress_drilldown(spark, sf_dir):
    r = full_returns(spark, sf_dir)
    months = materialize(bk.gross_months(book(spark, sf_dir, DRILL_BOOKS, r)))
    refs = fx.references(r).where("both_down").select("period")
    down = months.join(F.broadcast(refs), "period").select(
        F.lit("both_down_month").alias("type"), F.col("period").cast("string").alias("window_name"), "portfolio", "net")
    episodes = mt.episode_stats(months, mt.catalog(spark, fx.CRISES), ["portfolio"]).select(
        F.lit("crisis_window").alias("type"), F.col("name").alias("window_name"), "portfolio", F.col("cum_ret").alias("net"))
    of = lambda p: F.max(F.when(F.col("portfolio") == p, F.col("net")))
    out = down.unionByName(episodes).groupBy("type", "window_name").agg(of("equal").alias("winner_ret"), of("static").alias("benchmark_ret"))
    return out.withColumn("diff", F.col("winner_ret") - F.col("benchmark_ret"))


# The polynomial of functions.scalar.norm_cdf, of z and t = 1 / (1 + p |z| / sqrt 2)
NORMAL = "0.5 * (1.0 + sign(z) * (1.0 - (" + " + ".join(f"{a} * pow(t, {k + 1})" for k, a in enumerate(ERF_A)) + ") * exp(-z * z / 2.0)))"


IN_TRAIN = f"period BETWEEN DATE '{fx.TRAIN[0]}' AND DATE '{fx.TRAIN[1]}'"
#: Trials of the training search: its portfolios, of the series that are complete in the window, under every scheme.
COUNTED = [ts.roster_cte(fx.ROSTER),
           ("tw", f"SELECT i FROM ret_nn JOIN ros USING (entity) WHERE {IN_TRAIN} GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT period) FROM ret_nn WHERE {IN_TRAIN})"),
           ("nt", f"SELECT count(*) * {len(fx.SCHEMES)} AS n_trials FROM range(1, {1 << fx.ROSTER.n}), (SELECT CAST(sum(1 << i) AS BIGINT) AS a FROM tw) WHERE (range & a) = range "
            f"AND (range & {fx.ROSTER.mask(fx.EQUITY)}) <> 0 AND (range & {fx.ROSTER.mask(fx.BONDS)}) <> 0 AND bit_count(range) BETWEEN {fx.SETTINGS.min_sleeves} AND {fx.SETTINGS.max_sleeves}")]
DEFLATED = [*FULL_RET, *book_ctes(BOOKS), *FIXED, *COUNTED,
            ("m", "SELECT portfolio, count(net) AS n, skewness(net) AS sk, kurtosis(net) AS ku, avg(net) / stddev_samp(net) AS sr, any_value(n_trials) AS nt, "
             "sqrt(2 * ln(any_value(n_trials))) AS z FROM fx, nt GROUP BY 1"),
            ("s", "SELECT *, (z - 0.5772156649015329 / z) / sqrt(n) AS sr0 FROM m")]


def counted_trials(spark, sf_dir) -> tuple[DataFrame, int]:
    """The brand returns, and the trials of the training search: portfolios of its complete series times schemes."""
    r = fx.brand_returns(spark, sf_dir)
    found = availability(r, materialize(window_months(r, fx.window(spark, fx.TRAIN))), fx.ROSTER)
    return r, len(fx.SCHEMES) * sum(combination_count(fx.ROSTER, fx.SETTINGS.min_sleeves, fx.SETTINGS.max_sleeves, a) for a in found.values())


def deflated(spark, sf_dir) -> DataFrame:
    r, n_trials = counted_trials(spark, sf_dir)
    series = bk.gross_months(book(spark, sf_dir, returns_=rt.complete_panel(r, *fx.FULL)))
    return st.deflated_sharpe(series, ["portfolio"], F.lit(n_trials))


@query("deflated_sharpe", with_(DEFLATED, f"SELECT portfolio, n, nt::DOUBLE AS n_trials, {q('sr * sqrt(12.0)')} AS sr_ann, {q('sr0 * sqrt(12.0)')} AS sr0_ann, "
                                f"{q('(sr - sr0) * sqrt(12.0)')} AS deflated_sr_ann, {q('(sr - sr0) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12))')} AS z FROM s"))
def deflated_sharpe(spark, sf_dir):
    return deflated(spark, sf_dir).drop("dsr_prob")


@query("dsr_probability", with_(
    [*DEFLATED, ("v", "SELECT portfolio, n, (sr - sr0) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12)) AS z FROM s"),
     ("e", f"SELECT *, 1.0 / (1.0 + {ERF_P} * abs(z) / sqrt(2.0)) AS t FROM v")],
    f"SELECT portfolio, n, {q('z')} AS z, {q(NORMAL)} AS dsr_prob FROM e"))
def dsr_probability(spark, sf_dir):
    return deflated(spark, sf_dir).select("portfolio", "n", "z", "dsr_prob")


def drawn(x: str) -> str:
    """The fifth power of a column modulo the prime."""
    sq = f"({x} * {x} % {st.PRIME})"
    return f"({sq} * {sq} % {st.PRIME}) * {x} % {st.PRIME}"


N_BOOT = 1000
#: The same draws block by block: samples walk through their blocks, and the rows of each block are added up one by one.
BOOT = [*FULL_RET, *book_ctes(BOOKS), *FIXED,
        ("se", "SELECT portfolio, net AS v, row_number() OVER (PARTITION BY portfolio ORDER BY period) - 1 AS pos FROM fx"),
        ("sn", "SELECT portfolio, count(*) AS n, CAST('0x' || substr(md5(portfolio), 1, 7) AS BIGINT) AS k FROM se GROUP BY 1"),
        ("h0", f"SELECT portfolio, n, sample, {drawn('y')} AS h FROM (SELECT portfolio, n, sample, ({drawn('x')} * 48271 + sample + 1) % {st.PRIME} AS y "
               f"FROM (SELECT *, (k % {st.PRIME} * 48271 + 1) % {st.PRIME} AS x, range AS sample FROM sn, range(0, {N_BOOT})))"),
        ("bl", "SELECT portfolio, n, sample, h, 0::BIGINT AS filled, 0::BIGINT AS from_pos, 0::BIGINT AS len FROM h0 UNION ALL "
               f"SELECT portfolio, n, sample, h2, filled + least(g, n - a, n - filled), a, least(g, n - a, n - filled) FROM ("
               f"SELECT *, CAST(floor(h1 / {float(st.PRIME)} * n) AS BIGINT) AS a, CAST(floor(ln(1 - h2 / {float(st.PRIME)}) / ln(1 - 1 / 6.0::DOUBLE)) AS BIGINT) + 1 AS g FROM ("
               f"SELECT *, {drawn('y2')} AS h2 FROM (SELECT *, (h1 * 48271 + 12) % {st.PRIME} AS y2 FROM (SELECT *, {drawn('y1')} AS h1 FROM ("
               f"SELECT *, (h * 48271 + 11) % {st.PRIME} AS y1 FROM bl WHERE filled < n)))))"),
        ("sm", "SELECT portfolio, sample, any_value(n) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM (SELECT portfolio, sample, n, unnest(range(from_pos, from_pos + len)) AS pos FROM bl WHERE len > 0) "
               "JOIN se USING (portfolio, pos) GROUP BY 1, 2"),
        ("ci", "SELECT portfolio, quantile_cont(coalesce(m / nullif(sd, 0) * sqrt(12.0), 0.0), [0.025, 0.975]) AS s, quantile_cont(m * 12, [0.025, 0.975]) AS r FROM sm GROUP BY 1"),
        ("pt", "SELECT portfolio, count(*) AS n, coalesce(avg(v) / nullif(stddev_samp(v), 0) * sqrt(12.0), 0.0) AS sharpe, avg(v) * 12 AS ann_ret FROM se GROUP BY 1")]


@query("bootstrap_ci", recursive(BOOT, f"SELECT portfolio, n, {q('sharpe')} AS sharpe, {q('ann_ret')} AS ann_ret, {q('s[1]')} AS sharpe_lo, {q('s[2]')} AS sharpe_hi, "
                                       f"{q('r[1]')} AS ann_ret_lo, {q('r[2]')} AS ann_ret_hi FROM pt JOIN ci USING (portfolio)"))
def bootstrap_ci(spark, sf_dir):
    series = materialize(bk.gross_months(book(spark, sf_dir)))
    return st.block_bootstrap(series, ["portfolio"], {"sharpe": st.sharpe_stat(), "ann_ret": st.return_stat()}, n_boot=N_BOOT)
