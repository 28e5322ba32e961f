"""Operators against plain loops on small fixtures."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.ranks import competition_rank_desc, percentile_average, value_ranks
from tidepanel.functions.scalar import fixed_text, norm_cdf, percent_text
from tidepanel.operators import audit, returns as rt, selection, signals as sg, stats
from tidepanel.operators.covariance import refit_covariance
from tidepanel.operators.schemes import Scheme, all_schemes
from tidepanel.operators.trials import TRIAL_KEYS, TrialSettings, plan_trials, trial_months
from tidepanel.operators.universe import Roster, combination_count, combinations, portfolio_space, window_months, windows_frame
from tidepanel.session import materialize
from tidepanel.sources import files

NAMES = tuple("abcdef")
ROSTER = Roster(NAMES, NAMES[:2], NAMES[2:4], inflation_proxies=("e",), equity_proxies=("a",))


def month(k: int) -> datetime.date:
    return (pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(k)).date()


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    return rng.normal(0.004, 0.06, size=(130, 6))


@pytest.fixture(scope="module")
def returns(spark, matrix):
    rows = [(month(t), NAMES[i], float(matrix[t, i])) for t in range(len(matrix)) for i in range(6)]
    return materialize(spark.createDataFrame(rows, "period date, entity string, ret double"))


def test_returns_do_not_bridge_holes(spark):
    rows = [("2000-01-31", "a", 1.0), ("2000-02-29", "a", 2.0), ("2000-03-31", "b", 5.0), ("2000-04-30", "a", 4.0), ("2000-05-31", "a", 5.0)]
    lv = spark.createDataFrame(rows, "period string, entity string, level double").withColumn("period", F.to_date("period"))
    got = {(str(r.period), r.entity): r.ret for r in rt.simple_returns(lv).collect()}
    assert got[("2000-02-29", "a")] == 1.0
    assert got[("2000-04-30", "a")] is None and got[("2000-01-31", "a")] is None
    assert got[("2000-05-31", "a")] == 0.25


def test_hysteresis_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    x, e = rng.random((300, 40)) < 0.25, rng.random((300, 40)) < 0.25
    rows = [(k, t, bool(x[k, t]), bool(e[k, t])) for k in range(300) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, period int, x boolean, e boolean")
    got = sg.hysteresis(df, ["k"], F.col("x"), F.col("e"), "s").toPandas().set_index(["k", "period"])["s"]
    for k in range(300):
        state = 1.0
        for t in range(40):
            if state > 0 and x[k, t]:
                state = -1.0
            elif state < 0 and e[k, t]:
                state = 1.0
            assert got[(k, t)] == state


def test_ranks_equal_pandas(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(400), rng.integers(0, 50, 300) / 7.0, rng.normal(size=500)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = value_ranks(df, ["g"], "v", buckets=8).select(
        "g", "v", percentile_average().alias("p"), competition_rank_desc().alias("r")).toPandas()
    pdf = pd.DataFrame({"g": np.arange(len(values)) % 2, "v": values})
    pdf["p"] = pdf.groupby("g")["v"].rank(pct=True)
    pdf["r"] = pdf.groupby("g")["v"].rank(ascending=False, method="min")
    want = pdf.drop_duplicates(["g", "v"]).merge(got, on=["g", "v"], suffixes=("", "_s"))
    assert len(want) == len(got)
    assert np.allclose(want["p"], want["p_s"]) and (want["r"] == want["r_s"]).all()


@pytest.mark.parametrize("shape,lo,hi,count", [((4, 4, 4), 5, 8, 2817), ((4, 4, 4), 2, 8, 3301), ((3, 3, 1), 5, 7, 29)])
def test_combination_counts(spark, shape, lo, hi, count):
    e, b, o = shape
    names = tuple(f"s{i}" for i in range(e + b + o))
    roster = Roster(names, names[:e], names[e:e + b])
    assert combinations(spark, roster, lo, hi).count() == count
    assert combination_count(roster, lo, hi, (1 << len(names)) - 1) == count


@pytest.mark.parametrize("n_eq,n_bd,n_other,lo,hi", [(20, 12, 8, 2, 4), (1, 1, 0, 2, 8), (0, 5, 5, 2, 4), (3, 3, 34, 3, 4)])
def test_portfolios_are_read_back_from_their_number(spark, n_eq, n_bd, n_other, lo, hi):
    """Forty series and more: every allowed subset once, against itertools; 2^40 masks are never listed."""
    names = tuple(f"s{i}" for i in range(n_eq + n_bd + n_other))
    roster = Roster(names, names[:n_eq], names[n_eq:n_eq + n_bd])
    gone = {0: (1 << len(names)) - 1, 3: ((1 << len(names)) - 1) & ~0b10010, 7: 0}
    want = [(w, sum(1 << i for i in c), len(c)) for w, a in gone.items() for k in range(lo, hi + 1)
            for c in itertools.combinations([i for i in range(len(names)) if a >> i & 1], k)
            if any(i < n_eq for i in c) and any(n_eq <= i < n_eq + n_bd for i in c)]
    got = [tuple(r) for r in portfolio_space(spark, roster, lo, hi, gone).collect()]
    assert sorted(got) == sorted(want)
    assert len(got) == sum(combination_count(roster, lo, hi, a) for a in gone.values())


def shrunk(x):
    t, n = x.shape
    d = x - x.mean(axis=0)
    s = d.T @ d / t
    mu = np.trace(s) / n
    d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in d) / (t * t * n), d2)
    delta = b2 / d2
    return delta * mu * np.eye(n) + (1 - delta) * s


def test_shrinkage_equals_a_loop(spark, returns, matrix):
    months = window_months(returns, windows_frame(spark, [(0, str(month(60)), str(month(90)))]))
    got = {r.refit_no: r for r in refit_covariance(returns, months, ROSTER).collect()}
    first = [t for t in range(60, 91) if t == 60 or month(t).month == 1]
    assert sorted(got) == list(range(1, len(first) + 1))
    for k, t in enumerate(first, 1):
        assert np.allclose(np.array(got[k].cov).reshape(6, 6), shrunk(matrix[t - 36:t]), atol=1e-12)


@pytest.mark.parametrize("days", [1, 45, 400, 100_000])
def test_drawdown_of_a_series_in_many_blocks(spark, days):
    """Blocks of a month, two, a year and the whole: holes, a total loss and a return below -100 % among them."""
    rng = np.random.default_rng(11)
    series = {"plain": rng.normal(0.01, 0.2, 60), "holes": np.where(rng.random(60) < 0.3, np.nan, rng.normal(0, 0.1, 60)), "lost": np.r_[rng.normal(0, 0.1, 20), -1.0, rng.normal(0, 0.1, 39)],
              "below": np.r_[rng.normal(0, 0.1, 15), -1.4, rng.normal(0, 0.1, 20), -1.2, rng.normal(0, 0.1, 23)], "none": np.full(60, np.nan)}
    rows = [(e, month(t), None if np.isnan(v) else float(v), 7) for e, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity string, period date, ret double, other int")
    got = {(r.entity, r.period): r for r in sg.drawdown(df, ["entity"], block=F.expr(f"datediff(period, date'1990-01-01') div {days}")).collect()}
    for e, x in series.items():
        w, peak, at = None, None, None
        for t, v in enumerate(x):
            w = w if np.isnan(v) else (1.0 if w is None else w) * (1 + v)
            if w is not None and not np.isnan(v) and (peak is None or w >= peak):
                peak, at = w, month(t)
            r = got[e, month(t)]
            assert r.other == 7
            if w is None:
                assert r.wealth is None and r.dd is None
            else:
                assert math.isclose(r.wealth, w, rel_tol=1e-12, abs_tol=1e-15)
                assert math.isclose(r.dd, w / peak - 1, rel_tol=1e-9, abs_tol=1e-12)
                assert e in ("lost", "below", "holes") or r.peak.period == at


def loop_backtest(matrix, members, weights_at, coef, start, stop, cost, lev):
    """Month by month with an explicit drifting position."""
    pos, rows = None, []
    for t in range(start, stop):
        base = weights_at(t)
        target = base * coef(t)
        r = matrix[t, members]
        turnover = np.abs(target - (0 if pos is None else pos)).sum()
        g = float(target @ r)
        funding = max(np.abs(target).sum() - 1, 0) * lev / 12
        rows.append((g, turnover, g - turnover * cost - funding))
        pos = target * (1 + r) / (1 + g) if 1 + g > 1e-6 else target
    return np.array(rows)


def test_grid_equals_a_loop(spark, returns, matrix):
    start, stop, members = 60, 96, [0, 2, 4]
    mask = sum(1 << i for i in members)
    settings = TrialSettings(cap=0.6, cost_bps=10, lev_rate=0.05, min_sleeves=2, max_sleeves=6)
    schemes = [Scheme("EW", flavor=False), Scheme("MinVar", base="minvar", flavor=False), Scheme("TG", gate_mode="short", w_overlay=0.2)]
    plan = plan_trials(returns, windows_frame(spark, [(0, str(month(start)), str(month(stop - 1)))]), ROSTER, schemes, settings)
    got = trial_months(plan).where(F.col("mask") == mask).toPandas().sort_values("period")
    solved = {r.refit_no: np.array([r[f"b_{i}"] for i in members]) for r in plan.weights.where(F.col("mask") == mask).collect()}
    refit = np.cumsum([t == start or month(t).month == 1 for t in range(start, stop)])
    equal = np.full(3, 1 / 3)

    def momentum(t):
        return np.sign(np.prod(1 + matrix[t - 12:t, members], axis=0) - 1)

    ones = lambda t: np.ones(3)
    gate = lambda t: np.where(np.array([True, False, False]) & (momentum(t) != 0), momentum(t), 1.0) + 0.2 * momentum(t)
    for name, at, coef, lev in (("EW", lambda t: equal, ones, 0.0), ("MinVar", lambda t: solved[refit[t - start]], ones, 0.0),
                                ("TG", lambda t: equal, gate, 0.05)):
        want = loop_backtest(matrix, members, at, coef, start, stop, 0.001, lev)
        mine = got[got.scheme == name][["gross", "turnover", "net"]].to_numpy()
        assert np.allclose(mine, want, atol=1e-12), name


def test_the_grid_never_moves_trial_months(spark, returns):
    settings = TrialSettings(min_sleeves=2, max_sleeves=6)
    plan = plan_trials(returns, windows_frame(spark, [(0, str(month(60)), str(month(90)))]), ROSTER, [Scheme("EW", flavor=False)], settings)
    from tidepanel.operators.metrics import trial_metrics
    from tidepanel.operators.trials import LAID_OUT
    text = trial_metrics(plan.branches[0], LAID_OUT)._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan =="):]
    exchanges = [line for line in physical.splitlines() if "Exchange hashpartitioning" in line]
    # the portfolios and the market rows, both by window and slot; nothing above their join
    assert len(exchanges) == 2 and all("hashpartitioning(window_id" in line and "slot" in line for line in exchanges)
    assert "ShuffledHashJoin [window_id" in physical and "slot" in physical
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_folds_together_equal_folds_alone(spark, returns):
    """Five schemes, equal risk and minimum variance among them: each fold's winner is the one of a search of that fold alone, and so are its months."""
    from tidepanel.operators.search import evaluate, search
    schemes = [Scheme(n, base=b, flavor=False) for n, b in (("EW", "ew"), ("InvVol", "invvol"), ("InvVar", "invvar"), ("ERC", "erc"), ("MinVar", "minvar"))]
    settings = TrialSettings(cap=0.4, cost_bps=10.0, min_sleeves=3, max_sleeves=5)
    spans = [(k + 1, str(month(40 + 12 * k)), str(month(75 + 12 * k)), str(month(76 + 12 * k)), str(month(87 + 12 * k))) for k in range(2)]
    folds = spark.createDataFrame(spans, "window_id int, start_d string, train_end string, test_start string, test_end string").select(
        "window_id", *[F.col(c).cast("date").alias(c) for c in ("start_d", "train_end", "test_start", "test_end")])
    ctx = returns.groupBy("period").agg(F.avg("ret").alias("eq_ref"), F.min("ret").alias("bd_ref")).withColumn("both_down", (F.col("eq_ref") < 0) & (F.col("bd_ref") < 0)).withColumn("season", F.lit(""))
    chosen, months, _ = selection.select_and_hold(returns, folds, ROSTER, schemes, settings, ctx, "default")
    together = {r.window_id: (r.scheme, r.mask) for r in chosen.collect()}
    net = {(r.window_id, r.period): r.net for r in months.collect()}
    for k, a, b, c, d in spans:
        alone = search(returns, windows_frame(spark, [(k, a, b)]), ROSTER, schemes, settings, ctx, "default").toPandas()
        best = alone.sort_values(["rank", "mask", "scheme"]).iloc[0]
        assert together[k] == (best["scheme"], best["mask"])
        only = spark.createDataFrame([(k, best["scheme"], int(best["mask"]))], "window_id int, scheme string, mask bigint")
        held = trial_months(evaluate(returns, windows_frame(spark, [(k, c, d)]), only, ROSTER, schemes, settings, ctx)).collect()
        assert len(held) == 12 and all(math.isclose(net[k, r.period], r.net, abs_tol=1e-9) for r in held)


def test_panels_are_shared_inside_only(spark, tmp_path):
    from tidepanel.sources import panels
    with panels.shared():
        assert panels.type_month(spark, "/root/testdata/sf0.001") is panels.type_month(spark, "/root/testdata/sf0.001")
    assert panels.type_month(spark, "/root/testdata/sf0.001") is not panels.type_month(spark, "/root/testdata/sf0.001")


def test_fifty_schemes():
    schemes = all_schemes("x")
    assert len(schemes) == 50 == len({s.name for s in schemes})


def test_folds_snap_or_keep_the_day(spark):
    rows = [((pd.Timestamp("1985-02-28") + pd.offsets.MonthEnd(k)).date(), "a", 0.0) for k in range(498)]
    r = spark.createDataFrame(rows, "period date, entity string, ret double")
    snapped = selection.make_folds(spark, r, "1985-02-28", "2026-07-31", 10, 4, 4).collect()
    kept = selection.make_folds(spark, r, "1985-02-28", "2026-07-31", 10, 4, 4, snap=False).collect()
    assert len(snapped) == len(kept) == 8
    assert sum(f.n_test for f in snapped) == 378
    assert sum(f.n_test for f in kept) == 371
    assert str(kept[0].train_end) == "1995-01-28"


def test_bootstrap_repeats_and_brackets(spark, returns):
    series = returns.where(F.col("entity").isin("a", "b")).withColumnRenamed("ret", "net")
    run = lambda: stats.block_bootstrap(series, ["entity"], {"sharpe": stats.sharpe_stat(), "ann": stats.return_stat()}, n_boot=200).toPandas()
    one, two = run().sort_values("entity"), run().sort_values("entity")
    assert np.allclose(one["sharpe_lo"], two["sharpe_lo"])
    assert (one["sharpe_lo"] < one["sharpe"]).all() and (one["sharpe"] < one["sharpe_hi"]).all()
    short = series.where(F.col("period") < F.lit("2000-09-01").cast("date"))
    row = stats.block_bootstrap(short, ["entity"], {"ann": stats.return_stat()}, n_boot=50).first()
    assert row.ann_lo == row.ann == row.ann_hi


def test_effective_trials_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 24)) + rng.normal(size=24)
    rows = [(0, "s", k, month(t), float(x[k, t])) for k in range(50) for t in range(24)]
    df = spark.createDataFrame(rows, "window_id int, scheme string, mask int, period date, net double")
    got = stats.effective_trials(df, TRIAL_KEYS).first()
    d = x - x.mean(axis=1, keepdims=True)
    ev = np.linalg.eigvalsh(d.T @ d)
    assert math.isclose(got.effective_n, ev.clip(0).sum() / ev.max(), rel_tol=1e-9)
    assert got.n_trials == 50


def test_effective_trials_of_several_windows(spark, monkeypatch):
    """Windows of other lengths, equal trials, flat trials; once with a sum per month, once with a row per month."""
    rng = np.random.default_rng(4)
    grids = {0: rng.normal(size=(30, 5)), 1: np.repeat(rng.normal(size=(1, 9)), 7, axis=0), 2: np.zeros((4, 6)), 3: np.vstack([np.eye(8), -np.eye(8)])}
    rows = [(w, "s", k, month(t), float(g[k, t])) for w, g in grids.items() for k in range(len(g)) for t in range(g.shape[1])]
    df = spark.createDataFrame(rows, "window_id int, scheme string, mask int, period date, net double")
    for limit in (90, 0):
        monkeypatch.setattr(stats, "IN_CODE", limit)
        got = {r.window_id: r for r in stats.effective_trials(df, TRIAL_KEYS).collect()}
        for w, g in grids.items():
            d = g - g.mean(axis=1, keepdims=True)
            ev = np.linalg.eigvalsh(d.T @ d)
            assert got[w].n_trials == len(g)
            assert got[w].effective_n is None if w == 2 else math.isclose(got[w].effective_n, ev.clip(0).sum() / ev.max(), rel_tol=1e-9)


def test_normal_distribution(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) for r in df) < 1.5e-7


def test_texts(spark):
    row = spark.sql("SELECT 0.12346D AS x, CAST(NULL AS DOUBLE) AS y").select(
        percent_text(F.col("x")), percent_text(F.col("y")), fixed_text(F.col("x"), 3), fixed_text(F.col("y"))).first()
    assert tuple(row) == ("12.35%", "n/a", "0.123", "n/a")


def test_files_round_trip(spark, tmp_path):
    rows = [(datetime.date(2000, 1, 31), "a", 1.5), (datetime.date(2000, 2, 29), "b", 2.5), (datetime.date(2001, 1, 31), "a", 3.5)]
    lv = spark.createDataFrame(rows, "period date, entity string, level double")
    files.write_csv(files.long_to_wide(lv, ["a", "b"]).coalesce(1), str(tmp_path / "wide"))
    back = files.read_wide_csv(spark, str(tmp_path / "wide"), ["a", "b"])
    assert back.count() == 6
    assert sorted(map(tuple, back.where("level IS NOT NULL").select("period", "entity", "level").collect())) == sorted(rows)
    files.write_parquet(lv, str(tmp_path / "pq"))
    plan = spark.read.parquet(str(tmp_path / "pq")).where("year = 2001")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().toString()
    built = []
    make = lambda: built.append(1) or lv
    for _ in range(2):
        assert files.snapshot(spark, str(tmp_path / "snap"), make).count() == 3
    assert len(built) == 1
    long = lv.select(F.col("period").alias("date"), F.col("entity").alias("ticker"), F.lit("n").alias("name"), F.lit("c").alias("asset_class"),
                     F.lit("s").alias("sector"), F.col("level").alias("monthly_return"))
    files.write_csv(long, str(tmp_path / "long"))
    read = files.read_long_csv(spark, str(tmp_path / "long"), ["a"])
    assert read.columns == ["period", "entity", "ret"] and read.count() == 2
    cpi = lv.select(F.col("period").alias("date"), F.col("level").alias("CPIAUCSL"))
    files.write_csv(cpi, str(tmp_path / "cpi"))
    assert files.read_deflator_csv(spark, str(tmp_path / "cpi")).agg(F.sum("level")).first()[0] == 7.5


def test_audit_finds_what_is_wrong(spark):
    rows = [(datetime.date(2000, 1, d), "a", v) for d, v in ((1, 1.0), (2, -1.0), (3, 0.0), (4, 2e8), (5, 1e-5))]
    bad = spark.createDataFrame(rows, "period date, entity string, level double")
    assert {r.check[:3].strip(): r.severity for r in audit.c1_values(bad).collect()} == {"C1": "FAIL", "C1b": "WARN", "C1c": "WARN", "C1d": "WARN"}
    assert audit.a2_unique(bad.unionByName(bad)).first().severity == "FAIL"
    moved = spark.createDataFrame([(1, 5), (2, 4), (1_000_001, 3)], "k long, p int")
    assert audit.a1_sorted(moved, "k", "p").first().detail == "2 inversions"


def test_covariance_of_the_available_series(spark):
    """A series that starts late doesn't switch off the covariances of the others."""
    import datetime
    ends = [(pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(k)).date() for k in range(48)]
    rng = np.random.default_rng(2)
    rows = [(d, e, float(rng.normal(0, 0.02))) for k, d in enumerate(ends) for e in ("a", "b", "c", "d") if e != "d" or k >= 40]
    r = spark.createDataFrame(rows, "period date, entity string, ret double")
    from tidepanel.operators.universe import Roster, window_months
    roster = Roster(("a", "b", "c", "d"), ("a",), ("b",))
    months = window_months(r, windows_frame(spark, [(0, "2002-01-31", str(ends[-1]))]))
    assert refit_covariance(r, months, roster, 12).count() == 0
    got = refit_covariance(r, months, roster, 12, "none", available={0: 0b111}).collect()
    assert len(got) == 2
    data = r.where(F.col("period") < datetime.date(2002, 1, 31)).toPandas().pivot(index="period", columns="entity", values="ret").tail(12)
    want = data[["a", "b", "c"]].cov().to_numpy()
    mine = np.array(next(g for g in got if g.refit_no == 1)["cov"]).reshape(4, 4)
    assert np.allclose(mine[:3, :3], want) and not mine[3].any()
