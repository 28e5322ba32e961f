"""Overfit statistics: deflated Sharpe, block bootstrap, effective trial count, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import annual_sharpe, norm_cdf, safe_div
from tidepanel.operators.metrics import correlation, moments
from tidepanel.session import materialize

EULER_GAMMA = 0.5772156649015329


def deflated_sharpe(series: DataFrame, keys: Sequence[str], n_trials: Column, x: str = "net",
                    raw_kurtosis: bool = False) -> DataFrame:
    """Sharpe of each series less the best one expected from ``n_trials`` trials of no skill.

    ``n_trials`` is a column over the keys. The published form uses raw kurtosis; the default
    keeps the excess value.
    """
    d = moments(keys, series, x).withColumn("n_trials", n_trials.cast("double"))
    t = F.col("n").cast("double")
    d = d.withColumn("sr_ann", annual_sharpe(F.col("mean"), F.col("std"), F.col("n")))
    sr = F.col("sr_ann") / math.sqrt(12)
    z = F.sqrt(2 * F.log("n_trials"))
    sr0 = (z - EULER_GAMMA / z) / F.sqrt(t)
    kurt = F.col("kurt") + 3.0 if raw_kurtosis else F.col("kurt")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    enough = (F.col("n") >= 3) & (F.col("n_trials") >= 2)
    score = (sr - sr0) * F.sqrt(t - 1) / spread
    return d.select(*keys, "n", "n_trials", "sr_ann", F.when(enough, sr0 * math.sqrt(12)).alias("sr0_ann"),
                    F.when(enough, (sr - sr0) * math.sqrt(12)).alias("deflated_sr_ann"),
                    F.when(enough, score).alias("z"), F.when(enough, norm_cdf(score)).alias("dsr_prob"))


PRIME = (1 << 31) - 1


def _let(name: str, value: str, body: str) -> str:
    """SQL text that computes ``value`` once and calls it ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _mixed(x: str) -> str:
    """A whole number in [0, 2^31 - 1): the fifth power modulo a prime, a permutation whose products fit 64 bits.

    Any engine with 64-bit whole numbers computes the same draws.
    """
    return _let("y", f"({x}) % {PRIME}L", _let("z", f"y * y % {PRIME}L", f"(z * z % {PRIME}L) * y % {PRIME}L"))


def _resampled(block: int) -> str:
    """Sums of one sample, from the series' running sums ``p1`` and ``p2`` (of values and squares): a block costs two look-ups in each."""
    length = f"least(cast(floor(ln(1 - h2 / {PRIME}D) / {math.log(1 - 1 / block)!r}D) as int) + 1, n - at, n - s.filled)"
    after = ("named_struct('h', h2, 'filled', s.filled + len, 's1', s.s1 + element_at(p1, at + len + 1) - element_at(p1, at + 1), "
             "'s2', s.s2 + element_at(p2, at + len + 1) - element_at(p2, at + 1))")
    step = _let("h1", _mixed("s.h * 48271 + 11"), _let("h2", _mixed("h1 * 48271 + 12"),
                _let("at", f"cast(floor(h1 / {PRIME}D * n) as int)", _let("len", length, after))))
    return f"aggregate(sequence(1, n), named_struct('h', h, 'filled', 0, 's1', 0D, 's2', 0D), (s, d) -> if(s.filled >= n, s, {step}))"


PREFIX_ROWS = 2_000_000  # observations whose running sums are broadcast, 16 bytes each; beyond, series are shuffled


def block_bootstrap(series: DataFrame, keys: Sequence[str], stats: dict[str, Column], n_boot: int = 5000,
                    block: int = 6, seed: int = 0, x: str = "net") -> DataFrame:
    """Percentile interval (2.5, 97.5) of statistics over the count ``n``, the sum ``s1`` and the sum of squares ``s2``, per series.

    Blocks start uniformly, have geometric length with mean ``block`` and stop at the series end;
    blocks are drawn until the sample is as long as the series. Draws depend on (seed, series,
    sample) only, so a lost task repeats them. Series shorter than two blocks give the
    point value. A (series, sample) pair is one row: its blocks are look-ups in the series' running sums, so nothing as long as
    the series is exploded or shuffled for a sample.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("period")
    obs = series.where(F.col(x).isNotNull()).select(*keys, "period", F.col(x).alias("v"))
    running = obs.select(*keys, "period", F.sum("v").over(order).alias("r1"), F.sum(F.col("v") * F.col("v")).over(order).alias("r2"))
    zero = F.array(F.lit(0.0))
    prefix = materialize(running.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", "r1", "r2"))).alias("r")).select(
        *keys, F.size("r").alias("n"), F.concat(zero, F.transform("r", lambda r: r["r1"])).alias("p1"), F.concat(zero, F.transform("r", lambda r: r["r2"])).alias("p2")))
    point = prefix.select(*keys, F.col("n").cast("bigint").alias("n"), F.element_at("p1", -1).alias("s1"), F.element_at("p2", -1).alias("s2")) \
        .select(*keys, "n", *[e.alias(k) for k, e in stats.items()])
    number = f"cast(conv(substring(md5(concat_ws('|', {', '.join(keys)})), 1, 7), 16, 10) as bigint)"
    start = _mixed(f"{_mixed(f'({seed}L * 7919 + {number}) % {PRIME}L * 48271 + 1')} * 48271 + sample + 1")
    samples = (prefix.where(F.col("n") >= 2 * block).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("sample"))
               .repartition(*keys, "sample").withColumn("h", F.expr(start)))
    held = prefix.agg(F.sum("n")).first()[0] or 0
    arrays = prefix.select(*keys, "n", "p1", "p2")
    drawn = samples.join(F.broadcast(arrays) if held <= PREFIX_ROWS else arrays, keys).select(*keys, F.col("n").cast("bigint").alias("n"), F.expr(_resampled(block)).alias("s"))
    boots = drawn.select(*keys, "n", "s.s1", "s.s2").select(*keys, *[e.alias(k) for k, e in stats.items()])
    bounds = boots.groupBy(*keys).agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{k}_ci") for k in stats])
    out = point.join(bounds, keys, "left")
    for k in stats:
        out = (out.withColumn(f"{k}_lo", F.coalesce(F.col(f"{k}_ci")[0], F.col(k)))
               .withColumn(f"{k}_hi", F.coalesce(F.col(f"{k}_ci")[1], F.col(k))).drop(f"{k}_ci"))
    return out


def sharpe_stat() -> Column:
    n, s1, s2 = F.col("n").cast("double"), F.col("s1"), F.col("s2")
    spread = F.sqrt(safe_div(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)), n - 1))
    return annual_sharpe(s1 / n, spread, n)


def return_stat() -> Column:
    return F.col("s1") / F.col("n") * 12


LANCZOS_STEPS = 60
IN_CODE = 90  # sums that one generated aggregate holds


def largest_eigenvalue(steps: list[tuple[float, float]]) -> tuple[float, float]:
    """The largest eigenvalue of the Lanczos matrix with these (diagonal, off-diagonal) entries, and the bound on its error."""
    alpha, beta = np.array([a for a, _ in steps]), np.array([b for _, b in steps])
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    left = float(abs(beta[-1] * vectors[-1, -1]))
    gap = float(values[-1] - values[-2]) - left if len(values) > 1 else 0.0
    return float(values[-1]), min(left, left * left / gap) if gap > 0 else left


def effective_trials(months: DataFrame, keys: Sequence[str], group: str = "window_id", x: str = "net") -> DataFrame:
    """Sum of the eigenvalues over the largest one, of the demeaned trial returns, per window.

    The sum is a trace: the squares of all returns. The largest comes from Lanczos steps that need no months x months matrix: a step multiplies every trial's
    months by one vector, scales the trial by the result and adds the trials up by month. What leaves the tasks in a
    step is one vector of months per window; all windows take their steps together, until the error bound of each is below 1e-13.
    """
    spark = months.sparkSession
    wide = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", F.col(x).alias("v")))).alias("l"))
    rows = materialize(wide.select(group, F.transform("l", lambda e: e["v"]).alias("v")).selectExpr(
        group, "transform(v, y -> y - aggregate(v, 0D, (a, b) -> a + b) / size(v)) AS d"))
    totals = rows.selectExpr(group, "aggregate(d, 0D, (a, b) -> a + b * b) AS square").groupBy(group).agg(
        F.sum("square").alias("trace"), F.count(F.lit(1)).alias("n_trials")).collect()

    longest = rows.agg(F.max(F.size("d"))).first()[0] or 0

    def summed(scale: Column, source: DataFrame) -> dict:
        scaled = source.select(group, scale.alias("a"), "d")
        found: dict = {}
        if longest <= IN_CODE:  # one sum per month stays in generated code
            for r in scaled.groupBy(group).agg(F.max(F.size("d")).alias("n"), *[F.sum(F.get("d", F.lit(t)) * F.col("a")).alias(f"y_{t}") for t in range(longest)]).collect():
                found[r[group]] = {t: r[f"y_{t}"] for t in range(r["n"])}
        else:
            for r in scaled.select(group, "a", F.posexplode("d").alias("t", "y")).groupBy(group, "t").agg(F.sum(F.col("y") * F.col("a")).alias("y")).collect():
                found.setdefault(r[group], {})[r["t"]] = r["y"]
        return {w: np.array([v[t] for t in range(len(v))]) for w, v in found.items()}

    kind = rows.schema[group].dataType.simpleString()
    state = {}
    for w, v in summed(F.lit(1.0), rows).items():
        start = v / max(np.linalg.norm(v), 1e-300) + 1e-3 * np.cos(1.0 + np.arange(len(v)))  # no start is orthogonal to everything
        state[w] = {"basis": [start / np.linalg.norm(start)], "steps": [], "done": False}
    for _ in range(LANCZOS_STEPS):
        live = {w: s for w, s in state.items() if not s["done"]}
        if not live:
            break
        at = spark.createDataFrame([(w, s["basis"][-1].tolist()) for w, s in live.items()], f"{group} {kind}, b array<double>")
        dot = F.expr("aggregate(zip_with(d, b, (p, q) -> p * q), 0D, (a, c) -> a + c)")
        for w, v in summed(dot, rows.join(F.broadcast(at), group)).items():
            s = state[w]
            alpha = float(v @ s["basis"][-1])
            for _ in range(2):
                for b in s["basis"]:
                    v = v - (v @ b) * b
            beta = float(np.linalg.norm(v))
            s["steps"].append((alpha, beta))
            value, error = largest_eigenvalue(s["steps"])
            s["top"], s["done"] = value, error <= 1e-13 * abs(value) or beta == 0
            s["basis"].append(v / beta if beta else v)
    out = [(t[group], t["trace"] / state[t[group]]["top"] if state.get(t[group], {}).get("top", 0.0) > 0 else None, t["n_trials"]) for t in totals]
    return spark.createDataFrame(out, f"{group} {kind}, effective_n double, n_trials long")


def overfit_diagnostics(ranked: DataFrame, test_eval: DataFrame) -> DataFrame:
    """How far the training winner stands out and how much of it survives on the test window."""
    from tidepanel.operators.scoring import rank_descending

    spread = ranked.agg(F.avg("resilience_score").alias("train_score_mean"), F.stddev_samp("resilience_score").alias("train_score_std"),
                        F.count(F.lit(1)).alias("n_trials"))
    order = F.struct("train_rank", "mask", "scheme")
    win = test_eval.agg(*[F.min_by(c, order).alias(o) for c, o in (
        ("train_score", "winner_train_score"), ("train_sharpe", "winner_train_sharpe"), ("sharpe_net", "winner_test_sharpe"),
        ("train_both_down_ann", "winner_train_both_down"), ("both_down_annualized", "winner_test_both_down"))])
    ten = test_eval.orderBy("train_rank", "mask", "scheme").limit(10)
    twenty = test_eval.orderBy("test_rank", "mask", "scheme").limit(20)
    shared = ten.join(twenty.select("scheme", "mask"), ["scheme", "mask"], "left_semi").agg(
        (F.count(F.lit(1)) / 10.0).alias("top10_train_in_top20_test"))
    ranks = rank_average(rank_average(test_eval.select("scheme", "mask", "train_score", "test_score"), "train_score", "ra"), "test_score", "rb")
    rho = ranks.agg(correlation(F.col("ra"), F.col("rb")).alias("spearman_train_test_score"))
    out = spread
    for part in (win, shared, rho):
        out = out.withColumn("one", F.lit(1)).join(part.withColumn("one", F.lit(1)), "one").drop("one")
    return (out.withColumn("winner_train_score_z", (F.col("winner_train_score") - F.col("train_score_mean"))
                           / F.greatest("train_score_std", F.lit(1e-9)))
            .withColumn("winner_sharpe_degradation", F.col("winner_test_sharpe") - F.col("winner_train_sharpe"))
            .withColumn("winner_both_down_degradation", F.col("winner_test_both_down") - F.col("winner_train_both_down")))


def rank_average(df: DataFrame, value: str, out: str) -> DataFrame:
    from tidepanel.functions.ranks import percentile_average, value_ranks

    v = F.round(F.col(value), 8)
    df = df.withColumn("_v", F.when(v == 0, 0.0).otherwise(v))
    ranks = value_ranks(df, [], "_v").select("_v", (percentile_average() * F.col("n_total")).alias(out))
    return df.join(ranks, "_v").drop("_v")
