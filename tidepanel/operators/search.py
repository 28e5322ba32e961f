"""The portfolio search: trials -> metrics -> score -> rank, for any number of windows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators.metrics import Windows, diversification_ratio, trial_metrics
from tidepanel.operators.schemes import Scheme
from tidepanel.operators.scoring import score_and_rank
from tidepanel.operators.trials import LAID_OUT, TRIAL_KEYS, TrialPlan, TrialSettings, plan_trials
from tidepanel.operators.universe import Roster
from tidepanel.operators.weights import equal_weight
from tidepanel.session import materialize


def plan_metrics(plan: TrialPlan, crisis: Windows | None = None) -> DataFrame:
    """Metrics of every planned trial. Each branch keeps its layout, so nothing is shuffled after it."""
    parts = [trial_metrics(b, LAID_OUT, crisis).drop("slot").withColumn("n_sleeves", F.bit_count("mask")) for b in plan.branches]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def diversification(plan: TrialPlan, combos: DataFrame, schemes: Sequence[Scheme],
                    weights: DataFrame | None = None) -> DataFrame:
    """Diversification ratio at the last refit that has a covariance, for the covariance schemes."""
    last = plan.cov.groupBy("window_id").agg(F.max("refit_no").alias("refit_no"))
    parts = []
    names = [s.name for s in schemes if s.base == "ew" and not s.flavor and not s.gate_mode]
    if names:
        parts.append(equal_weight(combos, plan.roster).join(F.broadcast(last), "window_id")
                     .withColumn("scheme", F.explode(F.array(*[F.lit(x) for x in names]))))
    by_base = {s.base: s.name for s in schemes if s.base != "ew" and not s.flavor}
    if weights is not None and by_base:
        name = F.create_map(*[F.lit(x) for pair in by_base.items() for x in pair])
        parts.append(weights.join(F.broadcast(last), ["window_id", "refit_no"])
                     .withColumn("scheme", F.element_at(name, F.col("base"))).where(F.col("scheme").isNotNull()))
    out = None
    for part in parts:
        part = diversification_ratio(part, plan.cov, plan.roster).select(*TRIAL_KEYS, "div_ratio")
        out = part if out is None else out.unionByName(part)
    return out


def search(returns: DataFrame, windows: DataFrame, roster: Roster, schemes: Sequence[Scheme],
           settings: TrialSettings, context: DataFrame, mode: str, crisis: Windows | None = None,
           available: dict[int, int] | None = None, common: bool = False, also: DataFrame | None = None) -> DataFrame:
    """Every trial of every window with metrics, score and rank (ranked within its window).

    The metrics are written to a table before ranking: the backtest runs once, and the
    ranking reads a table of one row per trial.
    """
    plan = plan_trials(returns, windows, roster, schemes, settings, context, available=available, common=common, also=also)
    metrics = plan_metrics(plan, crisis)
    if plan.cov is not None and plan.combos is not None:
        ratio = diversification(plan, plan.combos, schemes, plan.weights)
        metrics = metrics.join(ratio, TRIAL_KEYS, "left") if ratio is not None else metrics.withColumn("div_ratio", F.lit(None).cast("double"))
    else:
        metrics = metrics.withColumn("div_ratio", F.lit(None).cast("double"))
    return score_and_rank(materialize(metrics), TRIAL_KEYS, mode, ["window_id"])


def winners(ranked: DataFrame, groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """Best trial per group; ties go to the smaller (mask, scheme). An aggregate, so it combines map-side."""
    best = ranked.groupBy(*groups).agg(F.min(F.struct("rank", "mask", "scheme")).alias("best"))
    return ranked.join(best.select(*groups, F.col("best.mask").alias("mask"), F.col("best.scheme").alias("scheme")),
                       list(dict.fromkeys([*groups, "mask", "scheme"])), "left_semi")


def top(ranked: DataFrame, n: int) -> DataFrame:
    """The ``n`` best trials, ties by (mask, scheme): a bounded top-k, not a global sort."""
    return ranked.orderBy("rank", "mask", "scheme").limit(n)


def evaluate(returns: DataFrame, windows: DataFrame, chosen: DataFrame, roster: Roster,
             schemes: Sequence[Scheme], settings: TrialSettings, context: DataFrame) -> TrialPlan:
    """Backtest given ``(window_id, scheme, mask)`` rows on other windows, roles and costs always passed."""
    return plan_trials(returns, windows, roster, schemes, settings, context, only=materialize(chosen))
