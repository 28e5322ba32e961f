"""Walk-forward folds, rolling re-selection and out-of-sample evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.operators.metrics import trial_metrics
from tidepanel.operators.schemes import Scheme
from tidepanel.operators.scoring import score_and_rank
from tidepanel.operators.search import diversification, evaluate, plan_metrics, search, top, winners
from tidepanel.operators.trials import TRIAL_KEYS, TrialPlan, TrialSettings, trial_months
from tidepanel.operators.universe import Roster, month_ends_between
from tidepanel.operators.weights import equal_weight, weight_columns
from tidepanel.session import materialize


def make_folds(spark: SparkSession, returns: DataFrame, start: str, end: str, min_train_years: int,
               test_years: int, step_years: int, snap: bool = True) -> DataFrame:
    """Expanding training windows with the test window after each.

    ``snap`` puts every border on a month-end; without it a border keeps the day of month it was
    counted to, so a window that starts in February loses its last month at each border.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    end_of = F.last_day if snap else (lambda d: d)
    years = int(end[:4]) - int(start[:4]) + 1
    folds = (spark.range(0, years + 1).withColumn("start_d", first)
             .withColumn("train_end", end_of(F.add_months(first, (F.lit(12 * min_train_years - 1)
                                                                 + F.col("id") * 12 * step_years).cast("int"))))
             .withColumn("test_start", end_of(F.add_months("train_end", 1)))
             .withColumn("test_full", end_of(F.add_months("test_start", 12 * test_years - 1)))
             .withColumn("test_end", F.least("test_full", last))
             .where(F.col("test_start") <= last))
    # The first fold that reaches the end is the last one.
    step_back = F.add_months("test_full", -12 * step_years)
    folds = folds.where((F.col("id") == 0) | (end_of(step_back) < last))
    months = returns.select("period").distinct()

    def count(a: str, b: str, out: str) -> DataFrame:
        spans = folds.select("id", F.explode(month_ends_between(F.col(a), F.col(b))).alias("period"))
        return spans.join(F.broadcast(months), "period").groupBy("id").agg(F.count(F.lit(1)).alias(out))

    kept = (folds.join(count("start_d", "train_end", "n_train"), "id").join(count("test_start", "test_end", "n_test"), "id")
            .where((F.col("n_train") >= 24) & (F.col("n_test") >= 6)))
    return kept.select(F.row_number().over(Window.orderBy("id")).alias("window_id"), "start_d", "train_end",
                       "test_start", "test_end", "n_train", "n_test")


def rolling_windows(returns: DataFrame, test_start: str, test_end: str, trailing_years: int) -> DataFrame:
    """Per test year: select on the trailing years before its first month, hold to the year's end."""
    months = returns.select("period").distinct()
    test = months.where(F.col("period").between(F.lit(test_start).cast("date"), F.lit(test_end).cast("date")))
    years = test.groupBy(F.year("period").alias("window_id")).agg(F.max("period").alias("test_end"))
    first = months.groupBy(F.year("period").alias("window_id")).agg(F.min("period").alias("test_start"))
    spans = (years.join(first, "window_id")
             .withColumn("start_d", F.add_months("test_start", -12 * trailing_years))
             .withColumn("train_end", F.last_day(F.add_months("test_start", -1))))
    inside = (spans.select("window_id", F.explode(month_ends_between(F.col("start_d"), F.col("train_end"))).alias("period"))
              .join(F.broadcast(months), "period").groupBy("window_id").agg(F.count(F.lit(1)).alias("n_train")))
    return spans.join(inside, "window_id").where("n_train >= 24").select(
        "window_id", "start_d", "train_end", "test_start", "test_end", "n_train")


def train_windows(folds: DataFrame) -> DataFrame:
    return folds.select("window_id", "start_d", F.col("train_end").alias("end_d"))


def test_windows(folds: DataFrame) -> DataFrame:
    return folds.select("window_id", F.col("test_start").alias("start_d"), F.col("test_end").alias("end_d"))


def select_and_hold(returns: DataFrame, folds: DataFrame, roster: Roster, schemes: Sequence[Scheme],
                    settings: TrialSettings, context: DataFrame, mode: str,
                    also: DataFrame | None = None) -> tuple[DataFrame, DataFrame, TrialPlan]:
    """All folds in one job: search every training window, then hold each winner over its test window.

    ``also``: windows in which a series must be complete to be searched; a winner without data in its test window is not held.

    Returns the winners (with their training metrics), the out-of-sample months and the test plan.
    """
    folds = materialize(folds)
    ranked = search(returns, train_windows(folds), roster, schemes, settings, context, mode, also=also)
    chosen = materialize(winners(ranked))
    plan = evaluate(returns, test_windows(folds), chosen.select(*TRIAL_KEYS), roster, schemes, settings, context)
    return chosen, trial_months(plan), plan


def hold_log(chosen: DataFrame, months: DataFrame) -> DataFrame:
    """One row per fold: the winner, its training score and its test metrics."""
    test = trial_metrics(months, TRIAL_KEYS)
    test = test.select(*TRIAL_KEYS, F.col("n_months").alias("test_months"), F.col("sharpe_net").alias("test_sharpe"),
                       F.col("both_down_annualized").alias("test_both_down_ann"), F.col("max_drawdown").alias("test_maxdd"),
                       F.col("stag_sharpe").alias("test_stag_sharpe"))
    return chosen.select(*TRIAL_KEYS, "n_sleeves", F.col("resilience_score").alias("train_score"),
                         F.col("sharpe_net").alias("train_sharpe")).join(test, TRIAL_KEYS)


def test_of_top(returns: DataFrame, ranked: DataFrame, n: int, test: DataFrame, roster: Roster,
                schemes: Sequence[Scheme], settings: TrialSettings, context: DataFrame, mode: str) -> DataFrame:
    """The ``n`` best training trials on the test window, scored and ranked again among themselves."""
    best = materialize(top(ranked, n))
    plan = evaluate(returns, test, best.select(*TRIAL_KEYS), roster, schemes, settings, context)
    metrics = plan_metrics(plan)
    metrics = with_diversification(metrics, plan, schemes, best)
    scored = score_and_rank(materialize(metrics), TRIAL_KEYS, mode, ["window_id"])
    train = best.select(*TRIAL_KEYS, F.col("rank").alias("train_rank"), F.col("resilience_score").alias("train_score"),
                        F.col("sharpe_net").alias("train_sharpe"), F.col("both_down_annualized").alias("train_both_down_ann"),
                        F.col("max_drawdown").alias("train_maxdd"))
    return (scored.withColumnRenamed("resilience_score", "test_score").withColumnRenamed("rank", "test_rank")
            .join(train, TRIAL_KEYS))


def with_diversification(metrics: DataFrame, plan: TrialPlan, schemes: Sequence[Scheme], only: DataFrame) -> DataFrame:
    if plan.cov is None:
        return metrics.withColumn("div_ratio", F.lit(None).cast("double"))
    ratio = diversification(plan, plan.combos, schemes, plan.weights)
    if ratio is None:
        return metrics.withColumn("div_ratio", F.lit(None).cast("double"))
    return metrics.join(ratio, TRIAL_KEYS, "left")


def last_weights(plan: TrialPlan, chosen: DataFrame, schemes: Sequence[Scheme]) -> DataFrame:
    """Base weights of the chosen trials at the last refit of their window, one row per member."""
    roster = plan.roster
    base = {s.name: s.base for s in schemes}
    lookup = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    wanted = chosen.select(*TRIAL_KEYS).withColumn("base", F.element_at(lookup, F.col("scheme")))
    ew = equal_weight(plan.combos, roster).withColumn("base", F.lit("ew"))
    columns = ["window_id", "mask", "base", *weight_columns(roster)]
    table = ew.select(*columns)
    if plan.weights is not None:
        last = plan.months.groupBy("window_id").agg(F.max("refit_no").alias("refit_no"))
        table = table.unionByName(plan.weights.join(F.broadcast(last), ["window_id", "refit_no"]).select(*columns))
    cells = F.array(*[F.struct(F.lit(x).alias("sleeve"), F.col(f"b_{i}").alias("w"), F.lit(1 << i).alias("bit"))
                      for i, x in enumerate(roster.names)])
    member = F.filter(cells, lambda c: F.col("mask").bitwiseAND(c["bit"]) != 0)
    return (table.join(wanted, ["window_id", "mask", "base"]).select(*TRIAL_KEYS, F.explode(member).alias("e"))
            .select(*TRIAL_KEYS, "e.sleeve", "e.w"))
