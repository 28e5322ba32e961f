"""Percentile scores and ranks of trials.

Metrics are rounded to 1e-8 before ranking, so trials that are equal in exact arithmetic tie
whatever the order their months were summed in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.ranks import competition_rank_desc, percentile_average, value_ranks
from tidepanel.functions.scalar import zero_if_null
from tidepanel.session import materialize

DIGITS = 8

# Score weights. A leading minus ranks the metric downwards.
SCORES: dict[str, dict[str, float]] = {
    "v1": {"sharpe_net": 0.40, "both_down_annualized": 0.40, "-max_drawdown": 0.20},
    "default": {"sharpe_net": 0.30, "both_down_annualized": 0.25, "-max_drawdown": 0.15,
                "div_ratio": 0.15, "-corr_eq_bothdown": 0.15},
    "asymmetric": {"sharpe_net": 0.30, "updown_beta_diff": 0.20, "-downside_corr_eq": 0.20,
                   "both_down_annualized": 0.15, "-max_drawdown": 0.15},
    "asymmetric2": {"ann_return_net": 0.30, "upside_beta": 0.20, "-downside_beta": 0.15,
                    "-downside_corr_eq": 0.10, "sharpe_net": 0.15, "-max_drawdown": 0.10},
    "seasons": {"season_GrowthDown_InfUp": 0.35, "season_GrowthUp_InfUp": 0.15, "season_GrowthUp_InfDown": 0.15,
                "season_GrowthDown_InfDown": 0.15, "sharpe_net": 0.10, "div_ratio": 0.10},
}


def metric_value(term: str) -> Column:
    """The term as a number that is better when larger."""
    name = term.lstrip("-")
    x = F.round(F.col(name).cast("double"), DIGITS)
    # 0.0 and -0.0 would form two groups of one value.
    return F.when(x == 0, 0.0).otherwise(-x if term.startswith("-") else x)


def quick_score(mode: str, missing_is_zero: bool = False) -> Column:
    """Raw linear sum of the score terms, without ranking."""
    total = F.lit(0.0)
    for term, weight in SCORES[mode].items():
        x = F.col(term.lstrip("-"))
        x = zero_if_null(x) if missing_is_zero else x
        total = total + F.lit(weight) * (-x if term.startswith("-") else x)
    return total


def score(trials: DataFrame, keys: Sequence[str], mode: str, groups: Sequence[str] = ()) -> DataFrame:
    """``(*keys, score)``: weighted percentile ranks within ``groups``; a missing term scores 0.

    ``trials`` should be materialised: it is read once to rank and once to join the ranks back.
    """
    weights = SCORES[mode]
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"), metric_value(t).alias("value"))
                      for t, w in weights.items()])
    by = list(groups)
    melted = trials.select(*keys, F.explode(terms).alias("e")).select(*keys, "e.*")
    ranks = value_ranks(melted, [*by, "term"], "value").select(*by, "term", "value", percentile_average().alias("pct"))
    joined = melted.join(ranks, [*by, "term", "value"], "left")
    return joined.groupBy(*keys).agg(
        F.when(F.count("pct") == len(weights), 100 * F.sum(F.col("weight") * F.col("pct"))).otherwise(0.0).alias("score"))


def rank_descending(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Competition rank of a column, 1 = largest, within ``groups``."""
    by = list(groups)
    v = F.round(F.col(value), DIGITS)
    df = df.withColumn("_v", F.when(v == 0, 0.0).otherwise(v))
    ranks = value_ranks(df, by, "_v").select(*by, "_v", competition_rank_desc().alias(out))
    return df.join(ranks, [*by, "_v"]).drop("_v")


def score_and_rank(trials: DataFrame, keys: Sequence[str], mode: str, groups: Sequence[str] = ()) -> DataFrame:
    """The trials with ``resilience_score`` and ``rank``."""
    scored = materialize(score(trials, keys, mode, groups).withColumnRenamed("score", "resilience_score"))
    ranked = rank_descending(scored, "resilience_score", groups)
    return trials.join(ranked, list(keys))
