"""Rosters, windows and references the registered queries run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.operators import regimes, returns as rt
from tidepanel.operators.schemes import all_schemes
from tidepanel.operators.trials import TrialSettings
from tidepanel.operators.universe import Roster, windows_frame
from tidepanel.sources import panels
from tidepanel.session import materialize

# The brand panel plays the asset classes, four series per role.
EQUITY = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")
BONDS = ("Brand#5", "Brand#6", "Brand#7", "Brand#8")
OTHERS = ("Brand#9", "Brand#10", "Brand#11", "Brand#12")
ROSTER = Roster(EQUITY + BONDS + OTHERS, EQUITY, BONDS,
                inflation_proxies=("Commodities", "Brand#9", "Brand#10"),
                equity_proxies=("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
EQUITY_REFERENCE = (*EQUITY, "Brand#13")
BOND_REFERENCE = (*BONDS, "Brand#14")

SCHEMES = all_schemes(short_name="Brand#5")
BY_NAME = {s.name: s for s in SCHEMES}
EW_SCHEMES = tuple(s for s in SCHEMES if s.base == "ew")

FULL = ("1995-02-28", "2001-10-31")
TRAIN = ("1998-02-28", "1999-12-31")
TEST = ("2000-01-31", "2001-10-31")
CRISES = {
    "w1": ("1996-03-31", "1996-08-31"),
    "w2": ("1998-01-31", "1998-04-30"),
    "w3": ("2000-06-30", "2000-12-31"),
}
SETTINGS = TrialSettings(cap=0.35, cost_bps=10.0, lev_rate=0.058, trailing=36, min_sleeves=5, max_sleeves=8)
STATIC = {"Brand#1": 0.30, "Brand#5": 0.55, "Brand#9": 0.075, "Brand#10": 0.075}
YIELD_ENTITY = "1-URGENT"


def brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null monthly brand returns, materialised: the raw tables are read once per query."""
    return materialize(rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir))))


def references(returns: DataFrame) -> DataFrame:
    return regimes.with_both_down(regimes.basket_references(returns, EQUITY_REFERENCE, BOND_REFERENCE))


def labels(spark: SparkSession, sf_dir: str, returns: DataFrame) -> DataFrame:
    return regimes.regime_labels(returns, panels.priority_month(spark, sf_dir), EQUITY[0], YIELD_ENTITY)


def context(spark: SparkSession, sf_dir: str, returns: DataFrame) -> DataFrame:
    """References and season per period (one row per month)."""
    season = labels(spark, sf_dir, returns).select("period", "season")
    return materialize(references(returns).join(season, "period", "left"))


def window(spark: SparkSession, *spans: tuple[str, str]) -> DataFrame:
    return windows_frame(spark, [(i, a, b) for i, (a, b) in enumerate(spans)])
