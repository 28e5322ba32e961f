"""Every registered query next to its SQL.

The grid searches take minutes, so the default run covers one query of each kind; set
TIDEPANEL_ALL=1 (or use tests/run_checks.py) for all of them.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

# Queries that run a whole grid; the default run takes the ones listed in SAMPLE.
GRID = ("search", "score_", "topk_", "best_per_family", "test_eval", "scheme_comparison", "overfit_diag", "fmt_menu", "gross_cost",
        "walk_forward", "oos_concat", "rolling_select", "avg_fold_weights", "bt_flavor", "bt_minvar", "bt_erc", "bt_inv", "bt_ls",
        "div_ratio", "effective_n", "w_inv", "w_erc", "w_minvar", "solve_weights", "risk_contrib", "menu_")
SAMPLE = {"score_seasons", "bt_flavor_hedge", "bt_flavor_trend", "w_invvar", "search_alt", "oos_concat", "bt_ls_tsmom"}


def chosen():
    everything = os.environ.get("TIDEPANEL_ALL") == "1"
    return [n for n in QUERIES if everything or n in SAMPLE or not n.startswith(GRID)]


@pytest.mark.parametrize("name", chosen())
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) == []
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.dtypes[0] == ("mask", "bigint")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
