"""Panels over a dimension: one level per period and entity, without grouping the facts by key before the join."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import panels


@pytest.mark.parametrize("small", [True, False])
def test_facts_meet_their_dimension_ungrouped(spark, monkeypatch, small):
    """A key with a third of the facts, keys without a dimension row, null keys and prices."""
    made = []
    monkeypatch.setattr(panels, "materialize", lambda df: made.append(df) or df)
    monkeypatch.setattr(panels, "within", lambda df: small)
    rows = [(None if k % 50 == 7 else 1 if k % 3 == 0 else k % 40, None if k % 11 == 0 else k / 8, datetime.date(1995, 1 + k % 12, 1 + k % 28)) for k in range(3000)]
    facts = spark.createDataFrame(rows, "fk long, price double, day date")
    dim = spark.createDataFrame([(k, f"e{k % 4}") for k in range(30)], "key long, name string")
    got = panels._by_dimension(facts, "fk", "price", F.last_day("day"), dim, "key", "name")
    want = {}
    for key, price, day in rows:
        if key is not None and key < 30:
            cell = want.setdefault(((day.replace(day=28) + datetime.timedelta(4)).replace(day=1) - datetime.timedelta(1), f"e{key % 4}"), [0, 0])
            cell[0] += 0 if price is None else int(price * 100 + 0.5)
            cell[1] += 1
    assert {(r.period, r.entity): r.level for r in got.collect()} == {at: cents / (n * 100) for at, (cents, n) in want.items()}
    plan = made[0]._jdf.queryExecution().sparkPlan().toString()
    join = plan.index("BroadcastHashJoin" if small else "ShuffledHashJoin")
    assert "Aggregate" not in plan[join:] and "SortMergeJoin" not in plan
