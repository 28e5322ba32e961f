"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
``grid`` is the widest run: every allowed portfolio under all 50 schemes over the full window,
scored and ranked (140,850 trials).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepanel.plans import fixtures as fx, load_all  # noqa: E402
from tidepanel.plans.registry import QUERIES  # noqa: E402
from tidepanel.plans.selection_queries import ranked  # noqa: E402
from tidepanel.session import build_session  # noqa: E402

HEADLINE = ["flagship", "ret_panel", "composite_class", "coverage_monthly", "ret_daily", "audit_internal_null", "audit_summary",
            "sig_asym_ma", "sig_asym_vol", "season_means", "pct_rank_avg", "cov_shrunk", "w_invvol", "w_minvar", "bt_ew", "bt_flavor_hedge",
            "bootstrap_ci", "effective_n", "test_eval", "walk_forward", "rolling_select"]


def grid(spark, sf_dir):
    return ranked(spark, sf_dir, fx.SCHEMES, "asymmetric2", spans=(fx.FULL,))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    runs = {**{name: QUERIES[name] for name in HEADLINE}, "grid": grid}
    wanted = sys.argv[1:]
    seconds = {}
    for name, run in runs.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
