"""Command line: python tests/run_checks.py [sf_dir] [name or prefix ...]"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tests.compare import compare, connect  # noqa: E402
from tidepanel.session import build_session  # noqa: E402
import __spark_entry__ as entry_module  # noqa: E402


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = build_session("local[8]", **{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    failed = []
    for name, run in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                kind = "sql"
            else:
                problems = [] if df.count() else ["no rows"]
                kind = "rows"
        except Exception as error:  # report and go on with the next query
            problems, kind = [f"{type(error).__name__}: {str(error)[:600]}"], "err"
        print(f"{'ok  ' if not problems else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:900], flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(main(sf, args))
