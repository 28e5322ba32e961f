"""The audit over the daily and monthly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import audit as au
from tidepanel.operators import returns as rt
from tidepanel.plans.oracle import NATION_DIM, levels, returns, with_
from tidepanel.plans.panel_queries import coverage_sql, nation_dim
from tidepanel.plans.registry import query
from tidepanel.session import materialize
from tidepanel.sources import panels
from tidepanel.sources.panels import table

DAY, MONTH = levels("priority_day"), levels("priority", "mo")
# Pairs (a, b, least correlation, largest return difference in percent).
TWINS = [("1-URGENT", "2-HIGH", -1.0, 2000.0), ("3-MEDIUM", "5-LOW", 0.9, 5.0), ("2-HIGH", "4-NOT SPECIFIED", 0.5, 50.0),
         ("1-URGENT", "7-NEVER", 0.5, 50.0)]
FORBIDDEN = ["6-NONE", "7-NEVER", "5-LOW"]


def finding(check: str, ok: str, bad: str, detail: str) -> str:
    return f"CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS severity, '{check}' AS check, {detail} AS detail"


CHECKS: list[tuple] = []  # every audit query and its SQL, for the tally


def register(name: str, sql: str):
    def wrap(fn):
        CHECKS.append((fn, sql))
        return query(name, sql)(fn)
    return wrap


A1 = ("WITH s AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events), n AS (SELECT count(*) FILTER (p > ts) AS n FROM s) "
      "SELECT " + finding("A1 index sorted", "n = 0", "FAIL", "n || ' inversions'") + " FROM n")


@register("audit_a1", A1)
def audit_a1(spark, sf_dir):
    return au.a1_sorted(table(spark, sf_dir, "events"), "event_id", "ts")


DUP = "SELECT {f} FROM (SELECT count(*) AS n FROM (SELECT period, entity FROM {t} GROUP BY 1, 2 HAVING count(*) > 1))"
A2 = with_(DAY, DUP.format(f=finding("A2 keys unique", "n = 0", "FAIL", "n || ' duplicate keys'"), t="lv"))


@register("audit_a2", A2)
def audit_a2(spark, sf_dir):
    return au.a2_unique(panels.priority_day(spark, sf_dir))


RAW = [("raw", "SELECT last_day(o_orderdate) AS period, o_orderpriority AS entity FROM orders")]


@register("audit_a3", with_(RAW, DUP.format(f=finding("A3 raw keys unique", "n = 0", "FAIL", "n || ' duplicate keys'"), t="raw")))
def audit_a3(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("period"), F.col("o_orderpriority").alias("entity"))
    return au.a2_unique(raw, "A3 raw keys unique")


def _sets(a: str, b: str) -> str:
    return f"SELECT count(*) AS n, min(entity) AS first FROM (SELECT DISTINCT entity FROM {a} EXCEPT SELECT entity FROM {b})"


NDIM = [*levels("nation"), ("dim", f"SELECT entity FROM ({NATION_DIM}) WHERE entity <> 'NATION_7' UNION ALL SELECT 'ATLANTIS'")]
A4 = with_([*NDIM, ("x", _sets("dim", "lv")), ("y", _sets("lv", "dim"))],
           "SELECT " + finding("A4 entities missing", "n = 0", "FAIL", "n || ' entities, first ' || coalesce(first, 'none')") + " FROM x UNION ALL "
           "SELECT " + finding("A4 entities extra", "n = 0", "WARN", "n || ' entities, first ' || coalesce(first, 'none')") + " FROM y")


@register("audit_cols_vs_universe", A4)
def audit_cols_vs_universe(spark, sf_dir):
    dim = nation_dim(spark, sf_dir).where(F.col("entity") != "NATION_7").select("entity")
    dim = dim.unionByName(spark.range(1).select(F.lit("ATLANTIS").alias("entity")))
    return au.a4_universe(panels.nation_month(spark, sf_dir), dim)


@register("audit_a5", "SELECT CASE WHEN count(*) = 4 THEN 'PASS' ELSE 'FAIL' END AS severity, 'A5 required columns' AS check, "
          "'missing ' || CASE WHEN count(*) = 4 THEN 'none' ELSE 'some' END AS detail FROM (DESCRIBE SELECT * FROM orders) "
          "WHERE column_name IN ('o_orderkey', 'o_orderdate', 'o_orderpriority', 'o_totalprice')")
def audit_a5(spark, sf_dir):
    have = table(spark, sf_dir, "orders").columns
    return au.a5_columns(spark, have, ["o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"])


EMPTIED = [*levels("nation", "full_lv"), ("lv", "SELECT period, entity, CASE WHEN entity = 'NATION_7' THEN NULL ELSE level END AS level FROM full_lv"),
           ("c", "SELECT entity, count(level) AS n FROM lv GROUP BY 1")]


def emptied(spark, sf_dir):
    lv = panels.nation_month(spark, sf_dir)
    return lv.withColumn("level", F.when(F.col("entity") != "NATION_7", F.col("level")))


@register("audit_b1", with_(EMPTIED, "SELECT " + finding("B1 series with data", "f >= 25", "WARN", "f || '/' || a")
                            + " FROM (SELECT count(*) FILTER (n > 0) AS f, count(*) AS a FROM c)"))
def audit_b1(spark, sf_dir):
    return au.b1_with_data(emptied(spark, sf_dir), 25)


@register("audit_b2", with_(EMPTIED, "SELECT " + finding("B2 only expected empty", "o = 0 AND k = 1", "WARN", "o || ' unexpected, ' || k || ' expected'")
                            + " FROM (SELECT count(*) FILTER (n = 0 AND entity <> 'NATION_7') AS o, count(*) FILTER (n = 0 AND entity = 'NATION_7') AS k FROM c)"))
def audit_b2(spark, sf_dir):
    return au.b2_expected_empty(emptied(spark, sf_dir), ["NATION_7"])


def gap_sql(ctes) -> str:
    return with_([*ctes, ("g", "SELECT entity, date_diff('day', lag(period) OVER (PARTITION BY entity ORDER BY period), period) AS gap FROM lv WHERE level IS NOT NULL"),
                  ("p", "SELECT entity, count(*) AS n, count(*) FILTER (gap > 7) AS big, max(gap) AS longest FROM g GROUP BY 1"),
                  ("i", "SELECT * FROM p WHERE n >= 50 AND big > 5"), ("c", "SELECT count(*) AS n FROM i"),
                  ("w", "SELECT entity, big, longest FROM i ORDER BY big DESC, longest DESC, entity DESC LIMIT 1")],
                 "SELECT " + finding("B3 internal gaps", "n = 0", "WARN",
                                     "CASE WHEN n = 0 THEN 'none' ELSE n || ' series; worst ' || w.entity || ' (' || w.big || ' gaps, max ' || w.longest || 'd)' END")
                 + " FROM c LEFT JOIN w ON true")


@register("audit_gaps", gap_sql(levels("nation")))
def audit_gaps(spark, sf_dir):
    return au.b3_gaps(panels.nation_month(spark, sf_dir))


@register("audit_b4", with_([*levels("nation"), ("f", "SELECT entity, min(period) AS first FROM lv WHERE level IS NOT NULL GROUP BY 1"),
                             ("k", "SELECT first, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 8 AND first > DATE '1994-01-01'")],
                            "SELECT " + finding("B4 shared start", "c = 0", "WARN", "c || ' dates, largest ' || m")
                            + " FROM (SELECT count(*) AS c, coalesce(max(n), 0) AS m FROM k)"))
def audit_b4(spark, sf_dir):
    return au.b4_shared_start(panels.nation_month(spark, sf_dir), "1994-01-01")


@register("audit_b5", with_([*DAY, *MONTH, ("r", "SELECT last_day(period) AS period, entity, arg_max(level, period) AS dl FROM lv GROUP BY 1, 2"),
                             ("p", "SELECT entity, count(*) AS n, count(*) FILTER (abs(level - dl) / abs(level) > 0.02) AS bad FROM mo JOIN r USING (period, entity) GROUP BY 1 HAVING count(*) >= 10")],
                            "SELECT " + finding("B5 month equals resampled daily", "o = 0", "WARN", "o || '/' || c || ' diverge'")
                            + " FROM (SELECT count(*) AS c, count(*) FILTER (bad > n * 0.05) AS o FROM p)"))
def audit_b5(spark, sf_dir):
    return au.b5_month_vs_daily(panels.priority_month(spark, sf_dir), panels.priority_day(spark, sf_dir))


C1 = with_([*DAY, ("c", "SELECT count(*) FILTER (level < 0) AS a, count(*) FILTER (level = 0) AS b, count(*) FILTER (level > 1e8) AS c, "
                   "count(*) FILTER (level > 0 AND level < 1e-4) AS d FROM lv")],
           " UNION ALL ".join("SELECT " + finding(check, f"{x} = 0", bad, f"{x} || ' cells'") + " FROM c" for check, bad, x in (
               ("C1 negative levels", "FAIL", "a"), ("C1b zero levels", "WARN", "b"), ("C1c levels above 1e8", "WARN", "c"),
               ("C1d levels below 1e-4", "WARN", "d"))))


@register("audit_c1", C1)
def audit_c1(spark, sf_dir):
    return au.c1_values(panels.priority_day(spark, sf_dir))


@register("audit_c2", with_([*returns("priority_day"), ("p", "SELECT entity, count(*) AS n FROM ret WHERE abs(ret) > 0.5 GROUP BY 1"),
                             ("t", "SELECT * FROM p ORDER BY n DESC, entity LIMIT 5")],
                            "SELECT " + finding("C2 extreme returns", "n = 0", "WARN", "n || ' cells; top ' || l")
                            + " FROM (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM p), (SELECT coalesce(string_agg(entity || '=' || n, ',' ORDER BY n DESC, entity), '') AS l FROM t)"))
def audit_c2(spark, sf_dir):
    return au.c2_extreme(panels.priority_day(spark, sf_dir))


@register("audit_internal_null", with_(
    [*levels("nation"), ("cal", "SELECT DISTINCT period FROM lv"), ("s", "SELECT entity, min(period) AS a, max(period) AS b FROM lv WHERE level IS NOT NULL GROUP BY 1"),
     ("h", "SELECT s.entity, cal.period FROM s JOIN cal ON cal.period BETWEEN a AND b LEFT JOIN lv ON lv.entity = s.entity AND lv.period = cal.period WHERE lv.level IS NULL")],
    "SELECT " + finding("C3 holes inside active span", "n = 0", "WARN", "n || ' cells'") + " FROM (SELECT count(*) AS n FROM h)"))
def audit_internal_null(spark, sf_dir):
    return au.c3_internal_null(panels.nation_month(spark, sf_dir))


def own(name: str, lv: str) -> tuple[str, str]:
    return (name, f"SELECT period, entity, level / nullif(lag(level) OVER (PARTITION BY entity ORDER BY period), 0) - 1 AS again FROM {lv} WHERE level IS NOT NULL")


ALTERED = "CASE WHEN entity = (SELECT min(entity) FROM ret) AND period = (SELECT max(period) FROM ret WHERE entity = (SELECT min(entity) FROM ret)) THEN ret + 0.01 ELSE ret END"


def d_sql(panel: str, check: str, rows: int) -> str:
    return with_([*returns(panel), ("st", f"SELECT period, entity, {ALTERED} AS ret FROM ret"), own("o", "lv"),
                  ("p", f"SELECT entity, count(*) AS n, max(abs(ret - again)) AS gap FROM st JOIN o USING (period, entity) WHERE again IS NOT NULL GROUP BY 1 HAVING count(*) >= {rows}")],
                 "SELECT " + finding(check, "b = 0", "FAIL", "b || '/' || n || ' mismatch'") + " FROM (SELECT count(*) FILTER (gap > 1e-9) AS b, count(*) AS n FROM p)")


def stored_returns(levels_):
    """A returns table as it would lie in storage, with one wrong value: the last return of the first series."""
    r = rt.non_null(rt.simple_returns(levels_))
    last = r.groupBy("entity").agg(F.max("period").alias("last")).orderBy("entity").limit(1).select(F.col("entity").alias("wrong"), "last")
    hit = (F.col("entity") == F.col("wrong")) & (F.col("period") == F.col("last"))
    return materialize(r.join(F.broadcast(last), F.col("entity") == F.col("wrong"), "left").select(
        "period", "entity", F.when(hit, F.col("ret") + 0.01).otherwise(F.col("ret")).alias("ret")))


@register("audit_d1", d_sql("priority_day", "D1 daily return equals recomputed", 50))
def audit_d1(spark, sf_dir):
    lv = panels.priority_day(spark, sf_dir)
    return au.d_returns(stored_returns(lv), lv, "D1 daily return equals recomputed", 50)


@register("audit_d2", d_sql("nation", "D2 monthly return equals recomputed", 20))
def audit_d2(spark, sf_dir):
    lv = panels.nation_month(spark, sf_dir)
    return au.d_returns(stored_returns(lv), lv, "D2 monthly return equals recomputed", 20)


TWIN_ROWS = ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in TWINS)


@register("audit_d3", with_(
    [*DAY, ("t", f"SELECT * FROM (VALUES {TWIN_ROWS}) v(a, b, cm, md)"),
     ("j", "SELECT a, b, cm, md, x.level / lag(x.level) OVER w - 1 AS ra, y.level / lag(y.level) OVER w - 1 AS rb FROM t JOIN lv x ON x.entity = a "
      "JOIN lv y ON y.entity = b AND y.period = x.period WINDOW w AS (PARTITION BY a, b ORDER BY x.period)"),
     ("p", "SELECT a, b, cm, md, count(*) AS n, covar_samp(ra, rb) / (stddev_samp(ra) * stddev_samp(rb)) AS c, max(abs(ra - rb)) * 100 AS d FROM j GROUP BY 1, 2, 3, 4 HAVING count(*) >= 100")],
    "SELECT " + finding("D3 twins", "c >= cm AND d <= md", "WARN", "printf('%s/%s corr=%.4f maxdiff=%.3f%%', a, b, c, d)") + " FROM p UNION ALL "
    "SELECT " + finding("D3 twins summary", "w = 0", "WARN", "g || ' match, ' || w || ' differ, ' || (t - g - w) || ' n/a'")
    + " FROM (SELECT count(*) FILTER (c >= cm AND d <= md) AS g, count(*) FILTER (NOT coalesce(c >= cm AND d <= md, false)) AS w FROM p), (SELECT count(*) AS t FROM t)"))
def audit_d3(spark, sf_dir):
    pairs = spark.createDataFrame(TWINS, "a string, b string, corr_min double, max_diff_pct double")
    return au.d3_twins(panels.priority_day(spark, sf_dir), pairs)


@register("audit_d4", with_(
    [*MONTH, ("c", "SELECT period, max(level) FILTER (entity = '1-URGENT') AS x, max(level) FILTER (entity = '5-LOW') AS y FROM mo GROUP BY 1"),
     ("g", "SELECT arg_max(x, period) / arg_min(x, period) AS gx, arg_max(y, period) / arg_min(y, period) AS gy FROM c WHERE x IS NOT NULL AND y IS NOT NULL")],
    "SELECT " + finding("D4 growth order", "gx >= gy", "WARN", "printf('1-URGENT %.3f vs 5-LOW %.3f', gx, gy)") + " FROM g"))
def audit_d4(spark, sf_dir):
    return au.d4_growth(panels.priority_month(spark, sf_dir), "1-URGENT", "5-LOW")


COVER = [*returns("event_day"), ("cov", coverage_sql("entity", "ret", 252, True))]


@register("audit_e1", with_(COVER, "SELECT " + finding("E1 coverage bounds", "n = 0", "FAIL", "n || ' violations'")
                            + " FROM (SELECT max(CASE WHEN ann_vol_pct < 0 THEN 1 ELSE 0 END) + max(CASE WHEN pct_positive < 0 OR pct_positive > 100 THEN 1 ELSE 0 END) "
                            "+ max(CASE WHEN ann_return_pct <= -60 OR ann_return_pct >= 250 THEN 1 ELSE 0 END) AS n FROM cov)"))
def audit_e1(spark, sf_dir):
    return au.e1_bounds(rt.coverage(rt.simple_returns(panels.event_day(spark, sf_dir)), ["entity"], 252))


@register("audit_coverage_rows", with_(COVER, "SELECT " + finding("E2 coverage rows", "r = e", "WARN", "r || ' vs ' || e")
                                       + " FROM (SELECT count(*) AS r FROM cov), (SELECT count(DISTINCT entity) AS e FROM ret)"))
def audit_coverage_rows(spark, sf_dir):
    r = rt.simple_returns(panels.event_day(spark, sf_dir))
    return au.e2_rows(rt.coverage(r, ["entity"], 252), rt.non_null(r))


@register("audit_f1", with_([*DAY, *MONTH], "SELECT " + finding("F1 forbidden absent", "n = 0", "FAIL", "'3 expected absent; ' || n || ' present'")
                            + " FROM (SELECT count(*) AS n FROM (SELECT entity FROM lv UNION SELECT entity FROM mo) WHERE entity IN ('6-NONE', '7-NEVER', '5-LOW'))"))
def audit_f1(spark, sf_dir):
    return au.f1_forbidden([panels.priority_day(spark, sf_dir), panels.priority_month(spark, sf_dir)], FORBIDDEN)


@register("audit_f2", with_([*DAY, *levels("segment", "mo"), ("n", "SELECT * FROM (VALUES ('1-URGENT'), ('BUILDING')) v(entity)")],
                            "SELECT " + finding("F2 daily only", "entity IN (SELECT entity FROM lv) AND entity NOT IN (SELECT entity FROM mo)", "WARN", "entity") + " FROM n"))
def audit_f2(spark, sf_dir):
    return au.f2_daily_only(panels.priority_day(spark, sf_dir), panels.segment_month(spark, sf_dir), ["1-URGENT", "BUILDING"])


@register("audit_f3", with_(EMPTIED, "SELECT " + finding("F3 known empty", "r > 0 AND n = 0", "WARN", "'NATION_7 holds ' || n || ' values'")
                            + " FROM (SELECT count(*) AS r, count(level) AS n FROM lv WHERE entity = 'NATION_7')"))
def audit_f3(spark, sf_dir):
    return au.f3_known_empty(emptied(spark, sf_dir), "NATION_7")


TALLY = [*CHECKS]


@query("audit_summary", "SELECT severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM ({sql})" for _, sql in TALLY) + ") GROUP BY 1")
def audit_summary(spark, sf_dir):
    """The tally over every finding of every check; the checks share their panels."""
    with panels.shared():
        parts = [run(spark, sf_dir).select("severity", "check", "detail") for run, _ in TALLY]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return au.summary(out)
