"""Data-quality audit. Each check returns ``(severity, check, detail)`` rows.

Checks count or compare inside aggregates, so a check over any volume ends in one row; the
only per-series windows run over one entity's own dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.functions.scalar import safe_div
from tidepanel.operators import returns as rt
from tidepanel.operators.metrics import correlation

BLOCK = 1_000_000


def finding(check: str, ok: Column, bad: str, detail: Column) -> list[Column]:
    return [F.when(ok, "PASS").otherwise(bad).alias("severity"), F.lit(check).alias("check"), detail.alias("detail")]


def text(pattern: str, *columns: Column | str) -> Column:
    return F.format_string(pattern, *columns)


def a1_sorted(rows: DataFrame, arrival: str, period: str) -> DataFrame:
    """Is ``period`` non-decreasing along ``arrival``? Compared inside blocks of arrival numbers,
    then across block borders, so no task sees more than one block or the list of blocks."""
    block = F.floor(F.col(arrival) / BLOCK)
    df = rows.select(F.col(arrival).alias("k"), F.col(period).alias("p"), block.alias("block"))
    step = Window.partitionBy("block").orderBy("k")
    inside = (df.withColumn("bad", (F.lag("p").over(step) > F.col("p")).cast("bigint"))
              .groupBy("block").agg(F.sum(F.coalesce("bad", F.lit(0))).alias("bad"),
                                    F.min_by("p", "k").alias("first"), F.max_by("p", "k").alias("last")))
    borders = inside.withColumn("bad", F.col("bad") + F.coalesce(
        (F.lag("last").over(Window.orderBy("block")) > F.col("first")).cast("bigint"), F.lit(0)))
    return borders.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("n")).select(
        *finding("A1 index sorted", F.col("n") == 0, "FAIL", text("%d inversions", F.col("n"))))


def a2_unique(panel: DataFrame, check: str = "A2 keys unique") -> DataFrame:
    dup = panel.groupBy("period", "entity").count().where("count > 1")
    return dup.agg(F.count(F.lit(1)).alias("n")).select(
        *finding(check, F.col("n") == 0, "FAIL", text("%d duplicate keys", F.col("n"))))


def a4_universe(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Entities of the panel against the universe: missing ones fail, extra ones warn."""
    have, want = panel.select("entity").distinct(), dim.select("entity").distinct()
    missing, extra = want.join(have, "entity", "left_anti"), have.join(want, "entity", "left_anti")
    row = lambda df, check, bad: df.agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first")).select(
        *finding(check, F.col("n") == 0, bad, text("%d entities, first %s", F.col("n"), F.coalesce("first", F.lit("none")))))
    return row(missing, "A4 entities missing", "FAIL").unionByName(row(extra, "A4 entities extra", "WARN"))


def a5_columns(spark: SparkSession, have: Sequence[str], need: Sequence[str]) -> DataFrame:
    absent = sorted(set(need) - set(have))
    return spark.range(1).select(*finding("A5 required columns", F.lit(not absent), "FAIL",
                                          F.lit("missing " + (",".join(absent) or "none"))))


def b1_with_data(panel: DataFrame, minimum: int) -> DataFrame:
    n = panel.groupBy("entity").agg(F.count("level").alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("full"), F.count(F.lit(1)).alias("all")).select(
        *finding("B1 series with data", F.col("full") >= minimum, "WARN", text("%d/%d", F.col("full"), F.col("all"))))


def b2_expected_empty(panel: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Only the expected series hold no value."""
    n = panel.groupBy("entity").agg(F.count("level").alias("n"))
    known = F.col("entity").isin(list(expected))
    return n.agg(F.count_if((F.col("n") == 0) & ~known).alias("other"),
                 F.count_if((F.col("n") == 0) & known).alias("known")).select(
        *finding("B2 only expected empty", (F.col("other") == 0) & (F.col("known") == len(expected)), "WARN",
                 text("%d unexpected, %d expected", F.col("other"), F.col("known"))))


def b3_gaps(panel: DataFrame, min_rows: int = 50, max_days: int = 7, allowed: int = 5) -> DataFrame:
    """Series of at least ``min_rows`` with more than ``allowed`` gaps longer than ``max_days``."""
    df = panel.where(F.col("level").isNotNull())
    gaps = (df.withColumn("gap", F.datediff("period", F.lag("period").over(rt.by_entity())))
            .groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > max_days).alias("big"),
                                   F.max("gap").alias("longest")))
    issues = gaps.where((F.col("n") >= min_rows) & (F.col("big") > allowed))
    worst = F.max(F.struct("big", "longest", "entity"))
    return issues.agg(F.count(F.lit(1)).alias("n"), worst.alias("w")).select(
        *finding("B3 internal gaps", F.col("n") == 0, "WARN",
                 F.when(F.col("n") == 0, "none").otherwise(
                     text("%d series; worst %s (%d gaps, max %dd)", F.col("n"), F.col("w.entity"), F.col("w.big"), F.col("w.longest")))))


def b4_shared_start(panel: DataFrame, after: str, minimum: int = 8) -> DataFrame:
    first = panel.where(F.col("level").isNotNull()).groupBy("entity").agg(F.min("period").alias("first"))
    clusters = (first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
                .where((F.col("n") >= minimum) & (F.col("first") > F.lit(after).cast("date"))))
    return clusters.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most")).select(
        *finding("B4 shared start", F.col("k") == 0, "WARN",
                 text("%d dates, largest %d", F.col("k"), F.coalesce("most", F.lit(0)))))


def b5_month_vs_daily(monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """Month table against the last daily level: >2 % apart on >5 % of at least 10 common months."""
    last = rt.month_end_levels(daily).withColumnRenamed("level", "daily_level")
    df = monthly.where(F.col("level").isNotNull()).join(last, ["period", "entity"])
    apart = safe_div(F.abs(F.col("level") - F.col("daily_level")), F.abs("level")) > 0.02
    per = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(apart).alias("bad")).where("n >= 10")
    return per.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("bad") > F.col("n") * 0.05).alias("off")).select(
        *finding("B5 month equals resampled daily", F.col("off") == 0, "WARN", text("%d/%d diverge", F.col("off"), F.col("checked"))))


def c1_values(panel: DataFrame) -> DataFrame:
    """Negative, zero, huge and tiny levels, counted in one pass."""
    x = F.col("level")
    counts = panel.agg(F.count_if(x < 0).alias("c1"), F.count_if(x == 0).alias("c1b"), F.count_if(x > 1e8).alias("c1c"),
                       F.count_if((x > 0) & (x < 1e-4)).alias("c1d"))
    rows = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(bad).alias("bad"), F.col(c).alias("n")) for check, bad, c in (
        ("C1 negative levels", "FAIL", "c1"), ("C1b zero levels", "WARN", "c1b"),
        ("C1c levels above 1e8", "WARN", "c1c"), ("C1d levels below 1e-4", "WARN", "c1d"))])
    return counts.select(F.explode(rows).alias("e")).select(
        F.when(F.col("e.n") == 0, "PASS").otherwise(F.col("e.bad")).alias("severity"), "e.check",
        text("%d cells", F.col("e.n")).alias("detail"))


def c2_extreme(panel: DataFrame, limit: float = 0.5) -> DataFrame:
    """Returns beyond the limit, and the five series with most of them (one bounded row)."""
    r = rt.simple_returns(panel)
    per = r.groupBy("entity").agg(F.count_if(F.abs("ret") > limit).alias("n")).where("n > 0")
    top = per.orderBy(F.desc("n"), "entity").limit(5)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "entity", "n"))).alias("l"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    names = F.array_join(F.transform("l", lambda e: F.concat(e["entity"], F.lit("="), e["n"])), ",")
    return total.withColumn("one", F.lit(1)).join(listed.withColumn("one", F.lit(1)), "one").select(
        *finding("C2 extreme returns", F.col("n") == 0, "WARN", F.concat(text("%d cells; top ", F.col("n")), names)))


def c3_internal_null(panel: DataFrame) -> DataFrame:
    """Calendar periods without a value between the first and the last value of a series."""
    cal = rt.calendar(panel).select("period", "cal_idx")
    spans = (panel.where(F.col("level").isNotNull()).join(F.broadcast(cal), "period")
             .groupBy("entity").agg((F.max("cal_idx") - F.min("cal_idx") + 1 - F.count(F.lit(1))).alias("holes")))
    return spans.agg(F.sum("holes").alias("n")).select(
        *finding("C3 holes inside active span", F.col("n") == 0, "WARN", text("%d cells", F.col("n"))))


def d_returns(stored: DataFrame, levels: DataFrame, check: str, min_rows: int) -> DataFrame:
    """Stored returns against recomputed ones, over every series with ``min_rows`` common rows."""
    again = rt.own_row_returns(levels).where(F.col("ret").isNotNull()).withColumnRenamed("ret", "again")
    per = (stored.where(F.col("ret").isNotNull()).join(again, ["period", "entity"]).groupBy("entity")
           .agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("ret") - F.col("again"))).alias("gap")).where(F.col("n") >= min_rows))
    return per.agg(F.count_if(F.col("gap") > 1e-9).alias("bad"), F.count(F.lit(1)).alias("n")).select(
        *finding(check, F.col("bad") == 0, "FAIL", text("%d/%d mismatch", F.col("bad"), F.col("n"))))


def d3_twins(panel: DataFrame, pairs: DataFrame, min_rows: int = 100) -> DataFrame:
    """Listed pairs that should move together, and a summary row. ``pairs``: (a, b, corr_min, max_diff_pct).

    A pair with a missing series or fewer than ``min_rows`` common returns has no row; the summary counts it as n/a.
    """
    lv = panel.where(F.col("level").isNotNull())
    both = (F.broadcast(pairs).join(lv.select("period", F.col("entity").alias("a"), F.col("level").alias("la")), "a")
            .join(lv.select("period", F.col("entity").alias("b"), F.col("level").alias("lb")), ["period", "b"]))
    order = Window.partitionBy("a", "b").orderBy("period")
    ret = lambda c: safe_div(F.col(c), F.lag(c).over(order)) - 1
    df = both.withColumn("ra", ret("la")).withColumn("rb", ret("lb"))
    per = df.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("ra"), F.col("rb")).alias("corr"),
        (F.max(F.abs(F.col("ra") - F.col("rb"))) * 100).alias("diff")).where(F.col("n") >= min_rows)
    ok = F.coalesce((F.col("corr") >= F.col("corr_min")) & (F.col("diff") <= F.col("max_diff_pct")), F.lit(False))
    judged = pairs.join(per, ["a", "b"], "left").withColumn("ok", F.when(F.col("n").isNotNull(), ok))
    rows = judged.where("ok IS NOT NULL").select(*finding("D3 twins", F.col("ok"), "WARN", text(
        "%s/%s corr=%.4f maxdiff=%.3f%%", F.col("a"), F.col("b"), F.col("corr"), F.col("diff"))))
    counts = judged.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("off"), F.count_if(F.col("ok").isNull()).alias("na"))
    return rows.unionByName(counts.select(*finding("D3 twins summary", F.col("off") == 0, "WARN", text(
        "%d match, %d differ, %d n/a", F.col("good"), F.col("off"), F.col("na")))))


def d4_growth(panel: DataFrame, bigger: str, smaller: str) -> DataFrame:
    """Growth of one series should not trail another over their common dates."""
    of = lambda name: F.max(F.when(F.col("entity") == name, F.col("level")))
    common = (panel.where(F.col("entity").isin(bigger, smaller)).groupBy("period").agg(of(bigger).alias("x"), of(smaller).alias("y"))
              .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    g = common.agg(safe_div(F.max_by("x", "period"), F.min_by("x", "period")).alias("gx"),
                   safe_div(F.max_by("y", "period"), F.min_by("y", "period")).alias("gy"))
    return g.select(*finding("D4 growth order", F.col("gx") >= F.col("gy"), "WARN",
                             text("%s %.3f vs %s %.3f", F.lit(bigger), F.col("gx"), F.lit(smaller), F.col("gy"))))


def e1_bounds(coverage: DataFrame) -> DataFrame:
    r, p = F.col("ann_return_pct"), F.col("pct_positive")
    ok = [F.col("ann_vol_pct") >= 0, (p >= 0) & (p <= 100), (r > -60) & (r < 250)]
    broken = [F.max(F.when(~F.coalesce(x, F.lit(True)), 1).otherwise(0)) for x in ok]
    return coverage.agg((broken[0] + broken[1] + broken[2]).alias("n")).select(
        *finding("E1 coverage bounds", F.col("n") == 0, "FAIL", text("%d violations", F.col("n"))))


def e2_rows(coverage: DataFrame, stored: DataFrame) -> DataFrame:
    a = coverage.agg(F.count(F.lit(1)).alias("rows")).withColumn("one", F.lit(1))
    b = stored.agg(F.count_distinct("entity").alias("entities")).withColumn("one", F.lit(1))
    return a.join(b, "one").select(*finding("E2 coverage rows", F.col("rows") == F.col("entities"), "WARN",
                                            text("%d vs %d", F.col("rows"), F.col("entities"))))


def f1_forbidden(entities: Sequence[DataFrame], forbidden: Sequence[str]) -> DataFrame:
    """Names that must appear in no output."""
    seen = entities[0].select("entity")
    for df in entities[1:]:
        seen = seen.unionByName(df.select("entity"))
    hits = seen.where(F.col("entity").isin(list(forbidden))).distinct()
    return hits.agg(F.count(F.lit(1)).alias("n")).select(
        *finding("F1 forbidden absent", F.col("n") == 0, "FAIL", text(f"{len(forbidden)} expected absent; %d present", F.col("n"))))


def f2_daily_only(daily: DataFrame, monthly: DataFrame, names: Sequence[str]) -> DataFrame:
    """Listed series have daily values and no monthly series."""
    spark = daily.sparkSession
    listed = spark.createDataFrame([(x,) for x in names], "entity string")
    has = daily.where(F.col("level").isNotNull()).select("entity").distinct().withColumn("d", F.lit(True))
    month = monthly.select("entity").distinct().withColumn("m", F.lit(True))
    df = listed.join(has, "entity", "left").join(month, "entity", "left")
    ok = F.coalesce("d", F.lit(False)) & F.col("m").isNull()
    return df.select(*finding("F2 daily only", ok, "WARN", F.col("entity")))


def f3_known_empty(panel: DataFrame, name: str) -> DataFrame:
    n = panel.where(F.col("entity") == name).agg(F.count(F.lit(1)).alias("rows"), F.count("level").alias("n"))
    return n.select(*finding("F3 known empty", (F.col("rows") > 0) & (F.col("n") == 0), "WARN",
                             text("%s holds %d values", F.lit(name), F.col("n"))))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
