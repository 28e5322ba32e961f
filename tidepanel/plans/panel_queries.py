"""Sources, filters, returns, composites and coverage over the whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators import returns as rt
from tidepanel.operators.universe_tables import flatten_members, merge_universe
from tidepanel.plans import fixtures as fx
from tidepanel.plans.oracle import NATION_DIM, levels, names, q, returns, with_
from tidepanel.plans.registry import query
from tidepanel.session import shared_folder
from tidepanel.sources import files, panels
from tidepanel.sources.panels import table

NATIONS = [f"NATION_{i}" for i in range(25)]
# The order priorities, columns of the pivoted matrix.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def nation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key, region = F.col("n_regionkey"), F.col("r_name")
    sector = F.when(key == 0, F.concat(F.lit("Sector-"), region)).otherwise(region)
    asset = F.when(key == 0, sector).when(key == 1, "Equity (single stock)").otherwise(region)
    return n.select(F.col("n_name").alias("entity"), F.concat(F.lit("Nation "), F.col("n_nationkey")).alias("name"),
                    asset.alias("asset_class"), sector.alias("sector"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.labelled_panel(rt.simple_returns(panels.nation_month(spark, sf_dir)), nation_dim(spark, sf_dir), "ret")


LABELLED = [*returns("nation"), ("dim", NATION_DIM),
            ("panel", "SELECT period, entity, name, asset_class, sector, ret FROM ret JOIN dim USING (entity)")]


@query("src_unpivot_wide", with_(
    [*levels("nation"), ("p", "SELECT DISTINCT period FROM lv"), ("e", "SELECT n_name AS entity FROM nation")],
    f"SELECT period, entity, {q('level')} AS level FROM p CROSS JOIN e LEFT JOIN lv USING (period, entity)"))
def src_unpivot_wide(spark, sf_dir):
    wide = files.long_to_wide(panels.nation_month(spark, sf_dir), NATIONS)
    return files.wide_to_long(wide)


@query("src_long_select", with_(
    LABELLED, f"SELECT period, entity, {q('ret')} AS ret FROM panel WHERE entity IN {names(NATIONS)}"))
def src_long_select(spark, sf_dir):
    return labelled(spark, sf_dir).select("period", "entity", "ret").where(F.col("entity").isin(NATIONS))


@query("src_pivot", with_(
    returns("priority_day"),
    "SELECT last_day(period) AS period, " + ", ".join(
        q(f"avg(ret) FILTER (entity = '{p}')") + f' AS "{p}"' for p in PRIORITIES) + " FROM ret GROUP BY 1"))
def src_pivot(spark, sf_dir):
    daily = rt.non_null(rt.simple_returns(panels.priority_day(spark, sf_dir)))
    return files.long_to_wide(daily.withColumn("period", F.last_day("period")), PRIORITIES, "ret")


@query("src_snapshot", with_(levels("type"), f"SELECT period, entity, {q('level')} AS level FROM lv"))
def src_snapshot(spark, sf_dir):
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/tidepanel/type_month_{tag}"
    return files.snapshot(spark, path, lambda: panels.type_month(spark, sf_dir)).select("period", "entity", "level")


@query("src_union_batches", with_(
    [*levels("nation", "a"), *levels("segment", "b")],
    f"SELECT period, entity, {q('level')} AS level FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"))
def src_union_batches(spark, sf_dir):
    return panels.nation_month(spark, sf_dir).unionByName(panels.segment_month(spark, sf_dir))


@query("key_month_end", "SELECT last_day(l_shipdate) AS period, count(*) AS n_rows FROM lineitem GROUP BY 1")
def key_month_end(spark, sf_dir):
    return (table(spark, sf_dir, "lineitem").groupBy(F.last_day("l_shipdate").alias("period"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("dedup_keep_first",
       f"SELECT CAST(o_orderdate AS DATE) AS period, o_orderpriority AS entity, {q('arg_min(o_totalprice, o_orderkey)')} AS level "
       "FROM orders GROUP BY 1, 2")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("period"), F.col("o_orderpriority").alias("entity"),
        F.col("o_totalprice").alias("level"), F.col("o_orderkey").alias("arrival"))
    return rt.keep_first(rows, "arrival")


@query("drop_empty_series", with_(
    [*levels("nation"), ("dim", NATION_DIM),
     ("h", "SELECT period, entity, CASE WHEN asset_class = 'Sector-AFRICA' THEN NULL ELSE level END AS level FROM lv JOIN dim USING (entity)")],
    f"SELECT period, entity, {q('level')} AS level FROM h WHERE entity IN (SELECT entity FROM h GROUP BY 1 HAVING count(level) > 0)"))
def drop_empty_series(spark, sf_dir):
    df = panels.nation_month(spark, sf_dir).join(nation_dim(spark, sf_dir), "entity")
    holed = df.select("period", "entity", F.when(F.col("asset_class") != "Sector-AFRICA", F.col("level")).alias("level"))
    return rt.drop_empty(holed)


@query("universe_build",
       "WITH a AS (SELECT p_brand AS entity, max(p_type) AS sector FROM part GROUP BY 1) "
       f"SELECT entity, 'Series ' || entity AS name, CASE WHEN entity IN {names(fx.EQUITY)} THEN 'Equity' "
       f"WHEN entity IN {names(fx.BONDS)} THEN 'Bond' WHEN entity IN {names(fx.OTHERS)} THEN 'Other' "
       f"ELSE 'Equity (single stock)' END AS asset_class, "
       f"CASE WHEN entity IN {names(fx.ROSTER.names)} THEN 'ETF' ELSE sector END AS sector FROM a")
def universe_build(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    by_type = part.groupBy(F.col("p_type").alias("sector")).agg(F.collect_set("p_brand").alias("members"))
    label = lambda df, cls, sector, order: df.select(
        "entity", F.concat(F.lit("Series "), F.col("entity")).alias("name"), cls.alias("asset_class"),
        sector.alias("sector"), order.alias("priority"))
    stocks = label(flatten_members(by_type, "members"), F.lit("Equity (single stock)"), F.col("sector"),
                   F.struct(F.lit(0).alias("source"), F.col("sector").alias("key")))
    roles = (F.when(F.col("entity").isin(*fx.EQUITY), "Equity").when(F.col("entity").isin(*fx.BONDS), "Bond")
             .otherwise("Other"))
    funds = part.select(F.col("p_brand").alias("entity")).where(F.col("entity").isin(*fx.ROSTER.names)).distinct()
    funds = label(funds, roles, F.lit("ETF"), F.struct(F.lit(1).alias("source"), F.lit("").alias("key")))
    return merge_universe([stocks, funds])


@query("augment_sleeve", with_(
    [*returns("brand"), *returns("priority", "extra")],
    f"SELECT period, entity, {q('ret')} AS ret FROM (SELECT period, entity, ret FROM ret UNION ALL "
    "SELECT period, 'TIPS', ret FROM extra WHERE entity = '1-URGENT' AND period IN (SELECT period FROM ret))"))
def augment_sleeve(spark, sf_dir):
    base = rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir)))
    extra = rt.non_null(rt.simple_returns(panels.priority_month(spark, sf_dir)))
    return rt.augment(base, extra, "1-URGENT", "TIPS")


@query("flt_date_slice", with_(
    returns("brand"), f"SELECT period, entity, {q('ret')} AS ret FROM ret "
    f"WHERE period BETWEEN DATE '{fx.FULL[0]}' AND DATE '{fx.FULL[1]}'"))
def flt_date_slice(spark, sf_dir):
    r = rt.non_null(rt.simple_returns(panels.brand_month(spark, sf_dir)))
    return r.where(F.col("period").between(*[F.lit(d).cast("date") for d in fx.FULL]))


SLICE = "period BETWEEN DATE '1995-02-28' AND DATE '2001-07-31'"


@query("panel_complete", with_(
    [*returns("nation"), ("s", f"SELECT * FROM ret_all WHERE {SLICE}"),
     ("ok", "SELECT entity FROM s GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT period) FROM s)")],
    f"SELECT period, entity, {q('ret')} AS ret FROM s WHERE entity IN (SELECT entity FROM ok)"))
def panel_complete(spark, sf_dir):
    return rt.complete_panel(rt.simple_returns(panels.nation_month(spark, sf_dir)), "1995-02-28", "2001-07-31")


def _complete_sql(name: str, span: tuple[str, str]) -> list[tuple[str, str]]:
    where = f"period BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'"
    return [(name, f"SELECT entity FROM ret WHERE {where} GROUP BY 1 HAVING count(ret) = "
                   f"(SELECT count(DISTINCT period) FROM ret WHERE {where})")]


@query("avail_both", with_([*returns("nation"), *_complete_sql("tr", ("1995-02-28", "1998-12-31")),
                            *_complete_sql("te", ("1999-01-31", "2001-07-31"))],
                           "SELECT entity FROM tr INTERSECT SELECT entity FROM te"))
def avail_both(spark, sf_dir):
    r = rt.non_null(rt.simple_returns(panels.nation_month(spark, sf_dir)))
    return rt.complete_entities(r, "1995-02-28", "1998-12-31").intersect(
        rt.complete_entities(r, "1999-01-31", "2001-07-31"))


@query("flt_category", with_(
    LABELLED, f"SELECT period, entity, asset_class, {q('ret')} AS ret FROM panel "
    "WHERE asset_class NOT LIKE 'Sector-%' AND asset_class <> 'Equity (single stock)'"))
def flt_category(spark, sf_dir):
    return labelled(spark, sf_dir).where(rt.is_composite_class(F.col("asset_class"))) \
        .select("period", "entity", "asset_class", "ret")


@query("str_strip_prefix", with_(
    [("dim", NATION_DIM)], "SELECT entity, regexp_replace(sector, '^Sector-', '') AS sector FROM dim"))
def str_strip_prefix(spark, sf_dir):
    return nation_dim(spark, sf_dir).select("entity", rt.sector_name(F.col("sector")).alias("sector"))


@query("ret_monthly", with_(returns("nation"), f"SELECT period, entity, {q('ret')} AS ret FROM ret_all"))
def ret_monthly(spark, sf_dir):
    return rt.simple_returns(panels.nation_month(spark, sf_dir))


@query("ret_daily", with_(returns("priority_day"), f"SELECT period, entity, {q('ret')} AS ret FROM ret_all"))
def ret_daily(spark, sf_dir):
    return rt.simple_returns(panels.priority_day(spark, sf_dir))


@query("ret_panel", with_(
    LABELLED, f"SELECT period, entity, name, asset_class, sector, {q('ret')} AS ret FROM panel ORDER BY asset_class, sector, entity, period"))
def ret_panel(spark, sf_dir):
    return labelled(spark, sf_dir).orderBy("asset_class", "sector", "entity", "period")


@query("composite_class", with_(
    LABELLED, f"SELECT period, asset_class AS grp, {q('avg(ret)')} AS ret, count(ret) AS n_members FROM panel "
    "WHERE asset_class NOT LIKE 'Sector-%' AND asset_class <> 'Equity (single stock)' GROUP BY 1, 2"))
def composite_class(spark, sf_dir):
    members = labelled(spark, sf_dir).where(rt.is_composite_class(F.col("asset_class")))
    return rt.composite(members, F.col("asset_class"))


@query("composite_sector", with_(
    LABELLED, f"SELECT period, regexp_replace(sector, '^Sector-', '') AS grp, {q('avg(ret)')} AS ret, count(ret) AS n_members "
    "FROM panel GROUP BY 1, 2"))
def composite_sector(spark, sf_dir):
    return rt.composite(labelled(spark, sf_dir), rt.sector_name(F.col("sector")))


@query("composite_subset", with_(
    LABELLED, f"SELECT period, sector AS grp, {q('avg(ret)')} AS ret, count(ret) AS n_members FROM panel "
    "WHERE asset_class = 'Equity (single stock)' GROUP BY 1, 2"))
def composite_subset(spark, sf_dir):
    stocks = labelled(spark, sf_dir).where(F.col("asset_class") == "Equity (single stock)")
    return rt.composite(stocks, F.col("sector"))


@query("universe_coverage", with_(
    [*levels("nation"), ("dim", NATION_DIM),
     ("s", "SELECT entity, min(period) AS first_period, max(period) AS last_period, count(level) AS n FROM lv GROUP BY 1"),
     ("u", "SELECT * FROM dim UNION ALL SELECT 'ATLANTIS', 'Nation none', 'OTHER', 'OTHER'")],
    "SELECT entity, name, asset_class, sector, first_period, last_period, coalesce(n, 0) AS n_periods, n IS NOT NULL AS present "
    "FROM u LEFT JOIN s USING (entity)"))
def universe_coverage(spark, sf_dir):
    absent = spark.range(1).select(F.lit("ATLANTIS").alias("entity"), F.lit("Nation none").alias("name"),
                                   F.lit("OTHER").alias("asset_class"), F.lit("OTHER").alias("sector"))
    return rt.universe_coverage(panels.nation_month(spark, sf_dir), nation_dim(spark, sf_dir).unionByName(absent))


def coverage_sql(keys: str, source: str, per_year: int, positive: bool) -> str:
    cols = [f"{keys}, min(period) AS first_period, max(period) AS last_period, count(ret) AS n_periods",
            q(f"avg(ret) * {per_year} * 100") + " AS ann_return_pct",
            q(f"stddev_samp(ret) * sqrt({per_year}) * 100") + " AS ann_vol_pct",
            q("min(ret) * 100") + " AS min_pct", q("max(ret) * 100") + " AS max_pct"]
    if positive:
        cols.append(q("avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100") + " AS pct_positive")
    return f"SELECT {', '.join(cols)} FROM {source} GROUP BY {keys}"


@query("coverage_monthly", with_(LABELLED, coverage_sql("entity, name, asset_class, sector", "panel", 12, True)))
def coverage_monthly(spark, sf_dir):
    return rt.coverage(labelled(spark, sf_dir), ["entity", "name", "asset_class", "sector"], 12)


@query("coverage_daily", with_(returns("event_day"), coverage_sql("entity", "ret", 252, True)))
def coverage_daily(spark, sf_dir):
    return rt.coverage(rt.simple_returns(panels.event_day(spark, sf_dir)), ["entity"], 252)


@query("coverage_class", with_(
    [*LABELLED, ("c", "SELECT period, asset_class AS grp, avg(ret) AS ret FROM panel WHERE asset_class NOT LIKE 'Sector-%' "
                 "AND asset_class <> 'Equity (single stock)' GROUP BY 1, 2")], coverage_sql("grp", "c", 12, False)))
def coverage_class(spark, sf_dir):
    members = labelled(spark, sf_dir).where(rt.is_composite_class(F.col("asset_class")))
    return rt.coverage(rt.composite(members, F.col("asset_class")), ["grp"], 12, positive=False)


@query("topk_longest", with_(
    levels("nation"), "SELECT entity, min(period) AS first_period, count(level) AS n_periods FROM lv GROUP BY 1 "
    "ORDER BY first_period, entity LIMIT 10"))
def topk_longest(spark, sf_dir):
    spans = panels.nation_month(spark, sf_dir).groupBy("entity").agg(
        F.min("period").alias("first_period"), F.count("level").alias("n_periods"))
    return spans.orderBy("first_period", "entity").limit(10)


@query("resample_month_last", with_(
    levels("priority_day"), f"SELECT last_day(period) AS period, entity, {q('arg_max(level, period)')} AS level FROM lv GROUP BY 1, 2"))
def resample_month_last(spark, sf_dir):
    return rt.month_end_levels(panels.priority_day(spark, sf_dir)).select("period", "entity", "level")


@query("cell_count", with_(levels("nation"), "SELECT count(level) AS n_cells, count(DISTINCT entity) AS n_entities, "
                           "count(DISTINCT period) AS n_periods FROM lv"))
def cell_count(spark, sf_dir):
    return panels.nation_month(spark, sf_dir).agg(
        F.count("level").alias("n_cells"), F.count_distinct("entity").alias("n_entities"),
        F.count_distinct("period").alias("n_periods"))
