"""Panels through files: CSV with malformed lines, snapshots by year, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import returns as rt
from tidepanel.plans.oracle import levels, q, with_
from tidepanel.plans.panel_queries import LABELLED, NATIONS, labelled
from tidepanel.plans.registry import query
from tidepanel.session import materialize, shared_folder
from tidepanel.sources import checked, files, panels


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tidepanel/{name}_{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, header: str, path: str) -> str:
    """A text file of a header and the lines of a column ``line``."""
    first = lines.sparkSession.createDataFrame([(header,)], "line string")
    first.unionByName(lines.select("line")).coalesce(1).write.text(path)
    return path


def good_and_bad(good: DataFrame, bad: DataFrame, value: str) -> DataFrame:
    """Rows that were read, and the raw text of those that were not."""
    return good.select("period", "entity", value, F.lit(None).cast("string").alias("raw")).unionByName(
        bad.select(F.lit(None).cast("date").alias("period"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("double").alias(value), "raw"))


#: The last column repeats the name of the first nation, with other values: it fills holes of the first only.
WIDE_SQL = [*levels("nation"), ("p", "SELECT DISTINCT period FROM lv"), ("e", "SELECT n_name AS entity FROM nation"),
            ("w", "SELECT period, entity, level FROM p CROSS JOIN e LEFT JOIN lv USING (period, entity)"),
            ("b", "SELECT strftime(period, '%Y-%m-%d') || ',oops' AS raw FROM p WHERE year(period) = 1998 UNION ALL "
             "SELECT 'month ' || strftime(period, '%Y%m') || repeat(',1.0', 26) FROM p WHERE year(period) = 1999")]


@query("src_csv_wide", with_(WIDE_SQL, f"SELECT period, entity, {q(f'''CASE WHEN entity = '{NATIONS[0]}' THEN coalesce(level, -1.0) ELSE level END''')} AS level, NULL::VARCHAR AS raw FROM w "
                                       "UNION ALL SELECT NULL, NULL, NULL, raw FROM b"))
def src_csv_wide(spark, sf_dir):
    """A matrix file with a repeated header and two kinds of malformed lines: too few fields, no date and so a wrong type."""
    wide = materialize(files.long_to_wide(panels.nation_month(spark, sf_dir), NATIONS).withColumn("again", F.lit(-1.0)))
    path, header = fresh(spark, "wide"), ",".join(["Date", *NATIONS, NATIONS[0]])
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = wide.select(F.concat_ws(",", F.col("period").cast("string"), *[cell(c) for c in [*NATIONS, "again"]]).alias("line"))
    short = wide.where(F.year("period") == 1998).select(F.concat(F.col("period").cast("string"), F.lit(",oops")).alias("line"))
    odd = wide.where(F.year("period") == 1999).select(F.concat(F.lit("month "), F.date_format("period", "yyyyMM"), F.lit(",1.0" * 26)).alias("line"))
    write_lines(rows, header, f"{path}/a")
    write_lines(short.unionByName(odd), header, f"{path}/b")
    return good_and_bad(*checked.read_wide(spark, [f"{path}/a", f"{path}/b"]), "level")


LONG_BAD = "'x' || strftime(period, '%Y-%m-%d') || ',' || entity || ',n,c,s,0.5'"


@query("src_csv_long", with_(LABELLED, f"SELECT period, entity, {q('ret')} AS ret, NULL::VARCHAR AS raw FROM panel WHERE entity IN ('NATION_1', 'NATION_2', 'NATION_3') "
                                       f"UNION ALL SELECT NULL, NULL, NULL, {LONG_BAD} FROM panel WHERE entity = 'NATION_4'"))
def src_csv_long(spark, sf_dir):
    """The long panel of six columns, read for three series; the lines of a fourth have no date and are set aside."""
    panel = materialize(labelled(spark, sf_dir))
    bad = F.col("entity") == "NATION_4"
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.when(bad, F.concat(F.lit("x"), F.col("period").cast("string"), F.lit(","), "entity", F.lit(",n,c,s,0.5"))).otherwise(
        F.concat_ws(",", F.col("period").cast("string"), "entity", quoted("name"), quoted("asset_class"), quoted("sector"), F.col("ret").cast("string")))
    path = write_lines(panel.select(line.alias("line")), ",".join(files.LONG_PANEL_SCHEMA.names), fresh(spark, "long"))
    return good_and_bad(*checked.read_long(spark, [path], files.LONG_PANEL_SCHEMA, ["NATION_1", "NATION_2", "NATION_3"]), "ret")


@query("src_csv_deflator", with_(levels("type"), f"SELECT period, 'cpi' AS entity, {q('level')} AS level, NULL::VARCHAR AS raw FROM lv WHERE entity = 'ECONOMY' AND year(period) <> 1997 "
                                                 "UNION ALL SELECT NULL, NULL, NULL, strftime(period, '%Y-%m-%d') || ',note,n/a' FROM lv WHERE entity = 'ECONOMY' AND year(period) = 1997"))
def src_csv_deflator(spark, sf_dir):
    """A price index whose column is found by its name; the months of one year hold text instead of a number."""
    index = materialize(panels.type_month(spark, sf_dir).where("entity = 'ECONOMY'"))
    value = F.when(F.year("period") == 1997, F.lit("n/a")).otherwise(F.col("level").cast("string"))
    path = write_lines(index.select(F.concat_ws(",", F.col("period").cast("string"), F.lit("note"), value).alias("line")), "observation_date,remark,CPIAUCSL", fresh(spark, "cpi"))
    return good_and_bad(*checked.read_deflator(spark, [path]), "level")


REFRESHED = "CASE WHEN year(period) = 1998 THEN level + 1 ELSE level END"


@query("src_snapshot_years", with_(levels("type"), f"SELECT year(period)::INTEGER AS year, count(*) AS n_rows, {q(f'sum({REFRESHED})', 4)} AS total, year(period) = 1998 AS rewritten FROM lv WHERE year(period) < 2001 GROUP BY year(period)"), digits=4)
def src_snapshot_years(spark, sf_dir):
    """A snapshot that is brought up to date: one year has other values, one is gone. The files of the other years are the ones from before."""
    panel = panels.type_month(spark, sf_dir).select("period", "entity", "level")
    snap = checked.YearSnapshot(spark, fresh(spark, "years"))
    listed = lambda: materialize(snap.read().select("year", F.col("_metadata.file_path").alias("file")).distinct())
    snap.refresh(panel)
    before = listed()
    snap.refresh(panel.where(F.year("period") < 2001).withColumn("level", F.when(F.year("period") == 1998, F.col("level") + 1).otherwise(F.col("level"))))
    kept = listed().join(before, ["year", "file"], "left_semi").select("year").distinct().withColumn("kept", F.lit(True))
    sums = snap.read().groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("level").alias("total"))
    return sums.join(kept, "year", "left").select("year", "n_rows", "total", F.col("kept").isNull().alias("rewritten"))


SINKS = {"coverage_csv": ("csv", "n_obs"), "returns_parquet": ("parquet", "ret"), "levels_json": ("json", "level")}


@query("sink_report", with_(
    [*LABELLED, ("u", "SELECT 'coverage_csv' AS sink, count(*) AS n, CAST(sum(n) AS DOUBLE) AS t FROM (SELECT entity, count(*) AS n FROM panel GROUP BY 1) UNION ALL "
                 "SELECT 'returns_parquet', count(*), CAST(sum(CAST(round(ret, 8) AS DECIMAL(38, 8))) AS DOUBLE) FROM panel UNION ALL "
                 "SELECT 'levels_json', count(*), CAST(sum(CAST(round(level, 8) AS DECIMAL(38, 8))) AS DOUBLE) FROM lv")],
    f"SELECT sink, n AS observed_rows, {q('t', 4)} AS observed_total, n AS reread_rows, {q('t', 4)} AS reread_total FROM u"), digits=4)
def sink_report(spark, sf_dir):
    """Three sinks: what was counted while writing and what is read back after publication."""
    panel = materialize(labelled(spark, sf_dir))
    frames = {"coverage_csv": panel.groupBy("entity").agg(F.count(F.lit(1)).alias("n_obs")), "returns_parquet": panel,
              "levels_json": panels.nation_month(spark, sf_dir).select("period", "entity", "level")}
    rows = []
    for sink, (kind, total) in SINKS.items():
        figures = checked.publish(frames[sink], fresh(spark, sink), kind, total)
        rows.append((sink, figures["observed_rows"], float(figures["observed_total"]), figures["reread_rows"], float(figures["reread_total"])))
    return spark.createDataFrame(rows, "sink string, observed_rows long, observed_total double, reread_rows long, reread_total double")
