"""Checked files: quarantine, snapshots by year, published sinks."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import checked, files

D = datetime.date


def write(path, *lines):
    os.makedirs(path)
    with open(f"{path}/part-0.csv", "w") as out:
        out.write("\n".join(lines) + "\n")
    return str(path)


def test_wide_quarantine(spark, tmp_path):
    a = write(tmp_path / "a", "Date,x,y,x", "2000-01-31,1.5,,9", "2000-02-29,,2.5,8", "2000-03-31,1", "not a day,1,2,3", "2000-04-30,one,2,3", "2000-05-31,1,2,3,4", "2000-06-30,,,")
    good, bad = checked.read_wide(spark, [a])
    got = {(r.period, r.entity): r.level for r in good.collect()}
    assert got == {(D(2000, 1, 31), "x"): 1.5, (D(2000, 1, 31), "y"): None, (D(2000, 2, 29), "x"): 8.0, (D(2000, 2, 29), "y"): 2.5,
                   (D(2000, 6, 30), "x"): None, (D(2000, 6, 30), "y"): None}
    assert sorted(r.raw for r in bad.collect()) == ["2000-03-31,1", "2000-04-30,one,2,3", "2000-05-31,1,2,3,4", "not a day,1,2,3"]
    # pruning a column does not hide its errors
    assert good.select("period").distinct().count() == 3


def test_long_and_deflator(spark, tmp_path):
    long = write(tmp_path / "l", ",".join(files.LONG_PANEL_SCHEMA.names), '2000-01-15,a,"n, m",c,s,0.5', "2000-01-15,b,n,c,s,x", "2000-01-15,c,n,c,s,")
    good, bad = checked.read_long(spark, [long], files.LONG_PANEL_SCHEMA)
    assert sorted(map(tuple, good.collect())) == [(D(2000, 1, 31), "a", 0.5), (D(2000, 1, 31), "c", None)]
    assert [r.raw for r in bad.collect()] == ["2000-01-15,b,n,c,s,x"]
    assert checked.read_long(spark, [long], files.LONG_PANEL_SCHEMA, ["c"])[0].count() == 1
    index = write(tmp_path / "i", "date, Value ,other", "2000-01-01,100.5,z", "2000-02-01,.,z")
    good, bad = checked.read_deflator(spark, [index])
    assert [tuple(r) for r in good.collect()] == [(D(2000, 1, 31), "cpi", 100.5)] and bad.count() == 1
    with pytest.raises(ValueError):
        checked.read_deflator(spark, [write(tmp_path / "n", "date,other", "2000-01-01,1")])


def test_snapshot_writes_what_changed(spark, tmp_path):
    rows = [(D(y, m, 28), "a", float(y + m)) for y in (2000, 2001, 2002) for m in (1, 2)]
    panel = spark.createDataFrame(rows, "period date, entity string, level double")
    snap = checked.YearSnapshot(spark, str(tmp_path / "s"))
    assert snap.refresh(panel) == [2000, 2001, 2002]
    assert snap.refresh(panel.orderBy(F.desc("level"))) == []
    assert snap.refresh(panel.where("period <> date'2001-02-28'")) == [2001]
    assert snap.refresh(panel.where("year(period) > 2000")) == [2001]
    assert sorted((r.period, r.level) for r in snap.read().collect()) == sorted((d, v) for d, _, v in rows if d.year > 2000)
    assert snap.refresh(panel) == [2000] and snap.read().count() == 6


def test_publish_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    for df, rows in ((one, 2), (one.limit(0), 0), (one.unionByName(one), 4)):
        figures = checked.publish(df, path, "parquet", "v")
        assert figures["observed_rows"] == figures["reread_rows"] == rows == spark.read.parquet(path).count()
    assert os.listdir(tmp_path) == ["out"]
