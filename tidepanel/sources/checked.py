"""Files that are checked on the way in and out: CSV with a quarantine, snapshots by year, sinks that count what they write."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tidepanel.session import materialize

BAD = "_malformed"
# Accepted names of the index column of a deflator file.
INDEX_NAMES = ("cpi", "cpiaucsl", "value")


def header_of(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Column names as they stand in the first line, duplicates included."""
    first = spark.read.text(list(paths)).limit(1).collect()
    parsed = spark.createDataFrame([(r["value"],) for r in first], "line string").select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(first[0]["value"].count(",") + 1))).alias("c")) if first else None
    return [x.strip() for x in parsed.first()["c"] if x is not None] if parsed is not None else []


def read_checked(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that follow the schema, and a quarantine with the raw text of all others (a wrong number of fields, a cell of another type).

    All columns are parsed, as a pruned one would hide its errors; the file is parsed once, into a table.
    """
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = materialize(spark.read.schema(whole).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
                         .option("columnPruning", False).csv(list(paths)))
    good = parsed.where(F.col(BAD).isNull()).drop(BAD)
    return good, parsed.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("raw"))


def read_wide(spark: SparkSession, paths: Sequence[str], value: str = "level") -> tuple[DataFrame, DataFrame]:
    """A wide matrix as ``(period, entity, value)`` and its quarantine. The header gives the entities; of columns with one name the first that has a value counts."""
    names = header_of(spark, paths)[1:]
    schema = T.StructType([T.StructField("period", T.DateType()), *(T.StructField(f"c{i}", T.DoubleType()) for i in range(len(names)))])
    good, bad = read_checked(spark, paths, schema)
    places: dict[str, list[str]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(f"c{i}")
    cells = F.array(*[F.struct(F.lit(name).alias("entity"), F.coalesce(*columns).alias(value)) for name, columns in places.items()])
    return good.select("period", F.explode(cells).alias("e")).select("period", "e.*"), bad


def read_long(spark: SparkSession, paths: Sequence[str], schema: T.StructType, entities: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(period, entity, ret)`` of a long panel and its quarantine."""
    good, bad = read_checked(spark, paths, schema)
    rows = good.select(F.last_day("date").alias("period"), F.col("ticker").alias("entity"), F.col("monthly_return").alias("ret"))
    return rows.where(F.col("entity").isin(list(entities))) if entities is not None else rows, bad


def read_deflator(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(period, entity, level)`` of a price index and its quarantine: the first column is the date, the first accepted name the index."""
    names = header_of(spark, paths)
    at = next((i for i, name in enumerate(names) if i and name.lower() in INDEX_NAMES), None)
    if at is None:
        raise ValueError(f"no column is named {' or '.join(INDEX_NAMES)}")
    schema = T.StructType([T.StructField(f"c{i}", T.DateType() if i == 0 else T.DoubleType() if i == at else T.StringType()) for i in range(len(names))])
    good, bad = read_checked(spark, paths, schema)
    return good.select(F.last_day("c0").alias("period"), F.lit("cpi").alias("entity"), F.col(f"c{at}").alias("level")), bad


def checksum(columns: Sequence[str]) -> Column:
    """Sum of row hashes as a decimal: the same for any order of rows, and repeated rows count."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


class YearSnapshot:
    """A panel in folders by year with a manifest of (generation, year, rows, checksum); only years that changed are written again.

    Data is written before its manifest, so a run that dies in between is repeated by the next. Years that are gone from the panel stay as folders and
    are not read: the manifest decides.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.data, self.log = spark, f"{path}/data", f"{path}/manifest"

    def manifest(self) -> DataFrame | None:
        """Years of the last generation; None before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.log)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        log = self.spark.read.parquet(self.log)
        last = log.agg(F.max("generation")).first()[0]
        return log.where(F.col("generation") == F.lit(last))

    def refresh(self, panel: DataFrame) -> list[int]:
        """Bring the snapshot up to ``panel`` (with a ``period``); returns the years that were written."""
        panel = materialize(panel.withColumn("year", F.year("period")))
        columns = sorted(c for c in panel.columns if c != "year")
        now = panel.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), checksum(columns).alias("checksum"))
        old = self.manifest()
        known = {(r["year"], r["rows"], r["checksum"]) for r in old.collect()} if old is not None else set()  # a row per year
        rows = now.collect()
        changed = sorted(r["year"] for r in rows if (r["year"], r["rows"], r["checksum"]) not in known)
        if changed:
            (panel.where(F.col("year").isin(changed)).repartition("year").sortWithinPartitions("period")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(self.data))
        if changed or len(known) != len(rows):
            generation = (old.first()["generation"] if old is not None and known else 0) + 1
            self.spark.createDataFrame([(generation, *r) for r in rows], "generation int, year int, rows long, checksum decimal(38,0)").coalesce(1).write.mode("append").parquet(self.log)
        return changed

    def read(self) -> DataFrame:
        years = [r["year"] for r in self.manifest().select("year").collect()]
        return self.spark.read.parquet(self.data).where(F.col("year").isin(years))


def publish(df: DataFrame, path: str, kind: str, total: str) -> dict:
    """Write beside ``path``, count and sum while writing, read back, compare, and only then put it in place by a rename.

    Returns observed and reread row counts and sums of ``total``. A reader of ``path`` sees the old result or the whole new one (on a
    file system whose rename is atomic).
    """
    spark = df.sparkSession
    seen = Observation()
    staging = f"{path}.{uuid.uuid4().hex}"
    figures = [F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col(total), 8).cast("decimal(38,8)")).alias("total")]
    writer = df.observe(seen, *figures).write.option("header", True) if kind == "csv" else df.observe(seen, *figures).write
    writer.format(kind).save(staging)
    back = spark.read.schema(df.schema).option("header", True).format(kind).load(staging).agg(*figures).first()
    observed = seen.get
    if (observed["rows"], observed["total"]) != (back["rows"], back["total"]):
        raise OSError(f"{staging} does not hold what was written")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(jvm.Path(staging), target):
        raise OSError(f"{path} could not be put in place")
    return {"observed_rows": observed["rows"], "observed_total": observed["total"], "reread_rows": back["rows"], "reread_total": back["total"]}
