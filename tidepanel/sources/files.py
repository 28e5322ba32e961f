"""Readers and writers of the panel files: wide and long CSV, parquet snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LONG_PANEL_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("monthly_return", T.DoubleType()),
])


def read_wide_csv(spark: SparkSession, path: str, entities: Sequence[str], value: str = "level") -> DataFrame:
    """Wide matrix file (first column the date) as a long table; absent cells stay null."""
    schema = T.StructType([T.StructField("period", T.DateType())]
                          + [T.StructField(e, T.DoubleType()) for e in entities])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide_to_long(wide, value)


def wide_to_long(wide: DataFrame, value: str = "level") -> DataFrame:
    names = [c for c in wide.columns if c != "period"]
    return wide.unpivot(["period"], [F.col(f"`{c}`") for c in names], "entity", value)


def long_to_wide(df: DataFrame, entities: Sequence[str], value: str = "level") -> DataFrame:
    """Mean on duplicate keys. The entity list is given, so no extra job looks for it."""
    return df.groupBy("period").pivot("entity", list(entities)).agg(F.avg(value))


def read_long_csv(spark: SparkSession, path: str, entities: Sequence[str] | None = None) -> DataFrame:
    """Three of the six columns; the CSV reader prunes the rest."""
    df = (spark.read.schema(LONG_PANEL_SCHEMA).option("header", True).csv(path)
          .select(F.last_day("date").alias("period"), F.col("ticker").alias("entity"),
                  F.col("monthly_return").alias("ret")))
    return df.where(F.col("entity").isin(list(entities))) if entities is not None else df


def read_deflator_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price index file: the first of the accepted column names wins."""
    raw = spark.read.option("header", True).csv(path)
    # Accepted names of the index column.
    accepted = ("cpi", "cpiaucsl", "value")
    column = next(c for c in raw.columns if c.lower() in accepted)
    return raw.select(F.last_day(F.to_date(raw.columns[0])).alias("period"), F.lit("cpi").alias("entity"), F.col(column).cast("double").alias("level"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by_year: bool = True) -> None:
    """Zstd parquet, one folder per year so that a date slice prunes partitions."""
    if by_year:
        df = df.withColumn("year", F.year("period"))
        (df.repartition("year").sortWithinPartitions("entity", "period")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path))
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def snapshot(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the saved panel if it is complete, else build and save it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        write_parquet(build(), path)
    return spark.read.parquet(path)
