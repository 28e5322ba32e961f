"""Percentile and competition ranks without a single-partition window.

The distinct values are counted first (map-side combine, so one value held by a third of
the rows becomes one row), cut into balanced buckets, numbered inside the buckets and
offset by the totals of the buckets below. Only the bucket totals meet in one task: there are
at most ``MOST_BUCKETS`` of them per group, which also bounds the broadcasts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.session import materialize

BUCKETS = 64
MOST_BUCKETS = 1024
VALUES_PER_BUCKET = 1_000_000


def value_ranks(values: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """One row per (groups, value): ``n_equal``, ``n_below`` and ``n_total`` of its non-null peers."""
    spark, groups = values.sparkSession, list(groups)
    counts = materialize(values.where(F.col(value).isNotNull())
                         .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_equal")))
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, counts.count() // VALUES_PER_BUCKET))
    # One sketch row per group comes back: it may differ between two runs, so both uses share it.
    sketch = counts.groupBy(*groups).agg(
        F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 16 * buckets).alias("cuts"))
    bucket = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    if groups:
        cuts = spark.createDataFrame(sketch.collect(), sketch.schema)
        bucketed = counts.join(F.broadcast(cuts), groups).withColumn("bucket", bucket).drop("cuts")
    else:
        row = sketch.first()
        cuts = F.array(*[F.lit(c) for c in (row.cuts or [])])
        bucketed = counts.withColumn("cuts", cuts).withColumn("bucket", bucket).drop("cuts")
    totals = bucketed.groupBy(*groups, "bucket").agg(F.sum("n_equal").alias("in_bucket"))
    by_bucket = Window.partitionBy(*groups).orderBy("bucket")
    whole = Window.partitionBy(*groups)
    totals = totals.select(
        *groups, "bucket",
        (F.sum("in_bucket").over(by_bucket) - F.col("in_bucket")).alias("offset"),
        F.sum("in_bucket").over(whole).alias("n_total"))
    inside = Window.partitionBy(*groups, "bucket").orderBy(value)
    return (bucketed
            .withColumn("n_below_inside", F.sum("n_equal").over(inside) - F.col("n_equal"))
            .join(F.broadcast(totals), [*groups, "bucket"])
            .select(*groups, value, "n_equal",
                    (F.col("offset") + F.col("n_below_inside")).alias("n_below"), "n_total"))


def percentile_average() -> Column:
    """Percentile rank, ties averaged, over the rows of ``value_ranks``."""
    return (F.col("n_below") + (F.col("n_equal") + 1) / F.lit(2.0)) / F.col("n_total")


def competition_rank_desc() -> Column:
    """Rank 1 = largest; equal values share the smallest rank."""
    return F.col("n_total") - F.col("n_below") - F.col("n_equal") + 1
