"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def bounded_sample(rows: DataFrame, label: str, total: int, *order: str) -> DataFrame:
    """At most ``total`` rows, split evenly over the labels, chosen by a hash of ``order`` (ties by its columns).

    Labels are counted first. A label with more than its part is thinned by the hash before it is ranked, so the
    ranked rows stay near the bound however large the label is; the labels themselves must be few. Empty in, empty out.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    part = max(1, total // max(1, len(counts)))
    mix = F.pmod(F.xxhash64(*order), F.lit(1 << 30))
    near = F.lit(False)
    for value, n in counts.items():
        below = int(min(1.0, 1.5 * (part + 50) / n) * (1 << 30))
        near = near | ((F.col(label) == F.lit(value)) & (mix < below))
    ranked = rows.filter(near).withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(mix, *order)))
    return ranked.filter(F.col("_rank") <= part).drop("_rank")
