"""Building the instrument dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def flatten_members(groups: DataFrame, members: str) -> DataFrame:
    """One row per member of each group's member array."""
    return groups.withColumn("entity", F.explode(members)).drop(members)


def merge_universe(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of ``(entity, ..., priority)`` tables; the highest priority wins per entity."""
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source)
    fields = [c for c in merged.columns if c not in ("entity", "priority")]
    best = F.max_by(F.struct(*fields), F.col("priority")).alias("best")
    return merged.groupBy("entity").agg(best).select("entity", "best.*")
