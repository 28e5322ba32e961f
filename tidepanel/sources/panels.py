"""Level panels ``(period, entity, level)`` cut from the star tables.

A level is the mean price of a cell: whole cents summed as integers, divided once. The
sum is exact, so the level does not depend on how the rows were split.

Every panel is written once and read back: what follows (calendar, returns, references) goes over the
panel several times, but over the facts only once.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.functions.sizing import within
from tidepanel.session import materialize

_held: ContextVar[dict | None] = ContextVar("panels", default=None)


@contextlib.contextmanager
def shared() -> Iterator[None]:
    """Inside, every panel is written once and used by all that ask for it: for reports of many checks over the same facts."""
    token = _held.set({})
    try:
        yield
    finally:
        _held.reset(token)


def panel(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _held.get()
        if held is None:
            return build(spark, sf_dir)
        key = (build.__name__, sf_dir)
        if key not in held:
            held[key] = build(spark, sf_dir)
        return held[key]
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("bigint")


def _level(cents: str, n: str) -> Column:
    return F.sum(cents) / (F.sum(n) * 100)


def _by_dimension(facts: DataFrame, key: str, price: str, period: Column,
                  dim: DataFrame, dim_key: str, entity: str) -> DataFrame:
    """Mean level by (period, dimension attribute).

    A small dimension is broadcast. A large one is met by a hash join over a shuffle of the bare facts, without sorting or grouping them by key first: with few facts a key
    and period that would shrink nothing. A key that holds a third of the facts is split by
    adaptive execution. Each task sums its own rows to one per (period, entity) before these are shuffled.
    """
    facts = facts.select(F.col(key).alias("k"), period.alias("period"), _cents(price).alias("cents"))
    dim = dim.select(F.col(dim_key).alias("k"), F.col(entity).alias("entity"))
    joined = facts.join(F.broadcast(dim) if within(dim) else dim.hint("shuffle_hash"), "k").withColumn("n", F.lit(1).cast("bigint"))
    return materialize(joined.groupBy("period", "entity").agg(_level("cents", "n").alias("level")))


@panel
def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice",
                         F.last_day("l_shipdate"), table(spark, sf_dir, "part"), "p_partkey", "p_brand")


@panel
def type_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice",
                         F.last_day("l_shipdate"), table(spark, sf_dir, "part"), "p_partkey", "p_type")


def _orders_by(spark: SparkSession, sf_dir: str, entity: str, period: Column) -> DataFrame:
    return materialize(table(spark, sf_dir, "orders")
                       .select(period.alias("period"), F.col(entity).alias("entity"),
                               _cents("o_totalprice").alias("cents"), F.lit(1).cast("bigint").alias("n"))
                       .groupBy("period", "entity").agg(_level("cents", "n").alias("level")))


@panel
def priority_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by(spark, sf_dir, "o_orderpriority", F.last_day("o_orderdate"))


@panel
def priority_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by(spark, sf_dir, "o_orderpriority", F.to_date("o_orderdate"))


@panel
def segment_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice",
                         F.last_day("o_orderdate"), table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


def _customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@panel
def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice",
                         F.last_day("o_orderdate"), _customer_nation(spark, sf_dir), "c_custkey", "n_name")


@panel
def region_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice",
                         F.last_day("o_orderdate"), _customer_nation(spark, sf_dir), "c_custkey", "r_name")


@panel
def event_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(table(spark, sf_dir, "events")
                       .select(F.to_date("ts").alias("period"), F.col("event_type").alias("entity"),
                               _cents("value").alias("cents"), F.lit(1).cast("bigint").alias("n"))
                       .groupBy("period", "entity").agg(_level("cents", "n").alias("level")))
