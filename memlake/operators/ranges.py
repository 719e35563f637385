"""Ranks and running sums over ranges: no order is ever computed in one task, and no group in one either.

Rows are range-partitioned by group and order and written once, so that every row keeps its range; ranges are numbered in order.
Windows then run within a range, and what the ranges before hold (one small row for each range and group) is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import materialize


def ranged(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range in _range, increasing with the order."""
    return materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place (from 1) within their group, as row_number() over the whole group would give it."""
    parts = ranged(rows, [F.col(c) for c in (*group, *order)])
    own = ["_range", *group]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    met = parts.withColumn("_own", place).alias("a").join(F.broadcast(sizes).alias("b") if not group else sizes.alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_own") + F.col("_before")).cast("long").alias(name))


def sum_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of `value` over all rows that come before them; `order` has no ties."""
    parts = ranged(rows, [F.col(order)])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = parts.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return parts.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
