"""Numbers along an order of all rows without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged


def numbered(df: DataFrame, order: Sequence[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its place from 1 along ``order``.

    Rows are dealt to ranges of the order, numbered within each, and moved by the rows of the ranges before. Only the
    ranges' counts, one row each, meet in one place. Rows that tie in the whole order share a range and are numbered in
    any order there; nulls come first; an empty table stays empty.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(parts, *order).withColumn("__tm_part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("__tm_part").agg(F.count(F.lit(1)).alias("__tm_n"))  # as many rows as ranges
    before = Window.orderBy("__tm_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__tm_part", F.coalesce(F.sum("__tm_n").over(before), F.lit(0)).alias("__tm_before"))
    place = F.row_number().over(Window.partitionBy("__tm_part").orderBy(*order))
    out = rows.withColumn(name, place).join(F.broadcast(offsets), "__tm_part")
    return out.withColumn(name, F.col(name) + F.col("__tm_before")).drop("__tm_part", "__tm_before")


def discrete_percentile(df: DataFrame, keys: Sequence[str], value: str, p: str) -> DataFrame:
    """(keys, value): the least value of each group that a share ``p`` (a decimal as text) of its values does not exceed.

    Equal values are counted before they move; the counts of a group are then summed along its values by a window that
    spills, so the result is exact at any group size and no aggregate holds a group. Nulls do not count; NaN is the
    largest value; a group without values has null.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("__tm_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__tm_c").over(group.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.greatest(F.lit(1), F.ceil(F.sum("__tm_c").over(group) * F.lit(Decimal(p))))
    placed = counts.select(*keys, value, (upto >= rank).alias("__tm_in"))
    return placed.groupBy(*keys).agg(F.min(F.when(F.col("__tm_in"), F.col(value))).alias(value))
