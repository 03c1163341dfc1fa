"""Samples that any run draws again: a row's place in the draw is a keyed digest of its identity, not of its partition.

A stratum's sample is its ``k`` rows with the least draws. Ranks are taken within salted parts of a stratum first and
then of what these leave, so a stratum that holds a third of all rows is never one task's; Spark also cuts each map
task's rows to ``k`` a part before they move, as the rank is limited. Nothing is sorted as a whole.

Defined results: rows with equal identity have equal draws, so a sample takes them together as far as ``k`` reaches,
ordered by all their columns that sort; a null identity is one more identity; a null stratum is one; a weight that is
null, not finite or not above zero is never drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a stratum that are ranked by themselves.
SALTS = 64


def draw(identity: Sequence[str], seed: int | str) -> Column:
    """Hex digest of a row's identity under a seed; nulls are told from texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in identity]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def uniform(digest: Column) -> Column:
    """52 bits of a digest as a number above 0 and below 1."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _least(df: DataFrame, strata: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    window = Window.partitionBy(*strata).orderBy(*order) if strata else Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn("__tm_rank", F.row_number().over(window)).where(F.col("__tm_rank") <= k)


def _drawn(df: DataFrame, strata: Sequence[str], k: int) -> DataFrame:
    ties = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType)) and not f.name.startswith("__tm_")]
    order = ["__tm_draw", "__tm_digest", *(f"`{c}`" for c in ties)]
    rows = df.withColumn("__tm_salt", F.pmod(F.xxhash64("__tm_digest"), F.lit(SALTS)))
    rows = _least(rows, [*strata, "__tm_salt"], order, k)  # SALTS * k rows of a stratum at most go on
    rows = _least(rows, strata, order, k)
    return rows.withColumn("rank", F.col("__tm_rank").cast("long")).drop("__tm_rank", "__tm_salt", "__tm_draw", "__tm_digest")


def sampled(df: DataFrame, strata: Sequence[str], identity: Sequence[str], k: int, seed: int | str = 0) -> DataFrame:
    """``k`` rows of every stratum, each row equally likely, with their ``rank`` in the draw from 1."""
    rows = df.withColumn("__tm_digest", draw(identity, seed)).withColumn("__tm_draw", F.lit(0.0))
    return _drawn(rows, strata, k)


def weighted(df: DataFrame, strata: Sequence[str], identity: Sequence[str], weight: str, k: int, seed: int | str = 0) -> DataFrame:
    """``k`` rows of every stratum without replacement, the next always drawn in proportion to the weights left.

    The draws are exponential with the weight as their rate: the least of them is a draw by weight.
    """
    w = F.col(weight).cast("double")
    rows = df.where((w > 0) & (w < float("inf"))).withColumn("__tm_digest", draw(identity, seed))
    return _drawn(rows.withColumn("__tm_draw", -F.log(uniform(F.col("__tm_digest"))) / w), strata, k)


def shuffled(df: DataFrame, identity: Sequence[str], seed: int | str = 0) -> DataFrame:
    """All rows in an order by draw: a sort by ranges, which no single task holds."""
    return df.withColumn("__tm_digest", draw(identity, seed)).orderBy("__tm_digest").drop("__tm_digest")


def thinned(df: DataFrame, identity: Sequence[str], share: float, seed: int | str = 0) -> DataFrame:
    """Rows whose draw lies below ``share``: no shuffle, and a larger share holds all of a smaller one's rows."""
    return df.where(uniform(draw(identity, seed)) < share)
