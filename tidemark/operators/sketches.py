"""Mergeable summaries: quantile and distinct-count sketches kept by hour and merged to days and weeks.

Raw values are read once, when an hour is summarised. The stored table has one row for each series, hour and batch, of a
size that depends on the sketches' parameters and not on the values; late batches only add rows. Any longer span is
a merge of stored rows, as exact as a sketch made at once: KLL sketches keep ranks within about 1.65 / ``k`` of the
count, HyperLogLog counts within about 1.04 / sqrt(2^``lg``).

Defined results: null and NaN values count as rows but have no rank; null ids are no ids; an hour without values has null
sketches, which merge as nothing; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, LG = 400, 12


def summarised(rows: DataFrame, keys: list[str], ids: str, k: int = K, lg: int = LG) -> DataFrame:
    """Rows (``keys``, ts, value, ``ids``) by hour: count, sum, extremes and the two sketches."""
    value = F.when(~F.isnan("value"), F.col("value"))
    by_hour = rows.withColumn("value", value).groupBy(*keys, F.date_trunc("hour", "ts").alias("hour"))
    return by_hour.agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("ranks"), F.hll_sketch_agg(F.col(ids).cast("string"), F.lit(lg)).alias("distinct"),
    )


def store(summary: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's summary; writing the same batch again replaces it."""
    out = summary.withColumn("date", F.to_date("hour")).withColumn("batch", F.lit(batch))
    out.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(summaries: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Stored summaries by ``unit`` (hour, day, week, month)."""
    got = summaries.groupBy(*keys, F.date_trunc(unit, "hour").alias("start")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_distinct("hour").alias("hours"),
        F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("distinct").alias("distinct"),
    )
    return got


def estimates(summaries: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Summaries with their quantiles by name, and the number of distinct ids, instead of the sketches."""
    some = F.kll_sketch_get_n_double("ranks") > 0
    found = {name: F.when(some, F.kll_sketch_get_quantile_double(F.col("ranks"), F.lit(q))) for name, q in quantiles.items()}
    return summaries.withColumns(found | {"ids": F.hll_sketch_estimate("distinct")}).drop("ranks", "distinct")
