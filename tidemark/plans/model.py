"""The driver tables as metrics: load, latency, counters, buckets, keys and instances from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.numbering import discrete_percentile
from tidemark.session import table

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
KINDS = {"view": "Select", "click": "Update", "purchase": "Insert", "signup": "Begin", "error": "Rollback"}


def events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    node = F.col("user_id") % 9
    rows = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return rows.withColumn("key", kind[F.col("event_type")]).withColumn("instance", F.concat(F.when(node < 6, "sql-").otherwise("kv-"), node.cast("string")))


def hourly(spark: SparkSession, folder: str, by: str | None = None) -> DataFrame:
    """Events per hour; one series, or one per value of ``by``."""
    rows = events(spark, folder)
    series = F.lit("all") if by is None else F.col(by)
    return rows.groupBy(series.alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, key, instance sums): hourly counts per statement kind."""
    return events(spark, folder).groupBy(F.lit("all").alias("series_id"), "key", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def by_instance(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy(F.lit("all").alias("series_id"), "instance", F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def latency(spark: SparkSession, folder: str, by: str | None = None) -> DataFrame:
    """P99 of the values per hour (day, by instance), as seconds."""
    keys = {"series_id": F.lit("all"), **({by: F.col(by)} if by else {}), "ts": F.date_trunc("hour" if by != "instance" else "day", "ts")}
    rows = events(spark, folder).select(*[c.alias(name) for name, c in keys.items()], "value")
    return discrete_percentile(rows, list(keys), "value", "0.99").withColumn("value", F.col("value") / 1000)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Event counters per key that start again every seventh day."""
    from pyspark.sql import Window

    week = F.floor(F.unix_seconds("ts") / (7 * 86400))
    h = keyed(spark, folder).withColumn("w", week)
    run = Window.partitionBy("key", "w").orderBy("ts")
    return h.select("series_id", "key", "ts", F.sum("value").over(run).alias("value"))


def buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative histogram of the values by hour: (series_id, ts, le, cum)."""
    from pyspark.sql import Window

    rows = events(spark, folder).select(F.date_trunc("hour", "ts").alias("ts"), "value")
    wide = rows.groupBy("ts").agg(*[F.sum((F.col("value") <= b).cast("int")).alias(f"b{k}") for k, b in enumerate(BOUNDS)], F.count(F.lit(1)).alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").cast("double").alias("c")) for k, b in enumerate(BOUNDS)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").cast("double").alias("c")))
    long = wide.select("ts", F.explode(pairs).alias("p")).select(F.lit("all").alias("series_id"), "ts", "p.le", "p.c")
    run = Window.partitionBy("series_id", "le").orderBy("ts")
    return long.select("series_id", "ts", "le", F.sum("c").over(run).alias("cum"))
