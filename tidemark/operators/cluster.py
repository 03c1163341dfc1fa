"""The whole view of a cluster: load, latency, processor use and their relations by instance and by component.

Inputs are long tables: load (series_id, instance, ts, value), cumulative latency buckets in seconds (series_id, instance,
ts, le, cum) and processor cores in use (series_id, instance, ts, value). Everything is an aggregate by instance, so rows
meet by (series_id, instance) at most, and after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import cv, label, pearson, ratio
from tidemark.operators.detectors import category_imbalance, imbalance
from tidemark.operators.series import bucket_delta, histogram_quantile, weighted_mean

KEYS = ["series_id", "instance"]


def latency_points(buckets: DataFrame) -> DataFrame:
    """(keys, ts, total, p50, p99) of what each time added to the buckets; times that added nothing go."""
    delta = bucket_delta(buckets, KEYS)
    points = delta.where(F.col("le") == float("inf")).select(*KEYS, "ts", F.col("delta").alias("total"))
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        points = points.join(histogram_quantile(delta, KEYS, q, "delta").withColumnRenamed("value", name), [*KEYS, "ts"], "left")
    return points


def instance_report(load: DataFrame, buckets: DataFrame, cpu: DataFrame, least_cpu: float = 0.1, least: int = 10) -> DataFrame:
    """Per instance of the load table: mean and peak load, latency in ms weighted by what each time added, processor use of
    samples over ``least_cpu``, and how load and latency go together where ``least`` times have both.

    An instance without latency or processor samples has null there; so has one without variance for the correlations.
    """
    points = latency_points(buckets)
    weighted = points.groupBy(*KEYS).agg((weighted_mean("p50", "total") * 1000).alias("p50_ms"), (weighted_mean("p99", "total") * 1000).alias("p99_ms"))
    both = load.join(points, [*KEYS, "ts"]).groupBy(*KEYS)
    both = both.agg(pearson("value", "p50", least).alias("load_p50"), pearson("value", "p99", least).alias("load_p99"))
    use = cpu.where(F.col("value") > least_cpu).groupBy(*KEYS).agg(F.avg("value").alias("cpu"), F.max("value").alias("peak_cpu"))
    out = load.groupBy(*KEYS).agg(F.avg("value").alias("load"), F.max("value").alias("peak_load"))
    for part in (weighted, use, both):
        out = out.join(part, KEYS, "left")
    c = F.col("load_p99")
    assessed = label((c.isNull(), "unknown"), (F.abs(c) < 0.3, "stable"), (c > 0.5, "load_sensitive"), otherwise="moderate")
    return out.withColumn("cpu_per_thousand", ratio(1000 * F.col("cpu"), "load", None)).withColumn("sensitivity", assessed)


def component_report(instances: DataFrame, component: Column, cores: float = 8.0) -> DataFrame:
    """Per series and component of ``instance_report``: totals, utilisation and its cost, sensitivity to load, balance."""
    got = instances.groupBy("series_id", component.alias("component")).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("load").alias("load"), F.sum("peak_load").alias("peak_load"),
        F.coalesce(F.sum("cpu"), F.lit(0.0)).alias("cpu"), F.coalesce(F.sum("peak_cpu"), F.lit(0.0)).alias("peak_cpu"),
        F.coalesce(F.avg("load_p99"), F.lit(0.0)).alias("load_p99"), F.max("p99_ms").alias("worst_p99_ms"), cv("load").alias("load_cv"),
    )
    capacity = F.col("nodes") * cores
    got = got.withColumn("peak_to_mean", ratio("peak_load", "load")).withColumn("utilisation", F.col("cpu") / capacity).withColumn("peak_utilisation", F.col("peak_cpu") / capacity)
    use, c, spread = F.col("utilisation"), F.col("load_p99"), F.col("load_cv")
    return got.select(
        "*",
        label((use < 0.3, "severely_under_used"), (use < 0.5, "under_used"), (use < 0.7, "well_used"), otherwise="highly_used").alias("cost"),
        label((F.abs(c) < 0.3, "low"), (c > 0.5, "high"), otherwise="moderate").alias("sensitivity"),
        label((spread < 0.1, "balanced"), (spread < 0.2, "slightly_uneven"), otherwise="uneven").alias("balance"),
    )


def detailed_imbalance(statements: DataFrame, latency: DataFrame, operations: DataFrame, op_latency: DataFrame) -> DataFrame:
    """Instances off their group's mean, by ``source``: statements and operations in load by category, latency as a whole,
    operations in latency by category. ``latency`` has no category; latencies are in seconds, findings in ms."""
    parts = {
        "statements": category_imbalance(statements),
        "latency": imbalance(latency, 0.001, 0.8, 1.5, 2.0, 1000.0, "LATENCY_IMBALANCE"),
        "operations": category_imbalance(operations),
        "operation_latency": category_imbalance(op_latency, latency=True),
    }
    out = None
    for source, found in parts.items():
        found = found.withColumn("source", F.lit(source))
        out = found if out is None else out.unionByName(found)
    return out
