"""Registered queries of whole clusters and of trailing windows over every event, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import cluster, rolling
from tidemark.oracles import INSTANCE, KIND
from tidemark.plans import model as m

BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)


def _days(spark: SparkSession, folder: str):
    """Events by instance and day."""
    return m.events(spark, folder).groupBy(F.lit("all").alias("series_id"), "instance", F.date_trunc("day", "ts").alias("ts"))


def _load(spark: SparkSession, folder: str) -> DataFrame:
    return _days(spark, folder).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Values as milliseconds, in cumulative buckets of counters that grow from day to day."""
    seconds = F.col("value") / 1000
    wide = _days(spark, folder).agg(*[F.sum((seconds <= b).cast("int")).cast("double").alias(str(b)) for b in BOUNDS], F.count(F.lit(1)).cast("double").alias("inf"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"`{b}`").alias("c")) for b in (*BOUNDS, "inf")])
    long = wide.select("series_id", "instance", "ts", F.explode(pairs).alias("p")).select("series_id", "instance", "ts", "p.le", "p.c")
    run = Window.partitionBy("series_id", "instance", "le").orderBy("ts")
    return long.select("series_id", "instance", "ts", "le", F.sum("c").over(run).alias("cum"))


def _cpu(spark: SparkSession, folder: str) -> DataFrame:
    return _days(spark, folder).agg((F.sum("value") / 1000).alias("value"))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.instance_report(_load(spark, folder), _buckets(spark, folder), _cpu(spark, folder))


def cluster_instances(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder)


def cluster_components(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.component_report(_report(spark, folder), F.substring_index("instance", "-", 1))


def detailed_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    """Daily load and mean values by kind and node; one node does six times the work, another takes four times as long."""
    rows = m.events(spark, folder).groupBy(F.lit("all").alias("series_id"), F.col("key").alias("category"), "instance", F.date_trunc("day", "ts").alias("ts"))
    work, time = F.when(F.col("instance") == "kv-7", 6).otherwise(1), F.when(F.col("instance") == "sql-2", 4).otherwise(1)
    load = rows.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("value", F.col("value") * work)
    slow = rows.agg((F.avg("value") / 1000).alias("value")).withColumn("value", F.col("value") * time)
    whole = _days(spark, folder).agg((F.avg("value") / 1000).alias("value")).withColumn("value", F.col("value") * time)
    reads = F.col("category") == "Select"
    return cluster.detailed_imbalance(load, whole, load.where(~reads), slow.where(~reads))


def trailing_order_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Every event against the 60 before it of its type and user group."""
    rows = m.events(spark, folder).select(F.concat_ws("/", "event_type", "instance").alias("series_id"), "ts", "value")
    got = rolling.trailing(rows, ["series_id"], 60, block=1 << 12)
    return got.select("series_id", "ts", "value", "before", "med", "dev")


_CLUSTER = f"""
    e AS (SELECT {INSTANCE} AS instance, date_trunc('day', ts) AS ts, value / 1000 AS s FROM events),
    ld AS (SELECT instance, ts, count(*)::DOUBLE AS value, sum(s) AS cpu FROM e GROUP BY ALL),
    bounds AS (SELECT unnest([{', '.join(map(str, BOUNDS))}]) AS le),
    d AS (SELECT instance, ts, le, count(*) FILTER (WHERE s <= le)::DOUBLE AS c FROM e, bounds GROUP BY ALL),
    later AS (SELECT *, max(t) OVER (PARTITION BY instance, ts) AS total FROM (
        SELECT d.*, ld.value AS t, dense_rank() OVER (PARTITION BY d.instance ORDER BY d.ts) AS k FROM d JOIN ld USING (instance, ts)) WHERE k > 1),
    x AS (SELECT *, lag(c, 1, 0.0) OVER w AS c0, lag(le, 1, 0.0) OVER w AS l0 FROM later WINDOW w AS (PARTITION BY instance, ts ORDER BY le)),
    v AS (SELECT *, CASE WHEN c = c0 THEN l0 ELSE l0 + (le - l0) / (c - c0) * (0.5 * total - c0) END AS v50,
                 CASE WHEN c = c0 THEN l0 ELSE l0 + (le - l0) / (c - c0) * (0.99 * total - c0) END AS v99 FROM x),
    pt AS (SELECT instance, ts, total, coalesce(arg_min(v50, le) FILTER (WHERE c >= 0.5 * total), max(le)) AS p50,
                  coalesce(arg_min(v99, le) FILTER (WHERE c >= 0.99 * total), max(le)) AS p99 FROM v GROUP BY ALL),
    lt AS (SELECT instance, 1000 * sum(p50 * total) / sum(total) AS p50_ms, 1000 * sum(p99 * total) / sum(total) AS p99_ms FROM pt GROUP BY ALL),
    co AS (SELECT instance, count(*) AS n, corr(value, p50) AS c50, corr(value, p99) AS c99, var_pop(value) AS vv, var_pop(p50) AS v50, var_pop(p99) AS v99
           FROM ld JOIN pt USING (instance, ts) GROUP BY ALL),
    cu AS (SELECT instance, avg(cpu) AS cpu, max(cpu) AS peak_cpu FROM ld WHERE cpu > 0.1 GROUP BY ALL),
    lo AS (SELECT instance, avg(value) AS load, max(value) AS peak_load FROM ld GROUP BY ALL),
    ir AS (SELECT lo.*, p50_ms, p99_ms, cpu, peak_cpu, CASE WHEN n >= 10 AND vv > 0 AND v50 > 0 THEN c50 END AS load_p50,
                  CASE WHEN n >= 10 AND vv > 0 AND v99 > 0 THEN c99 END AS load_p99, 1000 * cpu / load AS cpu_per_thousand
           FROM lo LEFT JOIN lt USING (instance) LEFT JOIN cu USING (instance) LEFT JOIN co USING (instance))
"""
_GROUP = """
    {name} AS (SELECT instance, {series} AS series_id, avg(value) AS value, count(*) AS n, min(ts) AS ts, max(ts) AS last FROM {source} GROUP BY ALL),
    {name}x AS (SELECT *, avg(value) OVER w AS b, count(*) OVER w AS k FROM {name} WHERE n >= 10 AND value >= {floor} WINDOW w AS (PARTITION BY series_id))
"""
_FOUND = """
    SELECT series_id, '{type}' AS type,
           CASE WHEN abs(value / b - 1) > {critical} THEN 'CRITICAL' WHEN abs(value / b - 1) > {high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
           epoch(ts)::BIGINT AS ts, epoch(last)::BIGINT AS end_ts, 0 AS duration_sec, round(value * {scale}, 6) AS value, round(b * {scale}, 6) AS baseline,
           round(value / b - 1, 6) AS z_score, NULL::DOUBLE AS confidence, '[Imbalance]' AS detected_by, instance, 'Imbalance' AS detail, '{source}' AS source
    FROM {name}x WHERE k >= 2 AND abs(value / b - 1) >= {least}
"""
_SOURCES = {
    "statements": ("ld", "'all/' || key", "load", 10),
    "latency": ("wl", "'all'", "whole", 0.001),
    "operations": ("ol", "'all/' || key", "(SELECT * FROM load WHERE key <> 'Select')", 10),
    "operation_latency": ("os", "'all/' || key", "(SELECT * FROM slow WHERE key <> 'Select')", 0.001),
}
_LIMITS = {
    False: dict(type="LOAD_IMBALANCE", least=0.5, high=0.7, critical=1.0, scale=1),
    True: dict(type="LATENCY_IMBALANCE", least=0.8, high=1.5, critical=2.0, scale=1000),
}

QUERIES = {
    "cluster_instances": cluster_instances,
    "cluster_components": cluster_components,
    "detailed_imbalance": detailed_imbalance,
    "trailing_order_stats": trailing_order_stats,
}
SQL = {
    "cluster_instances": f"""
        WITH {_CLUSTER}
        SELECT 'all' AS series_id, instance, round(load, 6) AS load, peak_load, round(p50_ms, 6) AS p50_ms, round(p99_ms, 6) AS p99_ms, round(cpu, 6) AS cpu,
               round(peak_cpu, 6) AS peak_cpu, round(load_p50, 6) AS load_p50, round(load_p99, 6) AS load_p99, round(cpu_per_thousand, 6) AS cpu_per_thousand,
               CASE WHEN load_p99 IS NULL THEN 'unknown' WHEN abs(load_p99) < 0.3 THEN 'stable' WHEN load_p99 > 0.5 THEN 'load_sensitive' ELSE 'moderate' END AS sensitivity
        FROM ir
    """,
    "cluster_components": f"""
        WITH {_CLUSTER},
        g AS (SELECT split_part(instance, '-', 1) AS component, count(*) AS nodes, sum(load) AS load, sum(peak_load) AS peak_load, coalesce(sum(cpu), 0) AS cpu,
                     coalesce(sum(peak_cpu), 0) AS peak_cpu, coalesce(avg(load_p99), 0) AS load_p99, max(p99_ms) AS worst_p99_ms, stddev_pop(load) / avg(load) AS load_cv FROM ir GROUP BY ALL),
        u AS (SELECT *, cpu / (8 * nodes) AS utilisation, peak_cpu / (8 * nodes) AS peak_utilisation FROM g)
        SELECT 'all' AS series_id, component, nodes, round(load, 6) AS load, peak_load, round(cpu, 6) AS cpu, round(peak_cpu, 6) AS peak_cpu, round(load_p99, 6) AS load_p99,
               round(worst_p99_ms, 6) AS worst_p99_ms, round(load_cv, 6) AS load_cv, round(peak_load / load, 6) AS peak_to_mean, round(utilisation, 6) AS utilisation,
               round(peak_utilisation, 6) AS peak_utilisation,
               CASE WHEN utilisation < 0.3 THEN 'severely_under_used' WHEN utilisation < 0.5 THEN 'under_used' WHEN utilisation < 0.7 THEN 'well_used' ELSE 'highly_used' END AS cost,
               CASE WHEN abs(load_p99) < 0.3 THEN 'low' WHEN load_p99 > 0.5 THEN 'high' ELSE 'moderate' END AS sensitivity,
               CASE WHEN load_cv < 0.1 THEN 'balanced' WHEN load_cv < 0.2 THEN 'slightly_uneven' ELSE 'uneven' END AS balance
        FROM u
    """,
    "detailed_imbalance": f"""
        WITH e AS (SELECT {KIND} AS key, {INSTANCE} AS instance, date_trunc('day', ts) AS ts, value / 1000 AS s FROM events),
        load AS (SELECT key, instance, ts, count(*)::DOUBLE * CASE WHEN instance = 'kv-7' THEN 6 ELSE 1 END AS value FROM e GROUP BY key, instance, ts),
        slow AS (SELECT key, instance, ts, avg(s) * CASE WHEN instance = 'sql-2' THEN 4 ELSE 1 END AS value FROM e GROUP BY key, instance, ts),
        whole AS (SELECT instance, ts, avg(s) * CASE WHEN instance = 'sql-2' THEN 4 ELSE 1 END AS value FROM e GROUP BY instance, ts),
        {', '.join(_GROUP.format(name=n, series=series, source=source, floor=floor) for n, series, source, floor in _SOURCES.values())}
        {' UNION ALL '.join(_FOUND.format(source=k, name=v[0], **_LIMITS['latency' in k]) for k, v in _SOURCES.items())}
    """,
    "trailing_order_stats": f"""
        WITH e AS (SELECT event_type || '/' || {INSTANCE} AS series_id, ts, value FROM events),
        w AS (SELECT *, list_sort(list(value) OVER w) AS f, count(*) OVER w AS before FROM e
              WINDOW w AS (PARTITION BY series_id ORDER BY ts, value ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, f[(len(f) - 1) // 2 + 1] AS med FROM w)
        SELECT series_id, floor(epoch(ts))::BIGINT AS ts, round(value, 6) AS value, before::INT AS before, round(med, 6) AS med,
               round(list_sort([abs(q - med) FOR q IN f])[(len(f) - 1) // 2 + 1], 6) AS dev
        FROM c
    """,
}
