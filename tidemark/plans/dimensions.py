"""Cross-dimension view: one row per series with health, risk, thresholds, alerts and outlook.

Rules on rows that are already aggregated; every label is an ordered list of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import clamp, label, ratio
from tidemark.operators import profile as p
from tidemark.operators import workload as w


def profile(qps: DataFrame, latency: DataFrame, sql: DataFrame, ops: DataFrame, inst_qps: DataFrame, inst_latency: DataFrame) -> DataFrame:
    """Six dimensions: statements, storage, latency, balance, load, volume."""
    load = p.load_profile(qps, latency)
    skew = p.instance_skew(inst_qps).select("series_id", F.col("skew").alias("imbalance"), F.col("risk").alias("balance_risk"), "hot", "cold")
    work = w.workload_profile(sql, ops)
    transactions = F.sum(F.when(F.col("category") == "transaction", F.col("mean")).otherwise(0.0))
    vol = w.volume(ops).groupBy("series_id").agg(F.max("peak").alias("volume_peak"), F.sum("mean").alias("volume_mean"), ratio(transactions, F.sum("mean")).alias("volume_transactions"))
    share = w.mix(sql).groupBy("series_id").agg((F.max("percent") / 100).alias("hotspot"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("o"), "key"))), lambda x: x["key"]), 1, 3).alias("dominant"))
    health = w.cluster_health(w.instances(inst_qps, inst_latency)).select("series_id", F.col("score").alias("instance_score"))
    out = load
    for part in (skew, work, vol, share, health):
        out = out.join(part, "series_id", "left")
    return out.transform(scored)


def scored(df: DataFrame) -> DataFrame:
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    saturation = label((c("volume_peak") > 100_000, "high"), (c("volume_peak") > 50_000, "medium"), otherwise="low")
    df = df.withColumn("saturation_risk", saturation).withColumn("volume_score", volume_score())
    df = df.withColumn("bottlenecks", bottlenecks())
    df = df.withColumn("bottleneck", F.when(F.get("bottlenecks", F.lit(0))["score"] >= 0.3, F.get("bottlenecks", F.lit(0))["name"]).otherwise("none")).withColumn("second_bottleneck", F.when(F.get("bottlenecks", F.lit(1))["score"] >= 0.2, F.get("bottlenecks", F.lit(1))["name"]).otherwise("none"))
    penalty = (
        F.when(c("latency_p99") > 500, 15).when(c("latency_p99") > 200, 8).otherwise(0) + F.when(c("latency_tail_ratio") > 10, 10).when(c("latency_tail_ratio") > 5, 5).otherwise(0) + F.when(c("imbalance") > 0.5, 12).when(c("imbalance") > 0.3, 6).otherwise(0)
        + F.when(c("qps_cv") > 0.8, 8).when(c("qps_cv") > 0.5, 4).otherwise(0) + F.when(F.col("bottleneck") != "none", 8).otherwise(0) + F.when(F.col("saturation_risk") == "high", 10).when(F.col("saturation_risk") == "medium", 5).otherwise(0) + F.when(c("hotspot") > 0.7, 8).otherwise(0)
    )
    df = df.withColumn("health", clamp(100.0 - penalty + F.when(F.abs(c("cross_correlation")) > 0.6, 5).otherwise(0), 0.0, 100.0))
    df = df.withColumn("risk", label((F.col("health") >= 80, "low"), (F.col("health") >= 60, "medium"), (F.col("health") >= 40, "high"), otherwise="critical"))
    df = df.withColumn("degradation_risk", label((F.col("health") < 50, "high"), ((F.col("health") < 70) | (c("change_points") > 3), "medium"), otherwise="low"))
    pattern = label(((c("daily_strength") > 0.5) & (c("weekly_strength") > 0.2), "multi_periodic"), (c("daily_strength") > 0.5, "daily_periodic"), (c("burstiness") > 0.5, "bursty"), (c("qps_cv") < 0.2, "stable"), otherwise="variable")
    critical = label((c("qps_peak_to_avg") > 10, "extreme_peaks"), (c("qps_cv") > 1, "highly_variable"), (c("qps_max") > 50_000, "high_volume"), (c("qps_peak_to_avg") > 5, "peaky"), otherwise="normal")
    df = df.withColumn("qps_pattern", pattern).withColumn("critical_load", critical).withColumn("forecast_confidence", clamp(1 - c("qps_cv") - 0.5 * c("burstiness"), 0.1, 0.95))
    advice = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in (
        (c("latency_p99") > 500, "look into tail latency"), (c("imbalance") > 0.3, "rebalance instances"), (c("hotspot") > 0.7, "spread the dominant statement"), (F.col("saturation_risk") != "low", "add storage capacity"),
        (c("write_amplification") > 3, "batch writes"), (c("qps_cv") > 0.5, "smooth load peaks"), (F.col("bottleneck") != "none", "remove the dominant bottleneck"),
    )]), lambda x: x.isNotNull())
    return df.withColumn("recommendations", F.slice(advice, 1, 5))


def volume_score() -> Column:
    """How far the storage volume is a bottleneck: a peak, a lopsided mix of reads and writes, mostly transactions."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    mixed = ratio(c("read_ratio"), c("write_ratio"))
    parts = ((ratio(c("volume_peak"), c("volume_mean")) > 3, 0.3), ((mixed < 0.5) | (mixed > 10), 0.2), (c("volume_transactions") > 0.5, 0.3))
    return F.least(F.lit(1.0), sum((F.when(rule, points).otherwise(0.0) for rule, points in parts), F.lit(0.0)))


def bottlenecks() -> Column:
    """Candidates by score, the highest first; equal ones by name."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    scores = {
        "latency": c("latency_tail_ratio") / 10,
        "balance": c("imbalance"),
        "sql_hotspot": c("hotspot"),
        "load_burst": c("qps_peak_to_avg") / 10,
        "volume": c("volume_score"),
    }
    made = F.array(*[F.struct((-v).alias("o"), F.lit(k).alias("name"), v.alias("score")) for k, v in scores.items()])
    return F.transform(F.array_sort(made), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


METRICS = ("qps_mean", "qps_cv", "latency_p99", "latency_tail_ratio", "imbalance", "hotspot", "burstiness")


def similarity(df: DataFrame) -> DataFrame:
    """Ratio of the smaller to the larger of each pair of metrics: 7 x 7 cells of one row, not a join of tables."""
    values = F.array(*[F.struct(F.lit(m).alias("m"), F.coalesce(F.col(m), F.lit(0.0)).cast("double").alias("v")) for m in METRICS])
    one = df.select("series_id", values.alias("v"))
    pairs = one.select("series_id", F.explode("v").alias("a"), "v").select("series_id", "a", F.explode("v").alias("b"))
    a, b = F.abs("a.v"), F.abs("b.v")
    s = F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(ratio(F.least(a, b), F.greatest(a, b)))
    return pairs.select("series_id", F.col("a.m").alias("metric_a"), F.col("b.m").alias("metric_b"), s.alias("similarity"))


def thresholds(df: DataFrame) -> DataFrame:
    """Warning at two and critical at three deviations over the mean, wider for bursty load."""
    wide = 1 + 0.5 * F.coalesce("burstiness", F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("qps").alias("metric"), F.col("qps_mean").alias("current"), (F.col("qps_mean") + 2 * wide * F.col("qps_std")).alias("warning"), (F.col("qps_mean") + 3 * wide * F.col("qps_std")).alias("critical")),
        F.struct(F.lit("latency").alias("metric"), F.col("latency_p99").alias("current"), (F.col("latency_mean") + 2 * F.col("latency_std")).alias("warning"), (F.col("latency_mean") + 3 * F.col("latency_std")).alias("critical")),
        F.struct(F.lit("balance").alias("metric"), F.coalesce("imbalance", F.lit(0.0)).alias("current"), F.lit(0.3).alias("warning"), F.lit(0.6).alias("critical")),
        F.struct(F.lit("hotspot").alias("metric"), F.coalesce("hotspot", F.lit(0.0)).alias("current"), F.lit(0.5).alias("warning"), F.lit(0.7).alias("critical")),
        F.struct(F.lit("tail").alias("metric"), F.coalesce("latency_tail_ratio", F.lit(0.0)).alias("current"), F.lit(5.0).alias("warning"), F.lit(10.0).alias("critical")),
    )
    return df.select("series_id", F.explode(rows).alias("t")).select("series_id", "t.*")


def alerts(limits: DataFrame) -> DataFrame:
    """State of each rule, its priority, and the fatigue of a series with many firing rules."""
    state = label((F.col("current") >= F.col("critical"), "firing"), (F.col("current") >= F.col("warning"), "warning"), otherwise="ok")
    from tidemark.operators.detectors import whole

    out = limits.withColumn("state", state).withColumn("fatigue", F.least(F.lit(1.0), 0.2 * F.sum((F.col("state") == "firing").cast("int")).over(whole())))
    impact = F.least(F.lit(1.0), ratio("current", "critical"))
    urgency = F.when(F.col("state") == "firing", 1.0).when(F.col("state") == "warning", 0.5).otherwise(0.0)
    level = F.when(F.col("state") == "firing", 1).when(F.col("state") == "warning", 2).otherwise(3)
    return out.withColumn("priority", 0.3 * level + 0.4 * impact + 0.3 * urgency).withColumn("suppressed", (F.col("fatigue") >= 0.8) & (F.col("state") != "firing"))


def monitor(df: DataFrame) -> DataFrame:
    """Status line: state, predicted health, confidence, capacity and root cause."""
    status = label((F.col("health") >= 80, "healthy"), (F.col("health") >= 60, "degraded"), otherwise="critical")
    drift = F.coalesce("outlook_recent_change", F.lit(0.0))
    room = ratio("qps_max", "qps_mean", 1.0)
    return df.select(
        "series_id", status.alias("status"), clamp(F.col("health") - 20 * F.greatest(F.lit(0.0), drift), 0.0, 100.0).alias("predicted_health"), clamp(0.5 + 0.5 * F.col("forecast_confidence"), 0.0, 1.0).alias("confidence"),
        F.col("bottleneck").alias("root_cause"), (1.2 * room).alias("capacity_factor"), (F.col("outlook_forecast") > 0.8 * F.col("qps_max")).alias("capacity_alert"), "recommendations",
    )
