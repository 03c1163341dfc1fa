"""What series say together: latency by hour, lagged correlation, propagation, node reports and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import cv, kurtosis0, label, pearson, ratio
from tidemark.operators.detectors import KEY, NIGHT, by_time, hour, whole
from tidemark.operators.series import over


def latency_dimension(latency: DataFrame, window: int = 50) -> DataFrame:
    """Per series: latency in business and off-peak hours, spikes and their pattern, rhythm, trend, steadiness of P99
    over half-overlapping windows, and the kind of tail. Input in seconds, results in ms."""
    ms = latency.select("series_id", "ts", (F.col("value") * 1000).alias("v"))
    frame = by_time().rowsBetween(0, window - 1)
    rows = ms.withColumn("i", F.row_number().over(by_time()) - 1).withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("half", F.when(F.col("i") < F.floor(F.col("n") / 2), 1).otherwise(2))
    rows = rows.withColumn("q", F.percentile("v", F.lit([0.5, 0.99])).over(whole())).withColumn("w99", F.when((F.col("i") % (window // 2) == 0) & (F.col("i") <= F.col("n") - window), F.percentile("v", F.lit(0.99)).over(frame)))
    got = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.sum((F.col("v") > 1.5 * F.col("q")[1]).cast("int")).alias("over"), cv("v").alias("cv"), kurtosis0("v").alias("kurtosis"),
        F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("b"), cv("w99").alias("cv99"), F.count("w99").alias("windows"),
    )
    h = ms.groupBy("series_id", hour().alias("h")).agg(F.avg("v").alias("v")).groupBy("series_id").agg(
        F.avg(F.when(F.col("h").between(9, 17), F.col("v"))).alias("business_ms"), F.avg(F.when(F.col("h").isin(*NIGHT), F.col("v"))).alias("off_peak_ms"), cv("v").alias("hour_cv"), F.count(F.lit(1)).alias("hours")
    )
    got = got.join(h, KEY)
    q, change = F.col("q"), ratio(F.col("b") - F.col("a"), "a")
    spikes = F.when((F.col("n") >= 10) & (q[0] != 0), F.col("over")).otherwise(0).cast("long")
    tail = ratio(q[1], q[0])
    return got.select(
        "series_id", F.coalesce("business_ms", F.lit(0.0)).alias("business_ms"), F.coalesce("off_peak_ms", F.lit(0.0)).alias("off_peak_ms"), spikes.alias("spikes"),
        label((spikes == 0, "none"), ((spikes > 20) & (F.col("cv") > 0.5), "frequent_bursty"), (spikes > 10, "periodic"), otherwise="occasional").alias("spike_pattern"),
        ((F.col("hours") >= 12) & (F.col("hour_cv") > 0.3)).alias("periodic"), label(((F.col("n") < 20) | (F.col("a") == 0), "unknown"), (change > 0.2, "increasing"), (change < -0.2, "decreasing"), otherwise="stable").alias("trend"),
        F.when((F.col("n") >= 100) & (F.col("windows") >= 2), F.greatest(F.lit(0.0), 1 - F.col("cv99"))).otherwise(1.0).alias("p99_stability"),
        label(((tail > 10) | (F.col("kurtosis") > 10), "severe"), ((tail > 5) | (F.col("kurtosis") > 5), "moderate"), ((tail > 3) | (F.col("kurtosis") > 3), "mild"), otherwise="normal").alias("long_tail"),
    )


def significance(corr: Column, n: Column) -> Column:
    """Between 0 and 0.99 by the t statistic of a correlation; a third of it under ten samples."""
    t = corr * F.sqrt((n - 2) / (1 - corr * corr + 0.001))
    return F.when(n < 10, 0.3 * corr).otherwise(F.least(F.lit(0.99), 1 - 1 / (1 + F.abs(t) / 10)))


def lagged_correlations(a: DataFrame, b: DataFrame, most: int = 6) -> DataFrame:
    """(series_id, lag, correlation, n, significance): how ``b`` follows ``a`` by ``lag`` common samples; one
    exchange, all lags in one aggregate."""
    both = a.select("series_id", "ts", F.col("value").alias("x")).join(b.select("series_id", "ts", F.col("value").alias("y")), ["series_id", "ts"])
    lags = range(-most, most + 1)
    for k in lags:
        both = both.withColumn(f"x{k + most}", F.lag("x", k).over(by_time()))
    parts = [F.struct(F.lit(k).alias("lag"), pearson(f"x{k + most}", "y").alias("correlation"), F.count(f"x{k + most}").alias("n")).alias(f"c{k + most}") for k in lags]
    got = both.groupBy("series_id").agg(*parts).select("series_id", F.explode(F.array(*[f"c{k + most}" for k in lags])).alias("c")).select("series_id", "c.*")
    return got.withColumn("significance", significance(F.coalesce("correlation", F.lit(0.0)), F.col("n")))


def causality(a: DataFrame, b: DataFrame, cause: str, effect: str, most: int = 6, least: float = 0.3) -> DataFrame:
    """The best lag of each series and what it says: who leads, and whether that is strong enough for a hint."""
    got = lagged_correlations(a, b, most).withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy(F.abs("correlation").desc_nulls_last(), F.abs("lag"), "lag"))).where("k = 1")
    leads = label((F.col("lag") > 0, f"{cause}_leads"), (F.col("lag") < 0, f"{effect}_leads"), otherwise="together")
    return got.select("series_id", F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), "lag", "correlation", "significance", leads.alias("direction"), F.coalesce((F.abs("correlation") > least) & (F.col("lag") >= 0), F.lit(False)).alias("causal"))


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def dimension_links(profile: DataFrame, statements: DataFrame, operations: DataFrame, latency: DataFrame) -> DataFrame:
    """How far each dimension of a six-dimension row goes with its latency.

    ``statements``: (series_id, key, percent, latency_p99 in ms); ``operations``: latency points by key, and ``latency``
    by series, in seconds. Statements count by the share of them whose P99 is over 0.8 of the whole P99, storage by the
    mean latency of its operations over that of all their points, load by joint variation or by bursts with more than
    five latency spikes, volume by its swing.
    """
    slow = statements.join(profile.select("series_id", F.col("latency_p99").alias("whole_p99")), "series_id").groupBy("series_id")
    slow = slow.agg(F.sum(F.when(F.col("latency_p99") > 0.8 * F.col("whole_p99"), F.col("percent")).otherwise(0.0)).alias("slow"))
    means = operations.groupBy("series_id", "key").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.count("value").alias("n"))
    means = means.groupBy("series_id").agg(ratio(F.avg("mean"), F.sum("sum") / F.sum("n")).alias("layer"))
    spikes = latency_dimension(latency).select("series_id", "spikes")
    for part in (slow, means, spikes):
        profile = profile.join(part, "series_id", "left")
    load = F.when((_c("qps_cv") > 0.5) & (_c("latency_cv") > 0.5), 0.7).when((_c("burstiness") > 0.5) & (_c("spikes") > 5), 0.6).otherwise(0.5 * _c("qps_cv"))
    swing = ratio("volume_peak", "volume_mean")
    volume = F.when((swing > 3) & (_c("latency_tail_ratio") > 5), 0.7).otherwise(swing / 10)
    return profile.select(
        "series_id", F.least(F.lit(1.0), _c("slow") / 100).alias("sql"), F.least(F.lit(1.0), _c("layer")).alias("storage"),
        load.alias("load"), volume.alias("volume"), _c("imbalance").alias("balance"),
    )


def propagation(profile: DataFrame) -> DataFrame:
    """Sources of trouble in a six-dimension row with score and amplification, and the chain each one starts."""
    scores = {"qps_burst": _c("burstiness"), "latency_spike": _c("latency_tail_ratio") / 10, "load_imbalance": _c("imbalance"), "storage_bottleneck": _c("volume_score"), "sql_hotspot": _c("hotspot")}
    chains = {"qps_burst": ((_c("burstiness") > 0.4) & (_c("latency_tail_ratio") > 3), "qps_burst > storage_bottleneck > latency_spike"), "load_imbalance": (_c("imbalance") > 0.3, "load_imbalance > hot_instance > latency_spike")}
    chain = lambda k: F.when(chains[k][0], chains[k][1]) if k in chains else F.lit(None).cast("string")
    rows = profile.withColumn("r", F.array(*[F.struct(F.lit(k).alias("source"), v.alias("score"), chain(k).alias("chain")) for k, v in scores.items()]))
    rows = rows.select("series_id", F.explode("r").alias("r"), F.coalesce("cross_correlation", F.lit(0.0)).alias("corr")).select("series_id", "r.*", "corr").where("score > 0.2")
    return rows.select("series_id", "source", "score", (F.col("score") > 0.3).alias("is_source"), ((1 + 0.5 * F.col("score")) * F.when(F.col("corr") > 0.5, 1.2).otherwise(1.0)).alias("amplification"), "chain")


def advice(fingerprints: DataFrame) -> DataFrame:
    """Per statement kind what to do about it."""
    rules = ((F.col("latency_mean") > 100, "optimise for latency"), (F.col("has_subquery"), "rewrite the subquery as a join"), ((F.col("count") > 1000) & (F.col("complexity") > 0.5), "cache or materialise"), ((F.col("class") == "DDL") & (F.col("percent") > 1), "move schema changes out of peak hours"), (F.col("resource") > 0.3, "spread its resource use"))
    said = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())
    return fingerprints.select("series_id", "key", said.alias("recommendations"))


def instance_findings(instances: DataFrame) -> DataFrame:
    """Per instance its worst finding and what to do."""
    kind = label((F.col("health") == "unhealthy", "latency"), (F.col("heat") == "hot", "hot"), (F.col("cv") > 1, "unsteady"), (F.col("latency_spikes") > 10, "spikes"), (F.col("heat") == "cold", "cold"), otherwise="none")
    todo = label((F.col("finding") == "latency", "look into its storage and network"), (F.col("finding") == "hot", "move load away"), (F.col("finding").isin("unsteady", "spikes"), "look for bursts of a single client"), (F.col("finding") == "cold", "give it more load"), otherwise="keep")
    return instances.withColumn("finding", kind).select("series_id", "instance", "finding", todo.alias("recommendation"), "trend", "latency_spikes")


# nodes ----------------------------------------------------------------------------------------------------------


def component(df: DataFrame, name: str) -> DataFrame:
    """Rows of instances of one component."""
    return df.where(F.col("instance").contains(name))


def node_report(qps: DataFrame, latency: DataFrame, cpu: DataFrame, cores: int = 8, least_cpu: float = 0.1, outlier: float = 1.15) -> DataFrame:
    """Per instance: mean load, latency, processor use (samples over ``least_cpu``), its utilisation and cost label, and
    whether it takes more processor for its load than the others."""
    keys = ["series_id", "instance"]
    parts = [qps.groupBy(*keys).agg(F.avg("value").alias("qps"), F.max("value").alias("peak_qps")), latency.groupBy(*keys).agg((F.percentile("value", F.lit(0.5)) * 1000).alias("p50_ms"), (F.percentile("value", F.lit(0.99)) * 1000).alias("p99_ms")), cpu.where(F.col("value") > least_cpu).groupBy(*keys).agg(F.avg("value").alias("cpu"))]
    got = reduce(lambda x, y: x.join(y, keys, "left"), parts)
    use = F.col("cpu") / cores
    got = got.withColumn("utilisation", use).withColumn("cost", label((use.isNull(), "unknown"), (use < 0.3, "over_provisioned"), (use < 0.5, "comfortable"), (use < 0.7, "balanced"), otherwise="tight"))
    got = got.withColumn("cpu_per_kqps", ratio(1000 * F.col("cpu"), "qps", None))
    return got.withColumn("cpu_outlier", F.coalesce(F.col("cpu_per_kqps") > outlier * F.avg("cpu_per_kqps").over(whole()), F.lit(False)))


def node_balance(report: DataFrame) -> DataFrame:
    return report.groupBy("series_id").agg(F.count(F.lit(1)).alias("nodes"), cv("qps").alias("qps_cv"), cv("cpu").alias("cpu_cv")).withColumn("balance", label((F.col("qps_cv") < 0.1, "balanced"), (F.col("qps_cv") < 0.2, "slightly_uneven"), otherwise="uneven"))


# fetching, sets and checks ----------------------------------------------------------------------------------------


def fetch_order(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with ``has_cache``; to be fetched by (has_cache, place): those without a cache first, else in their own order."""
    known = cached.select(*keys).distinct().withColumn("__known", F.lit(True))
    got = wanted.join(known, keys, "left").withColumn("has_cache", F.coalesce("__known", F.lit(False))).drop("__known")
    return got


def approximate_stats(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Percentiles and distinct counts in bounded memory, for raw values of any number."""
    return df.groupBy("series_id").agg(F.percentile_approx("value", F.lit([0.5, 0.9, 0.99]), accuracy).alias("q"), F.approx_count_distinct("value", 0.02).alias("distinct_values"))


def synthetic(spark: SparkSession, series: int = 80, samples: int = 500, hours: int = 72, seed: int = 1) -> DataFrame:
    """Load series for checks: a base, business hours for half of them, one slow wave, Gaussian noise, a floor."""
    rows = spark.range(series * samples).select((F.col("id") % series).alias("s"), F.floor(F.col("id") / series).alias("i"))
    draw = lambda k: (F.pmod(F.xxhash64("s", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(1 << 20)).cast("double")  # noqa: E731  by series
    each = lambda k: (F.pmod(F.xxhash64("s", "i", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(1 << 20)).cast("double")  # noqa: E731  by point
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("i") * hours * 3600 / samples)))
    base, spread = 100 + 5000 * draw(1), 0.1 + 0.6 * draw(2)
    h = F.hour("ts")
    day = F.when(draw(4) > 0.5, F.when(h.between(9, 17), 1.5 + 0.5 * each(5)).when(h <= 6, 0.3 + 0.2 * each(5)).otherwise(1.0)).otherwise(1.0)
    wave = F.when(0.5 * draw(3) > 0.2, 1 + 0.3 * F.sin(F.col("i") / samples * 2 * 3.141592653589793)).otherwise(1.0)
    noise = F.sqrt(-2 * F.log(F.greatest(each(6), F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * each(7))
    value = base * day * wave + noise * base * spread
    return rows.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("series_id"), "ts", F.when(value < 0, 10 * each(8)).otherwise(value).alias("value"))


def validation(df: DataFrame, least_samples: int = 50, least_hours: float = 24) -> DataFrame:
    """Per series with enough of it: variation, burstiness and seasonality, their classes, and whether all are in range."""
    from tidemark.operators import profile as p

    span = (F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))) / 3600
    got = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("samples"), span.alias("hours"), F.avg("value").alias("mean"), cv("value").alias("cv")).where((F.col("samples") >= least_samples) & (F.col("hours") >= least_hours))
    got = got.join(p.burstiness(df), KEY).join(p.seasonality(df), KEY)
    bucket = lambda c: label((c < 0.2, "low"), (c < 0.5, "medium"), (c < 1, "high"), otherwise="extreme")
    valid = (F.col("cv") >= 0) & F.col("burstiness").between(0, 1) & F.col("seasonality").between(0, 1)
    return got.select("*", p.load_class(F.col("mean")).alias("load_class"), bucket(F.col("cv")).alias("cv_class"), bucket(F.col("burstiness")).alias("burst_class"), valid.alias("valid"))


def distribution(validated: DataFrame) -> DataFrame:
    """How many series fall into each class."""
    return validated.select("valid", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("class")) for c in ("load_class", "cv_class", "burst_class")])).alias("x")).groupBy("x.field", "x.class").agg(F.count(F.lit(1)).alias("series"), F.sum((~F.col("valid")).cast("int")).alias("invalid"))


def resumed(df: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Samples that come after a gap of more than ``gap`` seconds."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return df.withColumn("gap", t - F.lag(t).over(over(keys))).where(F.col("gap") > gap)
