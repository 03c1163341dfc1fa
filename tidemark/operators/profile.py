"""Load profile: statistics, daily, weekly and monthly patterns, character and correlation, one row per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clamp, cv, ema, kurtosis0, label, pearson, ratio, skewness0
from tidemark.operators.detectors import by_time, NIGHT, whole
from tidemark.session import staged_all

BUCKETS_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def trimmed(df: DataFrame, times: float = 3.0, least: int = 10) -> DataFrame:
    """Rows within ``times`` interquartile ranges of the quartiles, where at least half of ten or more remain."""
    q = df.withColumn("__q", F.percentile("value", F.lit([0.25, 0.75])).over(whole())).withColumn("__n", F.count(F.lit(1)).over(whole()))
    reach = times * (F.col("__q")[1] - F.col("__q")[0])
    q = q.withColumn("__in", F.col("value").between(F.col("__q")[0] - reach, F.col("__q")[1] + reach)).withColumn("__k", F.sum(F.col("__in").cast("int")).over(whole()))
    return q.where((F.col("__n") < least) | (2 * F.col("__k") < F.col("__n")) | F.col("__in")).drop("__q", "__n", "__in", "__k")


def entropy(df: DataFrame, bins: int = 10) -> DataFrame:
    """Normalised entropy of a histogram of ``bins`` cells, place int((v - min) / (max - min) 9)."""
    r = df.withColumn("lo", F.min("value").over(whole())).withColumn("hi", F.max("value").over(whole()))
    cell = F.floor(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * (bins - 1))
    counts = r.groupBy("series_id", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(whole()))
    return p.groupBy("series_id").agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(bins)))).alias("entropy"))


def mad(df: DataFrame) -> DataFrame:
    m = df.withColumn("__m", F.percentile("value", F.lit(0.5)).over(whole()))
    return m.groupBy("series_id").agg(F.median(F.abs(F.col("value") - F.col("__m"))).alias("mad"))


def outlier_ratio(df: DataFrame) -> DataFrame:
    """Share of values outside the 1.5 IQR fences."""
    q = df.withColumn("__q", F.percentile("value", F.lit([0.25, 0.75])).over(whole()))
    reach = 1.5 * (F.col("__q")[1] - F.col("__q")[0])
    out = (F.col("value") < F.col("__q")[0] - reach) | (F.col("value") > F.col("__q")[1] + reach)
    return q.groupBy("series_id").agg(F.avg(out.cast("double")).alias("outlier_ratio"))


def qps_profile(df: DataFrame) -> DataFrame:
    p = F.percentile("value", F.lit([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]))
    core = trimmed(df).groupBy("series_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), p.alias("q"))
    q = F.col("q")
    core = core.select("series_id", "min", "max", "mean", q[2].alias("median"), "std", q[0].alias("p10"), q[4].alias("p90"), q[5].alias("p99"), (q[3] - q[1]).alias("iqr"), F.least(F.lit(100.0), ratio(q[5], "mean")).alias("peak_to_avg"), F.least(F.lit(10.0), ratio("std", "mean")).alias("cv"))
    shape = df.groupBy("series_id").agg(skewness0("value").alias("skewness"), kurtosis0("value").alias("kurtosis"))
    return reduce(lambda a, b: a.join(b, "series_id"), [core, shape, mad(df), entropy(df), outlier_ratio(df)])


def latency_profile(df: DataFrame) -> DataFrame:
    ms = F.col("value") * 1000
    got = df.groupBy("series_id").agg(F.percentile(ms, F.lit([0.5, 0.9, 0.95, 0.99, 0.25, 0.75])).alias("q"), F.max(ms).alias("max"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"))
    q = F.col("q")
    c = ratio("std", "mean")
    return got.select("series_id", q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p95"), q[3].alias("p99"), "max", "mean", "std", c.alias("cv"), (q[5] - q[4]).alias("iqr"), ratio(q[3], q[0]).alias("tail_ratio"), ratio(q[3] - q[0], q[0]).alias("tail_excess"), ratio("max", "mean").alias("max_to_mean"), (1 - F.least(F.lit(1.0), c)).alias("stability"))


def latency_buckets(df: DataFrame) -> DataFrame:
    """Counts by fixed bounds in ms; beyond the last they join it."""
    ms = F.col("value") * 1000
    bound = reduce(lambda w, b: w.when(ms <= b, b), BUCKETS_MS[:-1], F).otherwise(BUCKETS_MS[-1])
    return df.groupBy("series_id", bound.alias("bound_ms")).agg(F.count(F.lit(1)).alias("n"))


def by_hour(df: DataFrame) -> DataFrame:
    h = F.hour(F.col("ts").cast("timestamp")).alias("h")
    return df.groupBy("series_id", h).agg(F.avg("value").alias("avg"), F.max("value").alias("peak"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("k"))


def daily_pattern(df: DataFrame) -> DataFrame:
    hours = by_hour(df)
    m = hours.withColumn("m", F.percentile("avg", F.lit(0.5)).over(whole())).withColumn("s", F.stddev_pop("avg").over(whole())).withColumn("all", F.avg("avg").over(whole()))
    peak = F.col("avg") > F.greatest(F.col("m") + 0.5 * F.col("s"), 1.2 * F.col("m"))
    off = F.col("avg") < F.least(F.col("m") - 0.5 * F.col("s"), 0.8 * F.col("m"))
    night, work = F.col("h").isin(*NIGHT), F.col("h").between(9, 17)
    got = m.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.when(peak, F.col("h")))).alias("peak_hours"), F.array_sort(F.collect_list(F.when(off, F.col("h")))).alias("off_peak_hours"),
        ratio(F.max("avg"), F.min("avg")).alias("peak_to_off_peak"), (1 - ratio(F.avg(F.when(night, F.col("avg"))), F.avg(F.when(~night, F.col("avg"))), 1.0)).alias("night_drop"),
        ratio(F.avg(F.when(work, F.col("avg"))), F.avg(F.when(~work, F.col("avg")))).alias("business_ratio"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg(F.when((F.col("k") > 1) & (F.col("avg") > 0), F.col("std") / F.col("avg"))), F.lit(1.0))).alias("consistency"),
        F.when(F.count(F.lit(1)) >= 12, F.least(F.lit(1.0), 2 * F.avg((F.col("avg") / F.col("all") - 1) ** 2))).otherwise(0.0).alias("periodicity"),
    )
    return got.withColumn("strength", clamp((F.col("peak_to_off_peak") - 1) / 2, 0.0, 1.0))


def weekly_pattern(df: DataFrame) -> DataFrame:
    day = (F.dayofweek(F.col("ts").cast("timestamp")) - 1).alias("d")
    days = df.groupBy("series_id", day).agg(F.avg("value").alias("avg"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("k")).withColumn("all", F.avg("avg").over(whole()))
    weekend = F.col("d").isin(0, 6)
    got = days.groupBy("series_id").agg(
        F.avg(F.when(~weekend, F.col("avg"))).alias("weekday_avg"), F.avg(F.when(weekend, F.col("avg"))).alias("weekend_avg"), F.array_sort(F.collect_list(F.when(F.col("avg") > 1.2 * F.col("all"), F.col("d")))).alias("heavy_days"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg(F.when((F.col("k") > 1) & (F.col("avg") > 0), F.col("std") / F.col("avg"))), F.lit(1.0))).alias("consistency"), ratio(F.max("avg") - F.min("avg"), F.avg("avg")).alias("spread"),
    )
    return got.withColumn("weekend_drop", F.coalesce(1 - ratio("weekend_avg", "weekday_avg", None), F.lit(0.0))).withColumn("strength", clamp("spread", 0.0, 1.0))


def monthly_pattern(df: DataFrame) -> DataFrame:
    """Weeks of the month, for series of four weeks at least."""
    week = F.least(F.floor((F.dayofmonth(F.col("ts").cast("timestamp")) - 1) / 7), F.lit(4)).alias("w")
    weeks = df.withColumn("n", F.count(F.lit(1)).over(whole())).where("n >= 672").groupBy("series_id", week).agg(F.avg("value").alias("avg"))
    got = weeks.groupBy("series_id").agg(F.count(F.lit(1)).alias("weeks"), ratio(F.max("avg"), F.min("avg")).alias("peak_ratio"), ratio(F.max("avg") - F.min("avg"), F.avg("avg")).alias("strength")).where("weeks >= 3")
    return got.withColumn("monthly", F.col("strength") > 0.15)


def burstiness(df: DataFrame) -> DataFrame:
    r = df.withColumn("rv", F.var_pop("value").over(by_time().rowsBetween(-5, -1))).withColumn("p90", F.percentile("value", F.lit(0.9)).over(whole())).withColumn("i", F.row_number().over(by_time()))
    got = r.groupBy("series_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.percentile("value", F.lit([0.1, 0.5, 0.9])).alias("q"), cv(F.when(F.col("i") > 5, F.col("rv"))).alias("vv"), F.avg((F.col("value") > F.col("p90")).cast("double")).alias("top"))
    q, one = F.col("q"), F.lit(1.0)
    return got.select("series_id", (0.25 * F.least(one, ratio("v", F.col("m") ** 2)) + 0.30 * F.least(one, ratio(q[2] - q[0], q[1]) / 3) + 0.25 * F.least(one, "vv") + 0.20 * F.col("top")).alias("burstiness"))


def seasonality(df: DataFrame) -> DataFrame:
    """From 24 hourly means relative to their mean; absent hours count zero."""
    h = by_hour(df).groupBy("series_id").agg(F.sum("avg").alias("s1"), F.sum(F.col("avg") ** 2).alias("s2"), F.max("avg").alias("hi"), F.min("avg").alias("lo"), F.count(F.lit(1)).alias("k"))
    mean = F.col("s1") / 24
    variance = ratio(F.col("s2") / 24 - mean**2, mean**2)
    low = F.when(F.col("k") < 24, 0.0).otherwise(F.col("lo"))
    return h.select("series_id", (0.6 * F.least(F.lit(1.0), 2 * variance) + 0.4 * F.least(F.lit(1.0), ratio(F.col("hi") - low, mean) / 3)).alias("seasonality"))


def noise_level(df: DataFrame) -> DataFrame:
    r = df.withColumn("d", F.abs(F.col("value") - F.lag("value").over(by_time())))
    got = r.groupBy("series_id").agg(F.avg("d").alias("d"), F.avg("value").alias("m"), F.percentile("value", F.lit([0.25, 0.75])).alias("q"))
    return got.select("series_id", ((F.least(F.lit(1.0), ratio("d", "m")) + F.least(F.lit(1.0), ratio(F.col("q")[1] - F.col("q")[0], "m"))) / 2).alias("noise"))


def autocorrelation(df: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """acf_k for each lag and their 0.5, 0.3, 0.2 mean: lags in one window, one aggregate."""
    r = df.withColumn("m", F.avg("value").over(whole()))
    for k in lags:
        r = r.withColumn(f"l{k}", F.lag("value", k).over(by_time()))
    den = F.sum((F.col("value") - F.col("m")) ** 2)
    parts = [ratio(F.coalesce(F.sum((F.col("value") - F.col("m")) * (F.col(f"l{k}") - F.col("m"))), F.lit(0.0)), den).alias(f"acf_{k}") for k in lags]
    got = r.groupBy("series_id").agg(*parts)
    mix = sum((w * F.col(f"acf_{k}") for w, k in zip((0.5, 0.3, 0.2), lags, strict=False)), F.lit(0.0))
    return got.withColumn("autocorrelation", clamp(mix, -1.0, 1.0))


def trend_slope(df: DataFrame) -> DataFrame:
    r = df.withColumn("x", (F.row_number().over(by_time()) - 1).cast("double"))
    got = r.groupBy("series_id").agg(F.regr_slope("value", "x").alias("slope"), F.regr_r2("value", "x").alias("r2"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    got = got.select("series_id", "slope", "r2", "n", ratio("slope", "m").alias("relative_slope"))
    return got.withColumn("trend_strength", 0.5 * F.least(F.lit(1.0), F.abs("relative_slope") * F.sqrt("n") * 5) + 0.5 * F.coalesce("r2", F.lit(0.0)))


def trend(df: DataFrame, steps: int = 24) -> DataFrame:
    """Direction by two exponential means, the last ten against the ten before, half slopes, and a projection."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"].cast("double"))
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ts").desc()))
    half = F.ntile(2).over(by_time())
    r = df.withColumn("back", back).withColumn("half", half).withColumn("x", (F.row_number().over(by_time()) - 1).cast("double"))
    part = lambda k: F.regr_slope(F.when(F.col("half") == k, F.col("value")), F.when(F.col("half") == k, F.col("x")))
    got = r.groupBy("series_id").agg(ordered.alias("v"), F.avg(F.when(F.col("back") <= 10, F.col("value"))).alias("last10"), F.avg(F.when(F.col("back").between(11, 20), F.col("value"))).alias("prev10"), part(1).alias("slope_1"), part(2).alias("slope_2"), F.regr_slope("value", "x").alias("slope"), F.avg("value").alias("m"), F.max_by("value", "ts").alias("last"))
    got = got.withColumn("fast", ema(F.col("v"), 0.2)).withColumn("slow", ema(F.col("v"), 0.05))
    cross = ratio(F.col("fast") - F.col("slow"), "slow")
    return got.select("series_id", label((cross > 0.05, "increasing"), (cross < -0.05, "decreasing"), otherwise="stable").alias("direction"), "fast", "slow", ratio(F.col("last10") - F.col("prev10"), "prev10").alias("recent_change"), "slope_1", "slope_2", (F.col("last") * (1 + ratio("slope", "m") * steps)).alias("forecast"))


def correlation(qps: DataFrame, latency: DataFrame) -> DataFrame:
    """Correlation on equal times after trimming both axes at 1.5 IQR, lag-1 correlation, sensitivity."""
    both = qps.select("series_id", "ts", F.col("value").alias("x")).join(latency.select("series_id", "ts", F.col("value").alias("y")), ["series_id", "ts"])
    q = both.withColumn("qx", F.percentile("x", F.lit([0.25, 0.75])).over(whole())).withColumn("qy", F.percentile("y", F.lit([0.25, 0.75])).over(whole())).withColumn("y1", F.lead("y").over(by_time()))
    inside = lambda v, c: F.col(v).between(F.col(c)[0] - 1.5 * (F.col(c)[1] - F.col(c)[0]), F.col(c)[1] + 1.5 * (F.col(c)[1] - F.col(c)[0]))
    q = q.withColumn("ok", inside("x", "qx") & inside("y", "qy"))
    kept = lambda v: F.when(F.col("ok"), F.col(v))
    got = q.groupBy("series_id").agg(F.count(kept("x")).alias("k"), pearson(kept("x"), kept("y"), 2).alias("robust"), pearson("x", "y", 2).alias("plain"), pearson("x", "y1").alias("lag1"))
    r = F.coalesce(F.when(F.col("k") >= 5, F.col("robust")).otherwise(F.col("plain")), F.lit(0.0))
    return got.select("series_id", r.alias("correlation"), F.coalesce("lag1", F.lit(0.0)).alias("lag1_correlation"), label((F.abs(r) > 0.5, "high"), (F.abs(r) > 0.3, "medium"), otherwise="low").alias("sensitivity"))


def instance_skew(df: DataFrame, value: str = "value") -> DataFrame:
    """Skew of instance means: variation, hot (over 1.3) and cold (under 0.7) instances, risk."""
    means = df.groupBy("series_id", "instance").agg(F.avg(value).alias("m")).withColumn("all", F.avg("m").over(whole()))
    got = means.groupBy("series_id").agg(cv("m").alias("skew"), F.array_sort(F.collect_list(F.when(F.col("m") > 1.3 * F.col("all"), F.col("instance")))).alias("hot"), F.array_sort(F.collect_list(F.when(F.col("m") < 0.7 * F.col("all"), F.col("instance")))).alias("cold"), F.count(F.lit(1)).alias("instances"))
    return got.withColumn("risk", label((F.col("skew") > 0.5, "high"), (F.col("skew") > 0.3, "medium"), otherwise="low"))


def load_class(mean: Column) -> Column:
    return label((mean < 50, "very_low"), (mean < 200, "low"), (mean < 1000, "medium"), (mean < 5000, "high"), (mean < 20000, "very_high"), otherwise="extreme")


def traffic_type(r: dict[str, Column]) -> Column:
    """First label that fits; r holds the columns it is decided on."""
    bursty = (r["peak"] > 4) | (r["burst"] > 0.4)
    return label(
        ((r["ratio"] > 2) & (F.abs(r["weekend"]) > 0.15) & (r["business"] > 1.15), "business_traffic"), ((r["ratio"] > 1.4) & r["weekly"], "periodic_with_weekly_variation"), (r["ratio"] > 1.4, "daily_periodic"),
        ((r["cv"] < 0.15) & (r["peak"] < 2), "constant"), (bursty & (r["cv"] > 0.5), "highly_bursty"), (bursty, "bursty"), ((r["cv"] > 0.5) & (r["burst"] > 0.5), "unpredictable"),
        ((r["season"] > 0.3) & (r["strength"] > 0.2), "multimodal"), (r["cv"] > 0.5, "variable"), otherwise="mixed",
    )


def stability(c: Column, trend_: Column, acf1: Column, changes: Column, periodicity: Column) -> Column:
    score = F.when(c < 0.1, 2.0).when(c < 0.25, 1.5).when(c < 0.45, 1.0).when(c < 0.7, 0.5).otherwise(0.0)
    score = score + F.when(trend_ < 0.1, 1.0).when(trend_ < 0.3, 0.5).otherwise(0.0) + F.when(acf1 > 0.7, 0.5).otherwise(0.0)
    score = score + F.when(changes == 0, 0.5).when(changes > 3, -0.5).otherwise(0.0) + F.when(periodicity > 0.5, 0.5).when(periodicity > 0.3, 0.25).otherwise(0.0)
    return label((score >= 3.5, "very_stable"), (score >= 2.5, "stable"), (score >= 1.5, "moderate"), (score >= 0.5, "variable"), otherwise="highly_variable")


def change_point_count(df: DataFrame) -> DataFrame:
    """Hits of two windows of 15 that differ (t over 3.5, a fifth of the mean), 20 places apart at least."""
    left, right = by_time().rowsBetween(-15, -1), by_time().rowsBetween(0, 14)
    r = df.withColumn("i", F.row_number().over(by_time()) - 1).withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("m", F.avg("value").over(whole()))
    gap = F.abs(F.avg("value").over(right) - F.avg("value").over(left))
    pooled = F.sqrt((F.var_pop("value").over(left) + F.var_pop("value").over(right)) / 15)
    r = r.withColumn("hit", (F.col("i") >= 15) & (F.col("i") <= F.col("n") - 15) & (gap > 3.5 * pooled) & (gap >= 0.2 * F.abs("m")))
    places = F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("i"))))
    first = F.struct(F.lit(-20).alias("last"), F.lit(0).alias("k"))
    fold = F.aggregate("places", first, lambda a, x: F.when(x - a["last"] >= 20, F.struct(x.alias("last"), (a["k"] + 1).alias("k"))).otherwise(F.struct(a["last"].alias("last"), a["k"].alias("k"))))
    return r.groupBy("series_id").agg(places.alias("places")).select("series_id", fold["k"].alias("change_points"))


def load_profile(qps: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Everything above in one row per series, with labels and scores. The series are staged once; the parts are small
    and made at the same time."""
    qps, *more = staged_all([x for x in (qps, latency) if x is not None], "series")
    latency = more[0] if more else None
    prefix = lambda df, p: df.select("series_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "series_id"])
    parts = [prefix(qps_profile(qps), "qps"), prefix(daily_pattern(qps), "daily"), prefix(weekly_pattern(qps), "weekly"), burstiness(qps), seasonality(qps), noise_level(qps), autocorrelation(qps), prefix(trend_slope(qps), "trend"), change_point_count(qps), prefix(trend(qps), "outlook"), prefix(monthly_pattern(qps), "monthly")]
    if latency is not None:
        parts += [prefix(latency_profile(latency), "latency"), prefix(correlation(qps, latency), "cross")]
    out = reduce(lambda a, b: a.join(b, "series_id", "left"), staged_all(parts, "profile"))
    r = {"ratio": F.col("daily_peak_to_off_peak"), "weekend": F.col("weekly_weekend_drop"), "business": F.col("daily_business_ratio"), "weekly": F.col("weekly_strength") > 0.15, "cv": F.col("qps_cv"), "peak": F.col("qps_peak_to_avg"), "burst": F.col("burstiness"), "season": F.col("seasonality"), "strength": F.col("daily_strength")}
    strength = 0.5 * F.col("daily_strength") + 0.3 * F.col("weekly_strength") + 0.2 * F.coalesce("monthly_strength", F.lit(0.0))
    top = F.greatest("daily_strength", "weekly_strength", F.coalesce("monthly_strength", F.lit(0.0)))
    out = out.withColumn("periodicity", strength).withColumn("dominant_period", label((top < 0.1, "none"), (top == F.col("daily_strength"), "daily"), (top == F.col("weekly_strength"), "weekly"), otherwise="monthly"))
    out = out.withColumn("load_class", load_class(F.col("qps_mean"))).withColumn("traffic_type", traffic_type(r)).withColumn("stability", stability(F.col("qps_cv"), F.col("trend_trend_strength"), F.col("acf_1"), F.col("change_points"), F.col("daily_periodicity")))
    peak = F.least(F.lit(1.0), F.col("qps_peak_to_avg") / 10)
    out = out.withColumn("efficiency", 0.3 * ratio("qps_mean", "qps_max") + 0.25 * (1 - peak) + 0.25 * (1 - F.least(F.lit(1.0), F.col("qps_cv"))) + F.when(F.col("qps_cv") < 0.3, 0.2).otherwise(0.1))
    lat = F.col("latency_tail_ratio") if latency is not None else F.lit(0.0)
    score = F.when(F.col("qps_cv") > 0.5, 0.3).otherwise(0.0) + F.when(F.col("qps_outlier_ratio") > 0.05, 0.3).otherwise(0.0) + F.when(lat > 5, 0.2).otherwise(0.0) + F.when(F.col("change_points") > 3, 0.2).otherwise(0.0)
    return out.withColumn("anomaly_score", F.least(F.lit(1.0), score))


