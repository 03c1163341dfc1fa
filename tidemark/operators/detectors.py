"""Anomaly detectors that are aggregates, windows and joins.

Input of each: (series_id, ts, value), of any number of series. Output: the ANOMALY columns of ``ANOMALY``.
Durations are seconds everywhere; hours are UTC. Absolute floors are parameters with their usual defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.stats import clamp, graded, mad_of, median_of, ratio, severity, severity_rank
from tidemark.operators.rolling import trailing
from tidemark.operators.series import sample_interval, seconds

ANOMALY = ("series_id", "type", "severity", "ts", "end_ts", "duration_sec", "value", "baseline", "z_score", "confidence", "detected_by", "instance", "detail")
KEY = ["series_id"]
NIGHT = (22, 23, 0, 1, 2, 3, 4, 5)


def whole() -> WindowSpec:
    """All rows of a series. (A function, as workers import this module without a session.)"""
    return Window.partitionBy("series_id")


def by_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ts")


def side(value: Column | str = "value", baseline: Column | str = "baseline") -> Column:
    value, baseline = (F.col(x) if isinstance(x, str) else x for x in (value, baseline))
    return F.when(value >= baseline, "QPS_SPIKE").otherwise("QPS_DROP")


def anomalies(df: DataFrame, detector: str, type_: Column | None = None, severity_: Column | str = "MEDIUM", baseline: Column | str = "baseline", z: Column | None = None, confidence: Column | float | None = None, value: Column | str = "value", end_ts: Column | None = None, instance: Column | None = None, detail: Column | None = None, duration: Column | None = None) -> DataFrame:
    """Rows in the common shape; the optional parts are null."""
    col = lambda x, kind: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(kind)
    base = F.col(baseline) if isinstance(baseline, str) else baseline
    val = F.col(value) if isinstance(value, str) else value
    sev = F.lit(severity_) if isinstance(severity_, str) else severity_
    made = [
        F.col("series_id"), (type_ if type_ is not None else side(val, base)).alias("type"), sev.alias("severity"), F.col("ts").cast("timestamp").alias("ts"), col(end_ts, "timestamp").alias("end_ts"),
        (col(duration, "int") if duration is not None else F.lit(0).cast("int")).alias("duration_sec"), val.cast("double").alias("value"), base.cast("double").alias("baseline"), col(z, "double").alias("z_score"),
        col(confidence, "double").alias("confidence"), F.array(F.lit(detector)).alias("detected_by"), col(instance, "string").alias("instance"), (detail if detail is not None else F.lit(detector)).alias("detail"),
    ]
    return df.select(*made)


def hour(ts: str = "ts") -> Column:
    return F.hour(F.col(ts).cast("timestamp"))


def series_stats(df: DataFrame) -> DataFrame:
    """Per series what most detectors need, in one aggregate."""
    return df.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.median("value").alias("m"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("s"), F.percentile("value", F.lit([0.25, 0.5, 0.75, 0.9, 0.95, 0.99])).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


def with_median_mad(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Add n, m (median), mad, mu and s; one exchange for both passes."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("m", F.percentile("value", F.lit(0.5)).over(w)).withColumn("mu", F.avg("value").over(w)).withColumn("s", F.stddev_pop("value").over(w))
    return df.withColumn("mad", F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).over(w))


# core detectors -------------------------------------------------------------------------------------------

def traffic_class(mean: Column) -> Column:
    return F.when(mean < 50, "very_low").when(mean < 200, "low").when(mean < 1000, "medium").when(mean < 10000, "high").otherwise("very_high")


def adjust_factor(level: Column) -> Column:
    return F.when(level == "very_low", 3.0).when(level == "low", 2.0).when(level == "medium", 1.5).when(level == "high", 1.2).otherwise(1.0)


def core_input(df: DataFrame, min_median: float = 10, min_cv: float = 0.1) -> DataFrame:
    """Rows of series that the core detectors take, with m, s and the factor k of their traffic level."""
    stats = series_stats(df).where((F.col("n") >= 10) & (F.col("m") >= min_median) & (F.col("s") >= min_cv * F.col("m")))
    stats = stats.withColumn("k", adjust_factor(traffic_class(F.col("mu")))).select("series_id", "n", "m", "s", "k")
    return df.join(stats, "series_id")


def night_hours(df: DataFrame) -> DataFrame:
    """(series_id, h) to leave out of drops: hours below 0.6 of the median in series with a daily pattern."""
    hourly = df.groupBy("series_id", hour().alias("h")).agg(F.avg("value").alias("a"))
    night = F.col("h").isin(*NIGHT)
    pattern = hourly.groupBy("series_id").agg(F.count(F.lit(1)).alias("hours"), F.avg(F.when(night, F.col("a"))).alias("dark"), F.avg(F.when(~night, F.col("a"))).alias("light"))
    totals = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("m"))
    daily = pattern.join(totals, "series_id").where((F.col("n") >= 48) & (F.col("hours") >= 12) & (F.col("light") > 0) & (F.col("dark") / F.when(F.col("light") > 0, F.col("light")) < 0.7))
    return hourly.join(daily.select("series_id", "m"), "series_id").where("a < 0.6 * m").select("series_id", "h")


def core_drops(df: DataFrame, min_median: float = 10, small: float = 500, busy: float = 100, min_cv: float = 0.1) -> DataFrame:
    rows = core_input(df, min_median, min_cv).withColumn("h", hour()).join(night_hours(df), ["series_id", "h"], "left_anti")
    drop = (F.col("m") - F.col("value")) / F.col("m")
    rows = rows.where((F.col("value") <= F.col("m") - 1.5 * F.col("k") * F.col("s")) & (drop >= 0.3) & ~((F.col("m") - F.col("value") < 0.5 * F.col("m")) & (F.col("m") < small)))
    sev = F.when((drop > 0.9) | ((F.col("value") == 0) & (F.col("m") > busy)), "CRITICAL").when(drop > 0.7, "HIGH").otherwise("MEDIUM")
    return anomalies(rows, "CoreDrop", F.lit("QPS_DROP"), sev, "m", (F.col("value") - F.col("m")) / F.col("s"))


def core_spikes(df: DataFrame, min_median: float = 10, small: float = 500, floor: float = 200, min_cv: float = 0.1) -> DataFrame:
    rows = core_input(df, min_median, min_cv)
    times = F.col("value") / F.col("m")
    rows = rows.where((F.col("value") >= F.col("m") + 2 * F.col("k") * F.col("s")) & (times >= 1.5 + 0.3 * F.col("k")) & ~((F.col("value") - F.col("m") < 0.5 * F.col("m")) & (F.col("m") < small)) & (F.col("value") >= floor))
    return anomalies(rows, "CoreSpike", F.lit("QPS_SPIKE"), graded(times, 3, 5), "m", (F.col("value") - F.col("m")) / F.col("s"))


def core_sustained(df: DataFrame, min_median: float = 10, busy: float = 100, min_cv: float = 0.1) -> DataFrame:
    """Windows of six rows every three: mean far below or above the median."""
    rows = core_input(df, min_median, min_cv).where("n >= 24").withColumn("i", F.row_number().over(by_time()) - 1)
    frame = by_time().rowsBetween(-6, -1)
    rows = rows.withColumn("mean", F.avg("value").over(frame)).withColumn("first", F.first("ts").over(frame)).withColumn("last", F.last("ts").over(frame)).where("i >= 6 and i % 3 = 0")
    low = (F.col("mean") < 0.4 * F.col("k") * F.col("m")) & (F.col("m") > busy)
    high = F.col("mean") > 2 * F.col("k") * F.col("m")
    sev = F.when(low & (F.col("mean") < 0.2 * F.col("m")), "HIGH").when(~low & (F.col("mean") > 3 * F.col("m")), "HIGH").otherwise("MEDIUM")
    rows = rows.where(low | high).withColumn("ts", F.col("first"))
    return anomalies(rows, "CoreSustained", F.when(low, "SUSTAINED_LOW_QPS").otherwise("SUSTAINED_HIGH_QPS"), sev, "m", (F.col("mean") - F.col("m")) / F.col("s"), value="mean", end_ts=F.col("last"), duration=seconds("last") - seconds("first"))


def core_all(df: DataFrame) -> DataFrame:
    from tidemark.operators.events import anchored_merge

    return anchored_merge(core_drops(df).unionByName(core_spikes(df)).unionByName(core_sustained(df)))


def latency_anomalies(p99: DataFrame, least: float = 0.01) -> DataFrame:
    stats = series_stats(p99).select("series_id", "n", "m", "s", F.col("q")[3].alias("p90"))
    rows = p99.join(stats, "series_id").where((F.col("n") >= 10) & (F.col("value") > F.when(F.col("m") < least, 5.0).otherwise(2.5) * F.col("m")) & (F.col("value") - F.col("m") >= least) & (F.col("value") >= 1.2 * F.col("p90")))
    times = ratio("value", "m")
    rows = rows.withColumn("sev", graded(times, 4, 10))
    return anomalies(rows, "Latency", F.lit("LATENCY_SPIKE"), F.col("sev"), F.col("m") * 1000, (F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")), value=F.col("value") * 1000)


def imbalance(df: DataFrame, floor: float = 10, least: float = 0.5, high: float = 0.7, critical: float | None = None, scale: float = 1.0, type_: str = "INSTANCE_IMBALANCE") -> DataFrame:
    """Instances whose mean deviates from their group's; input has an ``instance`` column."""
    means = df.groupBy("series_id", "instance").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.max("ts").alias("last")).where((F.col("n") >= 10) & (F.col("value") >= floor))
    means = means.withColumn("baseline", F.avg("value").over(whole())).withColumn("k", F.count(F.lit(1)).over(whole()))
    deviation = F.col("value") / F.col("baseline") - 1
    rows = means.where((F.col("k") >= 2) & (F.abs(deviation) >= least))
    return anomalies(rows, "Imbalance", F.lit(type_), graded(F.abs(deviation), high, critical), F.col("baseline") * scale, deviation, value=F.col("value") * scale, end_ts=F.col("last"), instance=F.col("instance"))


def category_imbalance(df: DataFrame, latency: bool = False) -> DataFrame:
    """Per (series_id, category): imbalance of load or latency between instances."""
    keyed = df.withColumn("series_id", F.concat_ws("/", "series_id", "category"))
    return imbalance(keyed, 0.001 if latency else 10, 0.8 if latency else 0.5, 1.5 if latency else 0.7, 2.0 if latency else 1.0, 1000.0 if latency else 1.0, "LATENCY_IMBALANCE" if latency else "LOAD_IMBALANCE")


# robust and seasonal ---------------------------------------------------------------------------------------

def mad_anomalies(df: DataFrame, least: float = 3.5, detector: str = "MAD") -> DataFrame:
    """Robust z beyond 3.5; a zero deviation falls back on the standard deviation."""
    rows = with_median_mad(df)
    z = F.abs(F.col("value") - F.col("m")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("s") > 0, F.col("s"))
    rows = rows.where("n >= 10").withColumn("z", z).where(F.col("z") > least)
    return anomalies(rows, detector, None, graded("z", 1.5 * least, 2 * least), "m", F.col("z"))


def centred_median_trend(df: DataFrame, half: int = 3) -> DataFrame:
    """Rolling median, then a Gaussian kernel exp(-d^2 / half^2), both truncated at the ends."""
    df = df.withColumn("__med", F.percentile("value", F.lit(0.5)).over(by_time().rowsBetween(-half, half)))
    return gaussian(df, "__med", half, "trend").drop("__med")


def gaussian(df: DataFrame, column: str, half: int, out: str) -> DataFrame:
    terms, weights = [], []
    for d in range(-half, half + 1):
        x = F.lag(column, -d).over(by_time())
        w = float(pow(2.718281828459045, -(d * d) / (half * half)))
        terms.append(F.coalesce(x * w, F.lit(0.0)))
        weights.append(F.when(x.isNotNull(), w).otherwise(0.0))
    return df.withColumn(out, reduce(Column.__add__, terms) / reduce(Column.__add__, weights))


def decompose(df: DataFrame, period: int = 24, half: int = 3) -> DataFrame:
    """(series_id, ts, value, trend, seasonal, residual) for series of two periods at least."""
    df = df.withColumn("__n", F.count(F.lit(1)).over(whole())).where(F.col("__n") >= 2 * period)
    df = centred_median_trend(df, half).withColumn("__phase", (F.row_number().over(by_time()) - 1) % period)
    phase = Window.partitionBy("series_id", "__phase")
    df = df.withColumn("__mean", F.avg(F.col("value") - F.col("trend")).over(phase)).withColumn("__size", F.count(F.lit(1)).over(phase))
    # The mean over phases, each counting once.
    df = df.withColumn("__centre", F.sum(F.col("__mean") / F.col("__size")).over(whole()) / period)
    df = df.withColumn("seasonal", F.col("__mean") - F.col("__centre")).withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
    return df.select("series_id", "ts", "value", "trend", "seasonal", "residual")


def decomposition_anomalies(df: DataFrame, period: int = 24, least: float = 3.5) -> DataFrame:
    parts = decompose(df, period).withColumnRenamed("value", "original").withColumnRenamed("residual", "value")
    rows = with_median_mad(parts)
    z = F.abs(F.col("value") - F.col("m")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("s") > 0, F.col("s"))
    rows = rows.withColumn("z", z).where(F.col("z") > least).withColumn("baseline", F.col("trend") + F.col("seasonal"))
    return anomalies(rows, "STL", None, graded("z", 1.5 * least, 2 * least), "baseline", F.col("z"), value="original")


def hourly_baseline(df: DataFrame, least: float = 3.0) -> DataFrame:
    """z against the mean and deviation of the same hour of day."""
    w = Window.partitionBy("series_id", "h")
    rows = df.withColumn("h", hour()).withColumn("baseline", F.avg("value").over(w)).withColumn("s", F.stddev_pop("value").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("hours", F.size(F.collect_set("h").over(whole())))
    rows = rows.where((F.col("n") >= 20) & (F.col("hours") >= 8) & (F.col("k") >= 2) & (F.col("s") > 0)).withColumn("z", F.abs(F.col("value") - F.col("baseline")) / F.col("s")).where(F.col("z") > least)
    return anomalies(rows, "HourlyBaseline", None, graded("z", 1.5 * least), "baseline", F.col("z"))


def volatility(df: DataFrame, least: float = 3.0) -> DataFrame:
    """Coefficient of variation over the next six rows, far above its median."""
    frame = by_time().rowsBetween(0, 5)
    rows = df.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("k", F.count(F.lit(1)).over(frame)).withColumn("mean", F.avg("value").over(frame)).withColumn("dev", F.stddev_pop("value").over(frame))
    rows = rows.where("n >= 20 and k = 6 and mean > 0").select("series_id", "ts", (F.col("dev") / F.col("mean")).alias("value"))
    rows = with_median_mad(rows).where("mad > 0").withColumn("z", (F.col("value") - F.col("m")) / (1.4826 * F.col("mad"))).where(F.col("z") > least)
    return anomalies(rows, "Volatility", F.lit("VOLATILITY_SPIKE"), graded("z", 5.0), "m", F.col("z"))


def sustained_residual(df: DataFrame, period: int = 24, least: float = 2.5) -> DataFrame:
    """Windows of half a period whose mean residual lies off."""
    size = max(4, period // 2)
    step = size // 2
    frame = by_time().rowsBetween(-size, -1)
    rows = decompose(df, period).withColumn("mu", F.avg("residual").over(whole())).withColumn("s", F.stddev_pop("residual").over(whole())).withColumn("i", F.row_number().over(by_time()) - 1)
    rows = rows.withColumn("r", F.avg("residual").over(frame)).withColumn("mean", F.avg("value").over(frame)).withColumn("base", F.avg(F.col("trend") + F.col("seasonal")).over(frame)).withColumn("first", F.first("ts").over(frame)).withColumn("last", F.last("ts").over(frame))
    rows = rows.where((F.col("i") >= size) & ((F.col("i") - size) % step == 0) & (F.col("s") > 0)).withColumn("z", F.abs(F.col("r") - F.col("mu")) / F.col("s")).where(F.col("z") > least).withColumn("ts", F.col("first"))
    return anomalies(rows, "SustainedResidual", F.when(F.col("r") > 0, "SUSTAINED_HIGH_QPS").otherwise("SUSTAINED_LOW_QPS"), graded("z", 3.5), "base", F.col("z"), value="mean", end_ts=F.col("last"), duration=seconds("last") - seconds("first"))


def contextual(df: DataFrame, least: float = 3.0) -> DataFrame:
    """Mean robust z over the contexts hour, weekday and hour of week that have five samples and a deviation."""
    ts = F.col("ts").cast("timestamp")
    rows = df.withColumn("c1", F.hour(ts)).withColumn("c2", F.dayofweek(ts) - 1).withColumn("c3", F.col("c2") * 24 + F.col("c1")).withColumn("n", F.count(F.lit(1)).over(whole())).where("n >= 35")
    scores, bases = [], []
    for c in ("c1", "c2", "c3"):
        w = Window.partitionBy("series_id", c)
        rows = rows.withColumn(f"m_{c}", F.percentile("value", F.lit(0.5)).over(w)).withColumn(f"k_{c}", F.count(F.lit(1)).over(w))
        rows = rows.withColumn(f"d_{c}", 1.4826 * F.percentile(F.abs(F.col("value") - F.col(f"m_{c}")), F.lit(0.5)).over(w))
        good = (F.col(f"k_{c}") >= 5) & (F.col(f"d_{c}") > 0)
        scores.append(F.when(good, F.abs(F.col("value") - F.col(f"m_{c}")) / F.when(good, F.col(f"d_{c}"))))
        bases.append(F.when(good, F.col(f"m_{c}")))
    mean = lambda xs: F.try_divide(reduce(Column.__add__, [F.coalesce(x, F.lit(0.0)) for x in xs]), reduce(Column.__add__, [x.isNotNull().cast("int") for x in xs]))
    rows = rows.withColumn("z", mean(scores)).withColumn("baseline", mean(bases)).where(F.col("z") > least)
    return anomalies(rows, "Contextual", None, graded("z", 1.5 * least, 2 * least), "baseline", F.col("z"))


def _frame_mad(df: DataFrame, frame, value: str = "value") -> DataFrame:
    df = df.withColumn("__f", F.array_sort(F.collect_list(value).over(frame)))
    return df.withColumn("fm", median_of(F.col("__f"))).withColumn("fd", mad_of(F.col("__f"), F.col("fm")))


def dynamic_threshold_states(df: DataFrame, window: int = 24, period: int = 24) -> DataFrame:
    """Per point: base, upper and lower bound from the trailing window and the seasonal pattern."""
    rows = df.withColumn("i", F.row_number().over(by_time()) - 1)
    frame = by_time().rowsBetween(-(window - 1), 0)
    rows = _frame_mad(rows, frame).withColumn("mean", F.avg("value").over(frame)).withColumn("dev", F.stddev_pop("value").over(frame))
    rows = rows.withColumn("detrended", F.col("value") - F.percentile("value", F.lit(0.5)).over(by_time().rowsBetween(-12, 12)))
    phase = Window.partitionBy("series_id", F.col("i") % period)
    rows = rows.withColumn("p", F.avg("detrended").over(phase)).withColumn("size", F.count(F.lit(1)).over(phase))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("centre", F.sum(F.col("p") / F.col("size")).over(whole()) / F.least(F.lit(period), "n"))
    spread = F.when(F.col("fd") > 0, 1.4826 * F.col("fd")).otherwise(0.01 * F.abs(F.col("fm")))
    wild = ratio("dev", "mean")
    rows = rows.withColumn("seasonal", F.col("p") - F.col("centre")).withColumn("spread", spread).withColumn("factor", F.when(wild > 0.5, 1.5).when(wild > 0.3, 1.2).otherwise(1.0))
    reach = 3 * F.col("spread") * F.col("factor")
    return rows.select("series_id", "ts", "i", "value", F.col("fm").alias("base"), "seasonal", "spread", "factor", (F.col("fm") + reach + F.col("seasonal")).alias("upper"), (F.col("fm") - reach + F.col("seasonal")).alias("lower"))


def dynamic_threshold(df: DataFrame) -> DataFrame:
    rows = dynamic_threshold_states(df).where("i >= 10 and spread > 0 and (value > upper or value < lower)")
    rows = rows.withColumn("z", F.abs(F.col("value") - F.col("base")) / (F.col("spread") * F.col("factor")))
    return anomalies(rows, "DynamicThreshold", None, F.when(F.col("z") > 3 * 3, "CRITICAL").when(F.col("z") > 2 * 3, "HIGH").otherwise("MEDIUM"), "base", F.col("z"))


def scale_scores(df: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """Add to each row its place i, the number of rows n, and for every scale z<scale>: the distance from the full window
    plus half the left-right contrast, 0 where the window is not whole."""
    rows = df.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("i", F.row_number().over(by_time()) - 1)
    for s in scales:
        h = s // 2
        full, left, right = by_time().rowsBetween(-h, h), by_time().rowsBetween(-h, -1), by_time().rowsBetween(1, h)
        sd = F.stddev_pop("value").over(full)
        contrast = F.abs(F.avg("value").over(left) - F.avg("value").over(right))
        both = F.sqrt(F.var_pop("value").over(left) + F.var_pop("value").over(right))
        score = F.when(sd > 0, F.abs(F.col("value") - F.avg("value").over(full)) / F.when(sd > 0, sd) + 0.5 * F.when(both > 0, contrast / F.when(both > 0, both)).otherwise(contrast)).otherwise(0.0)
        rows = rows.withColumn(f"z{s}", F.when((F.col("i") >= h) & (F.col("i") < F.col("n") - h), score).otherwise(0.0))
    return rows


def multi_scale(df: DataFrame, scales: tuple[int, ...] = (6, 12, 24, 48), least: float = 3.0) -> DataFrame:
    """Points off at two scales at least: distance from the full window plus half the left-right contrast."""
    rows = scale_scores(df, scales).withColumn("baseline", F.percentile("value", F.lit(0.5)).over(whole())).where("n >= 96")
    names = [f"z{s}" for s in scales]
    hits = reduce(Column.__add__, [(F.col(x) > least).cast("int") for x in names])
    total = reduce(Column.__add__, [F.when(F.col(x) > least, F.col(x)).otherwise(0.0) for x in names])
    rows = rows.withColumn("hits", hits).where("hits >= 2").withColumn("z", total / F.col("hits"))
    return anomalies(rows, "MultiScale", None, F.when(F.col("hits") >= 4, "CRITICAL").when(F.col("hits") == 3, "HIGH").otherwise("MEDIUM"), "baseline", F.col("z"))


# raw sources -----------------------------------------------------------------------------------------------

def raw_rolling(df: DataFrame, type_: str | None = None, detector: str = "RawRolling", latency: bool = False, window: int = 60, run: int = 3) -> DataFrame:
    """Runs of ``run`` points at least that lie six robust deviations off the previous ``window`` rows."""
    stats = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("gm")).where("n >= 80")
    rows = trailing(df, KEY, window).where(F.col("before") == window).join(stats, "series_id")
    least = F.greatest(F.lit(0.02), 0.5 * F.col("gm")) if latency else F.when(F.col("gm") < 1, 5.0).otherwise(F.greatest(F.lit(0.2), 0.1 * F.col("gm")))
    rows = rows.withColumn("z", (F.col("value") - F.col("med")) / (1.4826 * F.col("dev") + 1e-9)).where((F.abs("z") >= 6) & (F.abs(F.col("value") - F.col("med")) >= least))
    return _grouped(rows, df, run, detector, type_, F.abs("z"), F.col("med"), F.col("z"), lambda z: clamp(0.55 + F.least(F.lit(0.35), z / 30), 0, 0.95), lambda z: graded(z, 9 - 1e-12, 12 - 1e-12))


def _grouped(rows: DataFrame, df: DataFrame, least: int, detector: str, type_: str | None, rank: Column, base: Column, z: Column, confidence, sev) -> DataFrame:
    """Runs of flagged points with gaps of three steps at most, told by their strongest point."""
    rows = rows.withColumn("__rank", rank).withColumn("__base", base).withColumn("__z", z).join(sample_interval(df, KEY), "series_id")
    t = seconds("ts")
    rows = rows.withColumn("__new", F.coalesce((t - F.lag(t).over(by_time()) > 3 * F.col("step")).cast("int"), F.lit(1))).withColumn("__id", F.sum("__new").over(by_time()))
    top = lambda c: F.max_by(c, "__rank")
    got = rows.groupBy("series_id", "__id").agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("ts"), F.max("ts").alias("last"), F.max("step").alias("step"), top("value").alias("value"), top("__base").alias("baseline"), top("__z").alias("z"), F.max("__rank").alias("rank"))
    got = got.where(F.col("k") >= least)
    kind = F.lit(type_) if type_ else side()
    return anomalies(got, detector, kind, sev(F.col("rank")), "baseline", F.col("z"), confidence(F.col("rank")), end_ts=F.col("last"), duration=seconds("last") - seconds("ts") + F.col("step"))


def sustained_latency(df: DataFrame, detector: str = "sustained_latency") -> DataFrame:
    """Runs of six points at least above max(1, 8 p50, 3 p75), half as much again for a long tail."""
    stats = series_stats(df).select("series_id", "n", F.greatest(F.lit(1.0), 8 * F.col("q")[1], 3 * F.col("q")[2]).alias("limit"), F.col("q")[2].alias("p75"), F.col("q")[5].alias("p99")).where("n >= 60")
    stats = stats.withColumn("limit", F.when(F.col("p99") > 5 * F.col("limit"), 1.5 * F.col("limit")).otherwise(F.col("limit")))
    rows = df.join(stats, "series_id").where("value >= limit")
    z = F.col("value") / F.col("limit")
    return _grouped(rows, df, 6, detector, "LATENCY_DEGRADED", z, F.col("p75"), z, lambda r: F.when(r >= 1.8, 0.85).otherwise(0.72), lambda r: F.lit("HIGH"))


# workload types ---------------------------------------------------------------------------------------------

def workload_type_anomalies(df: DataFrame, min_median: float = 50) -> DataFrame:
    """Per (series_id, key): drops and spikes of one statement type or operation."""
    keyed = df.withColumn("series_id", F.concat_ws("/", "series_id", "key"))
    rows = keyed.join(series_stats(keyed).select("series_id", "n", "m", "s"), "series_id").where((F.col("n") >= 10) & (F.col("m") >= min_median) & (F.col("s") >= 0.2 * F.col("m")))
    drop, times = (F.col("m") - F.col("value")) / F.col("m"), F.col("value") / F.col("m")
    low, high = (F.col("value") < F.col("m") - 2 * F.col("s")) & (drop >= 0.3), (F.col("value") > F.col("m") + 2 * F.col("s")) & (times >= 1.5)
    sev = F.when(low, F.when(drop > 0.7, "CRITICAL").when(drop > 0.5, "HIGH").otherwise("MEDIUM")).otherwise(graded(times, 2, 3))
    return anomalies(rows.where(low | high), "WorkloadType", None, sev, "m", (F.col("value") - F.col("m")) / F.col("s"))


def votes(df: DataFrame) -> DataFrame:
    """Findings of several detectors at one time as one row: worst severity, mean z, all names."""
    first = F.min_by(F.struct("type", "value", "baseline", "detail"), F.struct(F.col("detected_by"), F.col("type")))
    got = df.groupBy("series_id", "ts").agg(first.alias("f"), F.max(severity_rank("severity")).alias("r"), F.avg("z_score").alias("z_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("detected_by")))).alias("detected_by"), F.count(F.lit(1)).alias("hits"))
    detail = F.when(F.col("hits") >= 3, F.concat(F.col("f.detail"), F.lit(" (several methods)"))).otherwise(F.col("f.detail"))
    return got.select("series_id", F.col("f.type").alias("type"), severity("r").alias("severity"), "ts", F.col("f.value").alias("value"), F.col("f.baseline").alias("baseline"), "z_score", "detected_by", "hits", detail.alias("detail"))


def first_per_bucket(df: DataFrame, seconds_: int = 1800) -> DataFrame:
    """The first finding of every bucket of time."""
    bucket = F.floor(seconds("ts") / seconds_)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("series_id", bucket).orderBy("ts", "detected_by"))).where("__k = 1").drop("__k")


