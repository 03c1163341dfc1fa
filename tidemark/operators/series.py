"""Series construction: rates, histogram quantiles, islands and interval algebra.

Inputs are long tables. A series is a set of key columns; every window is partitioned by them, so consecutive
operators on the same keys share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import at


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def over(keys: Sequence[str], order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def counter_rate(df: DataFrame, keys: Sequence[str], on_reset: str = "restart", max_gap: float | None = None) -> DataFrame:
    """Per-second rate of a counter between neighbouring samples, stamped at the later one.

    A falling counter restarted: ``restart`` takes its new value as the increase, ``drop`` leaves the pair out.
    """
    w = over(keys)
    df = df.withColumn("__v", F.lag("value").over(w)).withColumn("__t", F.lag("ts").over(w)).where(F.col("__t").isNotNull() & (F.col("ts") > F.col("__t")))
    gap = seconds("ts") - seconds("__t")
    up = F.col("value") - F.col("__v")
    if on_reset == "restart":
        up = F.when(up < 0, F.col("value")).otherwise(up)
    out = df.select(*keys, "ts", (up / gap).alias("value"), gap.alias("__gap"))
    if on_reset == "drop":
        out = out.where("value >= 0")
    if max_gap is not None:
        out = out.where(F.col("__gap") <= max_gap)
    return out.drop("__gap")


def sum_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "ts").agg(F.sum("value").alias("value"))


def bucket_delta(df: DataFrame, keys: Sequence[str], both_sides: bool = False) -> DataFrame:
    """Increase of cumulative buckets (keys, ts, le, cum) between neighbouring times.

    A bucket that is new counts whole; a falling one is left out; times whose total did not rise go.
    ``both_sides`` keeps buckets that only the earlier time has (their increase is negative, so they go too).
    """
    ranked = df.withColumn("__k", F.dense_rank().over(over(keys)))
    before = ranked.select(*keys, "le", (F.col("__k") + 1).alias("__k"), F.col("cum").alias("__before"))
    joined = ranked.where("__k > 1").join(before, [*keys, "le", "__k"], "full" if both_sides else "left")
    if both_sides:
        joined = joined.where("ts is not null")
    delta = joined.withColumn("delta", F.col("cum") - F.coalesce("__before", F.lit(0.0))).where("delta >= 0")
    total = F.max(F.when(F.col("le") == float("inf"), F.col("delta"))).over(Window.partitionBy(*keys, "ts"))
    return delta.withColumn("__total", total).where("__total > 0").select(*keys, "ts", "le", "delta")


def histogram_quantile(df: DataFrame, keys: Sequence[str], q: float, value: str = "cum") -> DataFrame:
    """Quantile of cumulative buckets (keys, ts, le, value) by linear interpolation within the bucket."""
    w = Window.partitionBy(*keys, "ts").orderBy("le")
    every = Window.partitionBy(*keys, "ts")
    df = df.withColumn("__total", F.max(F.when(F.col("le") == float("inf"), F.col(value))).over(every))
    df = df.where((F.col("__total") > 0) & (F.col("le") < float("inf")))
    df = df.withColumn("__c0", F.coalesce(F.lag(value).over(w), F.lit(0.0))).withColumn("__l0", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    target, c, c0 = q * F.col("__total"), F.col(value), F.col("__c0")
    inside = F.when(c == c0, F.col("__l0")).otherwise(F.col("__l0") + (F.col("le") - F.col("__l0")) / F.when(c != c0, c - c0) * (target - c0))
    hit = F.when(c >= target, F.struct("le", inside.alias("v")))
    return df.groupBy(*keys, "ts").agg(F.coalesce(F.min(hit)["v"], F.max("le")).alias("value"))


def sample_interval(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upper median of positive gaps in seconds, within 60 to 900; 300 without gaps."""
    gaps = df.withColumn("g", seconds("ts") - F.lag(seconds("ts")).over(over(keys)))
    values = F.array_sort(F.collect_list(F.when(F.col("g") > 0, F.col("g").cast("long"))))
    got = gaps.groupBy(*keys).agg(values.alias("g"))
    middle = at(F.col("g"), F.floor(F.size("g") / 2))
    return got.select(*keys, F.when(middle.isNull(), 300).otherwise(F.greatest(F.lit(60), F.least(F.lit(900), middle))).cast("long").alias("step"))


def islands(df: DataFrame, keys: Sequence[str], gap: float = 300, start: str = "ts", end: str | None = None) -> DataFrame:
    """Runs without a gap above ``gap`` seconds: (keys, start_ts, end_ts, cnt)."""
    end = end or start
    w = over(keys, start)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((seconds(start) - (F.unix_micros(last.cast("timestamp")) / 1e6) > gap).cast("int"), F.lit(1)))
    df = df.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__id").agg(F.min(start).alias("start_ts"), F.max(end).alias("end_ts"), F.count(F.lit(1)).alias("cnt")).drop("__id")


def metric_info(df: DataFrame, keys: Sequence[str], gap: float = 300) -> DataFrame:
    return islands(df, keys, gap).groupBy(*keys).agg(F.min("start_ts").alias("min_ts"), F.max("end_ts").alias("max_ts"), F.sum("cnt").alias("samples"), (F.count(F.lit(1)) - 1).alias("gaps"))


def interval_union(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged half-open ranges (keys, start, end); touching ranges merge."""
    w = over(keys, "start")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.where("end > start").withColumn("__new", F.coalesce((F.col("start") > last).cast("int"), F.lit(1)))
    ranges = ranges.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy(*keys, "__id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__id")


def interval_gaps(request: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts of each requested range that no existing range covers, half-open."""
    merged = interval_union(existing, keys).select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    r = request.select(*keys, F.col("start").alias("rs"), F.col("end").alias("re"))
    clipped = merged.join(r, keys).where("e > rs and s < re").select(*keys, "rs", "re", F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e"))
    edges = clipped.union(r.select(*keys, "rs", "re", F.col("rs").alias("s"), F.col("rs").alias("e")))
    w = Window.partitionBy(*keys, "rs", "re").orderBy("s", "e")
    return edges.select(*keys, F.col("e").alias("start"), F.coalesce(F.lead("s").over(w), F.col("re")).alias("end")).where("end > start")


def interval_coverage(request: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered length of each requested range and its share in percent."""
    merged = interval_union(existing, keys).select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    joined = request.join(merged, keys, "left")
    covered = F.sum(F.greatest(F.lit(0), F.least("e", "end") - F.greatest("s", "start")))
    got = joined.groupBy(*keys, "start", "end").agg(F.coalesce(covered, F.lit(0)).alias("covered"))
    return got.withColumn("percent", F.col("covered") * 100.0 / (F.col("end") - F.col("start")))


def weighted_mean(value: str, weight: str) -> Column:
    total = F.sum(weight)
    return F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / F.when(total != 0, total)).otherwise(0.0)


def window_correlation(a: DataFrame, b: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of two series on equal times within each window (keys, id, start_ts, end_ts)."""
    from tidemark.functions.stats import pearson

    both = a.select(*keys, "ts", F.col("value").alias("x")).join(b.select(*keys, "ts", F.col("value").alias("y")), [*keys, "ts"])
    joined = windows.join(both, keys).where("ts between start_ts and end_ts")
    return joined.groupBy(*keys, "id").agg(pearson("x", "y").alias("corr"))
