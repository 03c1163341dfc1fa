"""Statistical primitives as column expressions: population moments and exact percentiles.

Every aggregate works in ``groupBy(...).agg`` with partial aggregation where Spark has it; expressions on sorted
arrays (``floor_percentile`` and what builds on it) take ``sorted_values``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b, otherwise: float | None = 0.0) -> Column:
    """a / b, ``otherwise`` where b is zero or null."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(otherwise).cast("double"))


def mean0(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def std0(x) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def cv(x) -> Column:
    return ratio(F.stddev_pop(x), F.avg(x))


def percentile(x, p: float) -> Column:
    """Linear interpolation at p (n - 1)."""
    return F.percentile(x, F.lit(p))


def skewness0(x) -> Column:
    return F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 0), F.skewness(x)).otherwise(0.0)


def kurtosis0(x) -> Column:
    return F.when((F.count(x) >= 4) & (F.stddev_pop(x) > 0), F.kurtosis(x)).otherwise(0.0)


def pearson(x, y, least: int = 3) -> Column:
    """Correlation; null under ``least`` pairs or without variance (where ``corr`` divides by zero, whatever guards it)."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    x, y = F.when(both, _c(x)), F.when(both, _c(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (spread > 0), clamp(F.try_divide(F.covar_pop(x, y), spread), -1.0, 1.0))


def sorted_values(x) -> Column:
    return F.array_sort(F.collect_list(x))


def at(values: Column, index: Column) -> Column:
    """Element of an array by zero-based index, null outside."""
    return F.get(values, index.cast("int"))


def floor_percentile(values: Column, p: int) -> Column:
    """Element floor((n - 1) p / 100) of a sorted array, without interpolation."""
    return at(values, F.floor((F.size(values) - 1) * p / 100))


def median_of(values: Column) -> Column:
    """Exact median of a sorted array."""
    n = F.size(values)
    return F.when(n > 0, (at(values, F.floor((n - 1) / 2)) + at(values, F.floor(n / 2))) / 2)


def mad_of(values: Column, centre: Column) -> Column:
    """Unscaled median absolute deviation of an array around ``centre``."""
    return median_of(F.array_sort(F.transform(values, lambda v: F.abs(v - centre))))


def ema(values: Column, alpha: float) -> Column:
    """Last value of an exponential average, seeded with the first."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: alpha * x + (1 - alpha) * a)


def clamp(x, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, _c(x)))


def label(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The text of the first rule that holds."""
    out = F
    for condition, text in rules:
        out = out.when(condition, F.lit(text))
    return out.otherwise(F.lit(otherwise))


def severity_rank(x) -> Column:
    x = _c(x)
    return F.when(x == "CRITICAL", 3).when(x == "HIGH", 2).when(x == "MEDIUM", 1).otherwise(0)


def severity(rank) -> Column:
    rank = _c(rank)
    return F.when(rank >= 3, "CRITICAL").when(rank == 2, "HIGH").when(rank == 1, "MEDIUM").otherwise("LOW")


def graded(x, high: float, critical: float | None = None, low: str = "MEDIUM") -> Column:
    """Severity of a score beyond its threshold."""
    x = _c(x)
    out = F.when(x > critical, "CRITICAL").when(x > high, "HIGH") if critical is not None else F.when(x > high, "HIGH")
    return out.otherwise(low)


def metric_type(name) -> Column:
    """Kind of a metric by the end of its name."""
    name = _c(name)
    return F.when(name.endswith("_bucket"), "histogram").when(F.regexp_like(name, F.lit("(_total|_count|_sum)$")), "counter").otherwise("gauge")


def is_bucket_metric(name) -> Column:
    name = F.lower(_c(name))
    return name.endswith("_bucket") | name.contains("latency") | name.contains("duration")


def average_path(n) -> Column:
    """Expected path length of an isolation tree over n points."""
    n = _c(n)
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(F.greatest(n, F.lit(2.0)) - 1) + 0.5772156649) - 2 * (n - 1) / n)
