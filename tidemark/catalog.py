"""Registered queries of the time-series operators and the SQL that must agree with them.

Times come out as epoch seconds and doubles rounded to six places, so that both sides have equal types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog_cluster, catalog_store, oracles
from tidemark.functions import stats as st
from tidemark.operators import changepoints as cp
from tidemark.operators import detectors as d
from tidemark.operators import events as ev
from tidemark.operators import grouped as g
from tidemark.operators import insight
from tidemark.operators.numbering import numbered
from tidemark.operators import profile as p
from tidemark.operators import series as s
from tidemark.operators import workload as w
from tidemark.oracles import BY_TYPE, C, GRADE, H, K, KIND, L, P, ROBUST, SIDE, STATS
from tidemark.plans import abnormal as ab
from tidemark.plans import dimensions as dim
from tidemark.plans import model as m
from tidemark.session import expiring, shared_folder, table
from tidemark.sources import prom, sinks
from tidemark.sources.ranged import range_name
from tidemark.streaming import ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["series_id"]


def shown(df: DataFrame) -> DataFrame:
    """Times as epoch seconds, doubles rounded, arrays as text."""
    made = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        c = F.unix_seconds(c) if kind == "timestamp" else F.unix_seconds(c.cast("timestamp")) if kind == "timestamp_ntz" else F.round(c, 6) if kind == "double" else c.cast("string") if kind in ("array<string>", "array<int>") else c
        made.append(c.alias(f.name))
    return df.select(*made)


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder), and its SQL."""

    def take(work):
        QUERIES[name] = lambda spark, sf_dir: shown(work(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return work

    return take


def planted(df: DataFrame) -> DataFrame:
    """The series with spikes, drops and a long rise in fixed hours."""
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    factor = F.when(h % 97 == 5, 6.0).when(h % 97 == 50, 0.02).when(h % 211 < 9, 4.0).otherwise(1.0)
    return df.withColumn("value", F.col("value") * factor)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted hourly load, its robust outliers."""
    return d.mad_anomalies(planted(m.hourly(spark, sf_dir)))


B = """e AS (SELECT date_trunc('hour', ts) AS ts, value FROM events), bounds AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE]) AS le),
n AS (SELECT ts, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS c FROM e, bounds GROUP BY ALL),
b AS (SELECT 'all' AS series_id, ts, le, sum(c) OVER (PARTITION BY le ORDER BY ts) AS cum FROM n)"""
def hits(table_: str, where: str, detector: str, type_: str, severity: str, baseline: str, z: str, value: str = "value") -> str:
    """SELECT of findings with the columns of ``found``."""
    return f"SELECT series_id, {type_} AS type, {severity} AS severity, floor(epoch(ts))::BIGINT AS ts, round({value}, 6) AS value, round({baseline}, 6) AS baseline, round({z}, 6) AS z_score FROM {table_} WHERE {where}"


def found(df: DataFrame) -> DataFrame:
    return df.select("series_id", "type", "severity", "ts", "value", "baseline", "z_score")


# series ------------------------------------------------------------------------------------------------------

@query("hourly_qps", f"WITH {H} SELECT series_id, floor(epoch(ts))::BIGINT AS ts, round(value / 3600, 6) AS value FROM h")
def _(spark, f):
    return m.hourly(spark, f).withColumn("value", F.col("value") / 3600)


@query("qps_by_type", f"WITH {BY_TYPE} SELECT series_id, floor(epoch(ts))::BIGINT AS ts, value FROM h")
def _(spark, f):
    return m.hourly(spark, f, "event_type")


RATE = "WITH {c}, d AS (SELECT *, lag(value) OVER w AS v0, lag(ts) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY key ORDER BY ts)) SELECT series_id, key, floor(epoch(ts))::BIGINT AS ts, round({r} / (epoch(ts) - epoch(t0)), 6) AS value FROM d WHERE t0 IS NOT NULL"


@query("counter_rate_reset", RATE.format(c=C, r="CASE WHEN value < v0 THEN value ELSE value - v0 END"))
def _(spark, f):
    return s.counter_rate(m.counters(spark, f), ["series_id", "key"])


@query("counter_rate_drop", RATE.format(c=C, r="(value - v0)") + " AND value >= v0")
def _(spark, f):
    return s.counter_rate(m.counters(spark, f), ["series_id", "key"], "drop")


@query("summed_rate", "WITH r AS (" + RATE.format(c=C, r="CASE WHEN value < v0 THEN value ELSE value - v0 END").replace("round(", "(").replace(", 6) AS value", ") AS value") + ") SELECT series_id, ts, round(sum(value), 6) AS value FROM r GROUP BY ALL")
def _(spark, f):
    return s.sum_series(s.counter_rate(m.counters(spark, f), ["series_id", "key"]), KEY)


@query("bucket_counts", f"WITH {B} SELECT series_id, floor(epoch(ts))::BIGINT AS ts, le, cum FROM b WHERE le < 'inf'")
def _(spark, f):
    return m.buckets(spark, f).where(F.col("le") < float("inf"))


DELTA = B + ", r AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS k FROM b), dl AS (SELECT r.series_id, r.ts, r.le, r.cum - coalesce(q.cum, 0) AS delta FROM r LEFT JOIN r q ON q.k = r.k - 1 AND q.le = r.le WHERE r.k > 1), dd AS (SELECT *, max(delta) FILTER (WHERE le = 'inf') OVER (PARTITION BY ts) AS total FROM dl WHERE delta >= 0)"


@query("bucket_delta", f"WITH {DELTA} SELECT series_id, floor(epoch(ts))::BIGINT AS ts, le, delta FROM dd WHERE total > 0 AND le < 'inf'")
def _(spark, f):
    return s.bucket_delta(m.buckets(spark, f), KEY).where(F.col("le") < float("inf"))


def _quantile_sql(q: float) -> str:
    return f"""WITH {DELTA}, x AS (SELECT *, coalesce(lag(delta) OVER w, 0) AS c0, coalesce(lag(le) OVER w, 0) AS l0 FROM dd WHERE total > 0 AND le < 'inf' WINDOW w AS (PARTITION BY ts ORDER BY le)),
y AS (SELECT series_id, ts, min(le) FILTER (WHERE delta >= {q} * total) AS hit, max(le) AS top FROM x GROUP BY ALL)
SELECT y.series_id, floor(epoch(y.ts))::BIGINT AS ts, round(CASE WHEN hit IS NULL THEN top WHEN delta = c0 THEN l0 ELSE l0 + (le - l0) / (delta - c0) * ({q} * total - c0) END, 6) AS value FROM y LEFT JOIN x ON x.ts = y.ts AND x.le = y.hit"""


for _name, _q in (("histogram_p99", 0.99), ("histogram_p50", 0.5)):
    query(_name, _quantile_sql(_q))(lambda spark, f, q=_q: s.histogram_quantile(s.bucket_delta(m.buckets(spark, f), KEY), KEY, q, "delta"))


@query("sample_interval", f"WITH {BY_TYPE}, g AS (SELECT series_id, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY series_id ORDER BY ts))::BIGINT AS g FROM h) SELECT series_id, greatest(60, least(900, list_sort(list(g) FILTER (WHERE g > 0))[len(list(g) FILTER (WHERE g > 0)) // 2 + 1]))::BIGINT AS step FROM g GROUP BY ALL")
def _(spark, f):
    return s.sample_interval(m.hourly(spark, f, "event_type"), KEY)


ISLANDS = "WITH g AS (SELECT user_id, ts, coalesce((epoch(ts) - epoch(lag(ts) OVER w) > 3600)::INT, 1) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), isl AS (SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS cnt FROM i GROUP BY user_id, k)"


@query("gap_islands", ISLANDS + " SELECT user_id, floor(epoch(start_ts))::BIGINT AS start_ts, floor(epoch(end_ts))::BIGINT AS end_ts, cnt FROM isl")
def _(spark, f):
    return s.islands(m.events(spark, f), ["user_id"], 3600)


@query("metric_info", ISLANDS + " SELECT user_id, floor(epoch(min(start_ts)))::BIGINT AS min_ts, floor(epoch(max(end_ts)))::BIGINT AS max_ts, sum(cnt)::BIGINT AS samples, count(*) - 1 AS gaps FROM isl GROUP BY user_id")
def _(spark, f):
    return s.metric_info(m.events(spark, f), ["user_id"], 3600)


RANGES = "r AS (SELECT user_id, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 3600 AS \"end\" FROM events), q AS (SELECT *, coalesce((start > max(\"end\") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS n FROM r), z AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM q), u AS (SELECT user_id, min(start) AS start, max(\"end\") AS \"end\" FROM z GROUP BY user_id, k)"
REQUEST = "(SELECT DISTINCT user_id, 1704153600 AS rs, 1705276800 AS re FROM events)"


def _ranges(spark, f):
    t = F.unix_seconds("ts")
    return m.events(spark, f).select("user_id", t.alias("start"), (t + 3600).alias("end"))


def _request(spark, f):
    return m.events(spark, f).select("user_id").distinct().withColumn("start", F.lit(1704153600).cast("long")).withColumn("end", F.lit(1705276800).cast("long"))


@query("interval_union", f"WITH {RANGES} SELECT user_id, start, \"end\" FROM u")
def _(spark, f):
    return s.interval_union(_ranges(spark, f), ["user_id"])


@query("interval_gaps", f"WITH {RANGES}, c AS (SELECT u.user_id, rs, re, greatest(start, rs) AS s, least(\"end\", re) AS e FROM u JOIN {REQUEST} USING (user_id) WHERE \"end\" > rs AND start < re UNION ALL SELECT user_id, rs, re, rs, rs FROM {REQUEST}), g AS (SELECT user_id, e AS start, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, e), re) AS \"end\" FROM c) SELECT user_id, start::BIGINT AS start, \"end\"::BIGINT AS \"end\" FROM g WHERE \"end\" > start")
def _(spark, f):
    return s.interval_gaps(_request(spark, f), _ranges(spark, f), ["user_id"])


@query("coverage_pct", f"WITH {RANGES}, c AS (SELECT user_id, rs, re, coalesce(sum(greatest(0, least(\"end\", re) - greatest(start, rs))), 0)::BIGINT AS covered FROM {REQUEST} LEFT JOIN u USING (user_id) GROUP BY ALL) SELECT user_id, rs::BIGINT AS start, re::BIGINT AS \"end\", covered, round(covered * 100.0 / (re - rs), 6) AS percent FROM c")
def _(spark, f):
    return s.interval_coverage(_request(spark, f), _ranges(spark, f), ["user_id"]).withColumn("percent", F.col("percent").cast("double"))


@query("weighted_latency", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS value FROM events GROUP BY ALL")
def _(spark, f):
    return m.events(spark, f).groupBy("event_type").agg(s.weighted_mean("value", "user_id").alias("value"))


# statistics and profile ----------------------------------------------------------------------------------------

@query("series_stats", f"WITH {BY_TYPE} SELECT series_id, count(*) AS n, median(value) AS m, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS s, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.95), 6) AS p95 FROM h GROUP BY ALL")
def _(spark, f):
    return d.series_stats(m.hourly(spark, f, "event_type")).withColumn("p95", F.col("q")[4]).drop("q")


@query("mad", f"WITH {BY_TYPE}, {STATS.format(t='h')} SELECT series_id, mad FROM a")
def _(spark, f):
    return p.mad(m.hourly(spark, f, "event_type"))


@query("entropy", f"WITH {BY_TYPE}, r AS (SELECT series_id, floor((value - min(value) OVER q) / (max(value) OVER q - min(value) OVER q) * 9) AS cell FROM h WINDOW q AS (PARTITION BY series_id)), c AS (SELECT series_id, cell, count(*) AS c FROM r GROUP BY ALL), pp AS (SELECT series_id, c / sum(c) OVER (PARTITION BY series_id) AS p FROM c) SELECT series_id, round(-sum(p * log2(p)) / log2(10), 6) AS entropy FROM pp GROUP BY ALL")
def _(spark, f):
    return p.entropy(m.hourly(spark, f, "event_type"))


FENCE = "q AS (SELECT series_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM h GROUP BY ALL)"


@query("outlier_ratio", f"WITH {BY_TYPE}, {FENCE} SELECT series_id, round(avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT), 6) AS outlier_ratio FROM h JOIN q USING (series_id) GROUP BY ALL")
def _(spark, f):
    return p.outlier_ratio(m.hourly(spark, f, "event_type"))


@query("iqr_trim_stats", f"WITH {BY_TYPE}, {FENCE}, t AS (SELECT series_id, value FROM h JOIN q USING (series_id) WHERE value BETWEEN a - 3 * (b - a) AND b + 3 * (b - a)) SELECT series_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.9) , 6) AS p90 FROM t GROUP BY ALL")
def _(spark, f):
    return p.qps_profile(m.hourly(spark, f, "event_type")).select("series_id", "mean", "std", "min", "max", "p90")


@query("qps_shape", f"WITH {BY_TYPE}, z AS (SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM h GROUP BY ALL) SELECT series_id, round(avg(((value - mu) / sd) ** 3), 6) AS skewness, round(avg(((value - mu) / sd) ** 4) - 3, 6) AS kurtosis FROM h JOIN z USING (series_id) GROUP BY ALL")
def _(spark, f):
    return p.qps_profile(m.hourly(spark, f, "event_type")).select("series_id", "skewness", "kurtosis")


@query("latency_profile", f"WITH {L} SELECT series_id, round(quantile_cont(value, 0.5) * 1000, 6) AS p50, round(quantile_cont(value, 0.99) * 1000, 6) AS p99, round(max(value) * 1000, 6) AS max, round(avg(value) * 1000, 6) AS mean, round(stddev_pop(value) * 1000, 6) AS std, round(1 - least(1, stddev_pop(value) / avg(value)), 6) AS stability FROM l GROUP BY ALL")
def _(spark, f):
    return p.latency_profile(m.latency(spark, f)).select("series_id", "p50", "p99", "max", "mean", "std", "stability")


@query("latency_buckets", "WITH v AS (SELECT event_type AS series_id, value AS ms FROM events) SELECT series_id, CASE WHEN ms <= 1 THEN 1 WHEN ms <= 5 THEN 5 WHEN ms <= 10 THEN 10 WHEN ms <= 25 THEN 25 WHEN ms <= 50 THEN 50 WHEN ms <= 100 THEN 100 WHEN ms <= 250 THEN 250 WHEN ms <= 500 THEN 500 WHEN ms <= 1000 THEN 1000 WHEN ms <= 2500 THEN 2500 ELSE 5000 END AS bound_ms, count(*) AS n FROM v GROUP BY ALL")
def _(spark, f):
    return p.latency_buckets(m.events(spark, f).select(F.col("event_type").alias("series_id"), "ts", (F.col("value") / 1000).alias("value")))


@query("hourly_averages", f"WITH {H} SELECT series_id, hour(ts)::INT AS h, round(avg(value), 6) AS avg, max(value) AS peak, round(stddev_pop(value), 6) AS std, count(*) AS k FROM h GROUP BY ALL")
def _(spark, f):
    return p.by_hour(m.hourly(spark, f))


@query("daily_pattern", f"WITH {BY_TYPE}, g AS (SELECT series_id, hour(ts) AS h, avg(value) AS avg, stddev_pop(value) AS std, count(*) AS k FROM h GROUP BY ALL), x AS (SELECT *, avg(avg) OVER (PARTITION BY series_id) AS al FROM g) SELECT series_id, round(max(avg) / min(avg), 6) AS peak_to_off_peak, round(1 - avg(avg) FILTER (WHERE h >= 22 OR h <= 5) / avg(avg) FILTER (WHERE h BETWEEN 6 AND 21), 6) AS night_drop, round(avg(avg) FILTER (WHERE h BETWEEN 9 AND 17) / avg(avg) FILTER (WHERE h < 9 OR h > 17), 6) AS business_ratio, round(greatest(0, 1 - avg(std / avg)), 6) AS consistency, round(least(1, 2 * avg((avg / al - 1) ** 2)), 6) AS periodicity FROM x GROUP BY ALL")
def _(spark, f):
    return p.daily_pattern(m.hourly(spark, f, "event_type")).select("series_id", "peak_to_off_peak", "night_drop", "business_ratio", "consistency", "periodicity")


@query("weekly_pattern", f"WITH {BY_TYPE}, g AS (SELECT series_id, dayofweek(ts) AS d, avg(value) AS avg FROM h GROUP BY ALL) SELECT series_id, round(avg(avg) FILTER (WHERE d BETWEEN 1 AND 5), 6) AS weekday_avg, round(avg(avg) FILTER (WHERE d IN (0, 6)), 6) AS weekend_avg, round((max(avg) - min(avg)) / avg(avg), 6) AS spread FROM g GROUP BY ALL")
def _(spark, f):
    return p.weekly_pattern(m.hourly(spark, f, "event_type")).select("series_id", "weekday_avg", "weekend_avg", "spread")


@query("monthly_pattern", f"WITH {H}, g AS (SELECT series_id, least((day(ts) - 1) // 7, 4) AS w, avg(value) AS avg FROM h GROUP BY ALL) SELECT series_id, count(*) AS weeks, round(max(avg) / min(avg), 6) AS peak_ratio, round((max(avg) - min(avg)) / avg(avg), 6) AS strength FROM g GROUP BY ALL HAVING count(*) >= 3")
def _(spark, f):
    return p.monthly_pattern(m.hourly(spark, f)).drop("monthly")


@query("noise_level", f"WITH {BY_TYPE}, x AS (SELECT series_id, value, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY ts)) AS d FROM h) SELECT series_id, round((least(1, avg(d) / avg(value)) + least(1, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / avg(value))) / 2, 6) AS noise FROM x GROUP BY ALL")
def _(spark, f):
    return p.noise_level(m.hourly(spark, f, "event_type"))


@query("acf_123", f"WITH {BY_TYPE}, x AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS v, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM h), y AS (SELECT series_id, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM x WINDOW w AS (PARTITION BY series_id ORDER BY i)) SELECT series_id, round(sum(v * a) / sum(v * v), 6) AS acf_1, round(sum(v * b) / sum(v * v), 6) AS acf_2, round(sum(v * c) / sum(v * v), 6) AS acf_3 FROM y GROUP BY ALL")
def _(spark, f):
    return p.autocorrelation(m.hourly(spark, f, "event_type")).drop("autocorrelation")


@query("trend_slope", f"WITH {BY_TYPE}, x AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM h) SELECT series_id, round(regr_slope(value, i), 6) AS slope, round(regr_r2(value, i), 6) AS r2, count(*) AS n FROM x GROUP BY ALL")
def _(spark, f):
    return p.trend_slope(m.hourly(spark, f, "event_type")).select("series_id", "slope", "r2", "n")


@query("seasonality", f"WITH {BY_TYPE}, g AS (SELECT series_id, hour(ts) AS h, avg(value) AS v FROM h GROUP BY ALL), x AS (SELECT series_id, sum(v) / 24 AS mu, sum(v * v) / 24 AS q, max(v) AS hi, CASE WHEN count(*) < 24 THEN 0 ELSE min(v) END AS lo FROM g GROUP BY ALL) SELECT series_id, round(0.6 * least(1, 2 * (q - mu * mu) / (mu * mu)) + 0.4 * least(1, (hi - lo) / mu / 3), 6) AS seasonality FROM x")
def _(spark, f):
    return p.seasonality(m.hourly(spark, f, "event_type"))


@query("robust_corr", f"""WITH {H}, {L}, b AS (SELECT h.series_id, h.ts, h.value AS x, l.value AS y FROM h JOIN l USING (ts)), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(y, 0.25) AS c, quantile_cont(y, 0.75) AS d FROM b),
o AS (SELECT series_id, ts, x, y, lead(y) OVER (ORDER BY ts) AS y1, x BETWEEN a - 1.5 * (q.b - a) AND q.b + 1.5 * (q.b - a) AND y BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c) AS ok FROM b, q)
SELECT series_id, round(corr(x, y) FILTER (WHERE ok), 6) AS correlation, round(corr(x, y1), 6) AS lag1_correlation FROM o GROUP BY ALL""")
def _(spark, f):
    return p.correlation(m.hourly(spark, f), m.latency(spark, f)).drop("sensitivity")


@query("burstiness")
def _(spark, f):
    return p.burstiness(m.hourly(spark, f, "event_type"))


@query("ema_final", f"WITH {BY_TYPE}, v AS (SELECT series_id, list(value ORDER BY ts) AS v FROM h GROUP BY ALL) SELECT series_id, round(list_reduce(v, lambda a, x: 0.2 * x + 0.8 * a), 6) AS fast, round(list_reduce(v, lambda a, x: 0.05 * x + 0.95 * a), 6) AS slow FROM v")
def _(spark, f):
    return p.trend(m.hourly(spark, f, "event_type")).select("series_id", "fast", "slow")


for _name, _work in {
    "trend": lambda spark, f: p.trend(planted(m.hourly(spark, f, "event_type"))), "load_profile": lambda spark, f: p.load_profile(planted(m.hourly(spark, f)), m.latency(spark, f)), "change_point_count": lambda spark, f: p.change_point_count(planted(m.hourly(spark, f))),
    "instance_skew": lambda spark, f: p.instance_skew(m.by_instance(spark, f)),
}.items():
    query(_name)(_work)


# detectors ------------------------------------------------------------------------------------------------------

@query("mad_anomalies", f"WITH {P}, {STATS.format(t='p')}, x AS (SELECT *, {ROBUST} AS z FROM p JOIN s USING (series_id) JOIN a USING (series_id)) " + hits("x", "z > 3.5", "MAD", SIDE.format(b="m"), GRADE.format(z="z", h=5.25, c=7.0), "m", "z"))
def _(spark, f):
    return found(d.mad_anomalies(planted(m.hourly(spark, f))))


CORE = P + ", " + STATS.format(t="p") + ", x AS (SELECT *, CASE WHEN mu < 50 THEN 3.0 WHEN mu < 200 THEN 2.0 WHEN mu < 1000 THEN 1.5 WHEN mu < 10000 THEN 1.2 ELSE 1.0 END AS k FROM p JOIN s USING (series_id) WHERE m >= 10 AND sd >= 0.1 * m)"


@query("core_spikes", f"WITH {CORE} " + hits("x", "value >= m + 2 * k * sd AND value / m >= 1.5 + 0.3 * k AND NOT (value - m < 0.5 * m AND m < 500)", "", "'QPS_SPIKE'", GRADE.format(z="value / m", h=3, c=5), "m", "(value - m) / sd"))
def _(spark, f):
    return found(d.core_spikes(planted(m.hourly(spark, f)), floor=0))


@query("core_drops")
def _(spark, f):
    rows = planted(m.hourly(spark, f)).withColumn("value", F.when(F.hour("ts") % 11 == 3, 0.0).otherwise(F.greatest(F.col("value"), F.lit(20.0))) + 100)
    return found(d.core_drops(rows.withColumn("value", F.when(F.hour("ts") % 11 == 3, F.col("value") - 99).otherwise(F.lit(150.0))), small=1))


@query("core_sustained")
def _(spark, f):
    return d.core_sustained(planted(m.hourly(spark, f)), busy=1)


@query("hourly_baseline", f"WITH {P}, x AS (SELECT *, avg(value) OVER w AS b, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY series_id, hour(ts))), y AS (SELECT *, abs(value - b) / sd AS z FROM x WHERE k >= 2 AND sd > 0) " + hits("y", "z > 3", "", SIDE.format(b="b"), "CASE WHEN z > 4.5 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "z"))
def _(spark, f):
    return found(d.hourly_baseline(planted(m.hourly(spark, f))))


@query("volatility", f"WITH {P}, f AS (SELECT series_id, ts, stddev_pop(value) OVER w / avg(value) OVER w AS value, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), g AS (SELECT series_id, ts, value FROM f WHERE k = 6), {STATS.format(t='g')}, x AS (SELECT *, (value - m) / (1.4826 * mad) AS z FROM g JOIN s USING (series_id) JOIN a USING (series_id)) " + hits("x", "z > 3", "", "'VOLATILITY_SPIKE'", "CASE WHEN z > 5 THEN 'HIGH' ELSE 'MEDIUM' END", "m", "z"))
def _(spark, f):
    return found(d.volatility(planted(m.hourly(spark, f))))


@query("raw_rolling_mad")
def _(spark, f):
    return d.raw_rolling(planted(m.hourly(spark, f)), run=1)


@query("multi_scale_scores")
def _(spark, f):
    return d.scale_scores(planted(m.hourly(spark, f)), (6,)).where("i >= 3 and i < n - 3").select("series_id", "ts", F.col("z6").alias("score"))


_DETECTORS = {
    "core_all": lambda q: d.core_all(q.withColumn("value", F.col("value") * 50)), "contextual": d.contextual, "dynamic_threshold": d.dynamic_threshold, "dynamic_threshold_states": d.dynamic_threshold_states, "multi_scale": d.multi_scale, "stl_parts": d.decompose, "stl_mad": d.decomposition_anomalies,
    "sustained_residual": lambda q: d.sustained_residual(q, least=0.8), "esd": g.esd, "shesd": g.shesd, "ensemble": g.ensemble, "ema_detector": g.ema_detector, "isolation_forest": g.isolation_forest, "random_cut_forest": g.random_cut_forest, "dbscan": g.dbscan,
    "holt_winters": g.holt_winters, "peaks": g.peaks, "peak_anomalies": g.peak_anomalies, "robust_stl": g.robust_stl, "cusum": cp.cusum, "pelt": cp.pelt, "sliding_window": cp.sliding_window, "all_change_points": cp.all_change_points,
    "forecast_holt": lambda q: cp.exponential(q, beta=0.1), "forecast_ses": cp.exponential, "forecast_auto": cp.auto, "volatility_metrics": w.volatility, "spectrum": w.spectrum, "modes": w.modes, "regimes": w.regimes,
}
for _name, _work in _DETECTORS.items():
    query(_name)(lambda spark, f, work=_work: work(planted(m.hourly(spark, f))))


@query("e_divisive")
def _(spark, f):
    day = F.dayofmonth("ts")  # a level that rises twice
    return cp.e_divisive(m.hourly(spark, f).withColumn("value", F.col("value") + F.when(day >= 21, 160).when(day >= 11, 60).otherwise(0)))


@query("spectral_residual")
def _(spark, f):
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)  # lone peaks on a floor
    return g.spectral_residual(m.hourly(spark, f).withColumn("value", F.when(h % 331 == 5, 900.0).otherwise(F.col("value") + 100)))


@query("latency_anomalies")
def _(spark, f):
    return d.latency_anomalies(planted(m.latency(spark, f)))


def _ten_minutes(spark, f):
    """A gauge every ten minutes, with a hundredfold rise in two hours of every fourth day."""
    t = F.floor(F.unix_seconds("ts") / 600) * 600
    rows = m.events(spark, f).groupBy(F.lit("all").alias("series_id"), F.timestamp_seconds(t).alias("ts")).agg((F.avg("value") / 100).alias("value"))
    return rows.withColumn("value", F.col("value") * F.when((F.dayofmonth("ts") % 4 == 0) & F.hour("ts").between(9, 10), 100).otherwise(1))


@query("raw_rolling")
def _(spark, f):
    return d.raw_rolling(_ten_minutes(spark, f))


@query("sustained_latency")
def _(spark, f):
    return d.sustained_latency(_ten_minutes(spark, f))


@query("window_t", f"WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, avg(value) OVER l AS ml, avg(value) OVER r AS mr, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr FROM p WINDOW l AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT series_id, floor(epoch(ts))::BIGINT AS ts, round(abs(mr - ml) / nullif(sqrt((vl + vr) / 2), 0) / sqrt(0.2), 4) AS t FROM x WHERE idx >= 10 AND idx <= n - 10")
def _(spark, f):
    return cp.window_t(planted(m.hourly(spark, f))).select("series_id", "ts", F.round("t", 4).alias("t"))


@query("sma_forecast", f"WITH {BY_TYPE}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS b FROM h), y AS (SELECT series_id, avg(value) FILTER (WHERE b <= 5) AS p, stddev_pop(value) AS s FROM x GROUP BY ALL) SELECT series_id, st::INT AS step, round(p, 6) AS prediction, round(p - 1.96 * s * sqrt(1 + (st - 1) / 5), 6) AS lower, round(p + 1.96 * s * sqrt(1 + (st - 1) / 5), 6) AS upper FROM y, range(1, 25) t(st)")
def _(spark, f):
    return cp.moving_average(m.hourly(spark, f, "event_type")).select("series_id", "step", "prediction", "lower", "upper")


@query("linear_forecast", f"WITH {BY_TYPE}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM h), y AS (SELECT series_id, regr_slope(value, i) AS b, regr_intercept(value, i) AS a, count(*) AS n FROM x GROUP BY ALL) SELECT series_id, st::INT AS step, round(a + b * (n + st - 1), 5) AS prediction FROM y, range(1, 25) t(st)")
def _(spark, f):
    return cp.linear(m.hourly(spark, f, "event_type")).select("series_id", "step", F.round("prediction", 5).alias("prediction"))


@query("seasonal_naive", f"WITH {BY_TYPE}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS b FROM h) SELECT series_id, (25 - b)::INT AS step, value AS prediction FROM x WHERE b <= 24")
def _(spark, f):
    return cp.seasonal_naive(m.hourly(spark, f, "event_type")).select("series_id", "step", "prediction")


# events ----------------------------------------------------------------------------------------------------------

def _findings(spark, f):
    rows = planted(m.hourly(spark, f))
    return d.mad_anomalies(rows).unionByName(d.hourly_baseline(rows))


MAD_SQL = f"x AS (SELECT *, {ROBUST} AS z FROM p JOIN s USING (series_id) JOIN a USING (series_id))"


@query("ensemble_votes", f"WITH {P}, {STATS.format(t='p')}, {MAD_SQL}, hb AS (SELECT *, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM p WINDOW w AS (PARTITION BY series_id, hour(ts))), u AS (SELECT series_id, ts, z FROM x WHERE z > 3.5 UNION ALL SELECT series_id, ts, z FROM hb WHERE z > 3) SELECT series_id, floor(epoch(ts))::BIGINT AS ts, count(*) AS hits, round(avg(z), 6) AS z_score FROM u GROUP BY ALL")
def _(spark, f):
    return d.votes(_findings(spark, f)).select("series_id", "ts", "hits", "z_score")


for _name, _work in {"session_merge": ev.session_merge, "confident_events": lambda x: ev.confident(ev.session_merge(x, 7200)), "event_summary": lambda x: ev.summary(ev.session_merge(x)), "anchored_merge": ev.anchored_merge, "dynamic_gap": lambda x: ev.dynamic_gap(x, 120), "stitched_events": lambda x: ev.stitched(x, 3600), "first_per_bucket": lambda x: d.first_per_bucket(x, 7200)}.items():
    query(_name)(lambda spark, f, work=_work: work(_findings(spark, f)))


@query("evidence")
def _(spark, f):
    q, lat = planted(m.hourly(spark, f)), m.latency(spark, f)
    e = ev.stitched(_findings(spark, f), 3600).withColumn("event_id", F.concat_ws("#", "series_id", F.unix_seconds("ts").cast("string")))
    return ev.judged(ev.evidence(e, q, lat, step=3600)).select("series_id", "ts", "end_ts", "Q", "L", "K", "E", "reason", "confidence", "keep")


def _tenths(hourly: DataFrame, seed: int = 1) -> DataFrame:
    """An hourly series every ten minutes, a tenth up or down: events need some points in each half hour."""
    rows = hourly.select("series_id", "value", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    noise = F.pmod(F.xxhash64("t", "k", F.lit(seed)), F.lit(1000)) / 1000
    return rows.select("series_id", F.timestamp_seconds(F.col("t") + 600 * F.col("k")).alias("ts"), (F.col("value") * (0.9 + 0.2 * noise)).alias("value"))


@query("abnormal")
def _(spark, f):
    load = _tenths(planted(m.hourly(spark, f)))
    return ab.abnormal(load, _tenths(planted(m.latency(spark, f))), backend=_tenths(m.latency(spark, f)), statements=_tenths(planted(m.hourly(spark, f)), 2), storage=_tenths(m.hourly(spark, f), 3), step=600)


# workload ----------------------------------------------------------------------------------------------------------

@query("workload_mix", f"WITH {K} SELECT series_id, key, sum(value) AS total, round(avg(value), 6) AS mean, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS percent, count(*) AS n FROM k GROUP BY ALL")
def _(spark, f):
    return w.mix(m.keyed(spark, f)).drop("cv")


@query("rw_ratio", f"WITH {K}, x AS (SELECT series_id, sum(value) FILTER (WHERE key = 'Select') AS r, sum(value) FILTER (WHERE key IN ('Insert', 'Update')) AS w FROM k GROUP BY ALL) SELECT series_id, round(r / (r + w), 6) AS read_ratio, round(w / (r + w), 6) AS write_ratio FROM x")
def _(spark, f):
    return w.read_write(m.keyed(spark, f)).select("series_id", "read_ratio", "write_ratio")


@query("workload_balance", f"WITH {K}, x AS (SELECT series_id, key, sum(value) / sum(sum(value)) OVER () AS p FROM k GROUP BY ALL) SELECT series_id, round(greatest(0, 1 - sum(p * p) * count(*)), 6) AS balance FROM x GROUP BY ALL")
def _(spark, f):
    return w.balance(m.keyed(spark, f))


@query("counter_totals", f"WITH {C} SELECT series_id, key, greatest(0, arg_max(value, ts) - arg_min(value, ts)) AS count FROM c GROUP BY ALL")
def _(spark, f):
    return w.counter_totals(m.counters(spark, f)).select("series_id", "key", "count")


@query("tail_gpd", f"WITH {BY_TYPE}, q AS (SELECT series_id, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999 FROM h GROUP BY ALL) SELECT series_id, round(p95, 6) AS p95, round(p99, 6) AS p99, round(p999, 6) AS p999, round(CASE WHEN p999 > p99 AND p99 > p95 THEN log10((p999 - p99) / (p99 - p95)) ELSE 0 END, 6) AS tail_index FROM q")
def _(spark, f):
    return w.tail(m.hourly(spark, f, "event_type")).select("series_id", "p95", "p99", "p999", "tail_index")


@query("instance_rank", "WITH i AS (SELECT CASE WHEN user_id % 9 < 6 THEN 'sql-' ELSE 'kv-' END || (user_id % 9) AS instance, date_trunc('day', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL), x AS (SELECT instance, avg(value) AS mean FROM i GROUP BY ALL) SELECT 'all' AS series_id, instance, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, instance)::INT AS rank, round(mean / max(mean) OVER (), 6) AS relative, round(mean / avg(mean) OVER (), 6) AS temperature FROM x")
def _(spark, f):
    return w.instances(m.by_instance(spark, f), m.latency(spark, f, "instance")).select("series_id", "instance", "mean", "rank", "relative", "temperature")


def _dimensions(spark, f):
    return dim.profile(planted(m.hourly(spark, f)), m.latency(spark, f), m.keyed(spark, f), m.keyed(spark, f), m.by_instance(spark, f), m.latency(spark, f, "instance"))


for _name, _work in {
    "imbalance": lambda spark, f: d.imbalance(m.by_instance(spark, f).withColumn("value", F.col("value") * F.when(F.col("instance") == "kv-7", 5).otherwise(1)), floor=1), "workload_types": lambda spark, f: d.workload_type_anomalies(planted(m.keyed(spark, f)), 1), "workload_profile": lambda spark, f: w.workload_profile(m.keyed(spark, f), m.keyed(spark, f)),
    "complexity": lambda spark, f: w.complexity(m.keyed(spark, f)), "fingerprints": lambda spark, f: w.fingerprints(m.counters(spark, f), m.latency(spark, f, "key")), "operations": lambda spark, f: w.operations(m.counters(spark, f), m.latency(spark, f, "key")), "op_categories": lambda spark, f: w.category_summary(w.operations(m.counters(spark, f), m.latency(spark, f, "key"))),
    "volume": lambda spark, f: w.volume(m.counters(spark, f)), "cluster_health": lambda spark, f: w.cluster_health(w.instances(m.by_instance(spark, f), m.latency(spark, f, "instance"))), "tails_by_kind": lambda spark, f: w.keyed(m.keyed(spark, f), w.tail), "similarity": lambda spark, f: dim.similarity(_dimensions(spark, f)),
    "alerts": lambda spark, f: dim.alerts(dim.thresholds(_dimensions(spark, f))), "monitor": lambda spark, f: dim.monitor(_dimensions(spark, f)), "six_dimensions": lambda spark, f: _dimensions(spark, f).drop("bottlenecks"),
}.items():
    query(_name)(_work)


@query("order_load_join", "WITH o AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*)::DOUBLE AS x FROM orders GROUP BY ALL), l AS (SELECT date_trunc('day', l_shipdate) AS ts, count(*)::DOUBLE AS y FROM lineitem GROUP BY ALL) SELECT 'orders' AS series_id, round(corr(x, y), 6) AS correlation, count(*) AS n FROM o JOIN l USING (ts)")
def _(spark, f):
    day = lambda t, c, v: table(spark, f, t).groupBy(F.date_trunc("day", F.col(c).cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias(v))
    both = day("orders", "o_orderdate", "x").join(day("lineitem", "l_shipdate", "y"), "ts")
    return both.agg(F.lit("orders").alias("series_id"), F.corr("x", "y").alias("correlation"), F.count(F.lit(1)).alias("n"))



# insight ---------------------------------------------------------------------------------------------------------

def _instances(spark, f):
    return w.instances(m.by_instance(spark, f), m.latency(spark, f, "instance"))


def _nodes(spark, f):
    cpu = m.events(spark, f).groupBy(F.lit("all").alias("series_id"), "instance", F.date_trunc("day", "ts").alias("ts")).agg((F.sum("value") / 1000).alias("value"))
    return insight.node_report(insight.component(m.by_instance(spark, f), "sql"), m.latency(spark, f, "instance"), cpu)


def _users(spark, f, kind):
    return m.events(spark, f).where(F.col("event_type") == kind).select("user_id")


def _links(spark, f):
    by_kind = m.latency(spark, f, "key")
    return insight.dimension_links(_dimensions(spark, f), w.mix(m.keyed(spark, f), by_kind), by_kind, m.latency(spark, f))


def _fetch_order(spark, f):
    wanted = table(spark, f, "customer").select("c_custkey", F.col("c_custkey").alias("place"))
    ranked = insight.fetch_order(wanted, table(spark, f, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return numbered(ranked, ["has_cache", "place"]).withColumn("rank", F.col("rank").cast("int")).drop("place")  # a list of what to fetch


for _name, _work in {
    "latency_dimension": lambda spark, f: insight.latency_dimension(m.latency(spark, f)), "lagged_correlations": lambda spark, f: insight.lagged_correlations(planted(m.hourly(spark, f)), m.latency(spark, f)),
    "causality": lambda spark, f: insight.causality(planted(m.hourly(spark, f)), m.latency(spark, f), "qps", "latency"), "dimension_links": _links, "propagation": lambda spark, f: insight.propagation(_dimensions(spark, f)),
    "sql_advice": lambda spark, f: insight.advice(w.fingerprints(m.counters(spark, f), m.latency(spark, f, "key"))), "instance_findings": lambda spark, f: insight.instance_findings(_instances(spark, f)), "node_report": _nodes, "node_balance": lambda spark, f: insight.node_balance(_nodes(spark, f)),
    "fetch_order": _fetch_order, "resumed": lambda spark, f: insight.resumed(m.events(spark, f).select("user_id", "ts"), ["user_id"], 86400), "common_users": lambda spark, f: _users(spark, f, "purchase").intersect(_users(spark, f, "error")), "missing_users": lambda spark, f: _users(spark, f, "purchase").subtract(_users(spark, f, "error")),
    "validation": lambda spark, f: insight.validation(m.hourly(spark, f, "event_type")), "class_distribution": lambda spark, f: insight.distribution(insight.validation(m.hourly(spark, f, "event_type"))), "synthetic_check": lambda spark, f: insight.distribution(insight.validation(insight.synthetic(spark))), "approximate_stats": lambda spark, f: insight.approximate_stats(m.events(spark, f).select(F.col("event_type").alias("series_id"), "value")).drop("q"),
}.items():
    query(_name)(_work)



# sources, sinks and streams ------------------------------------------------------------------------------------------

def _samples(spark, f, by="hour", metric="requests_total"):
    """Hourly counts by kind as samples with labels."""
    rows = m.events(spark, f).groupBy("key", F.date_trunc(by, "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.select(F.lit(metric).alias("metric"), F.create_map(F.lit("kind"), F.col("key"), F.lit("note"), F.lit('a"b,c')).alias("labels"), "ts", "value")


def _folder(spark):
    return expiring(spark, f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}")


def _written(spark, lines, **options):
    at = _folder(spark)
    lines.write.options(**options).text(at)
    return at


@query("text_round_trip")
def _(spark, f):
    got = prom.read_text(spark, _written(spark, sinks.text_lines(_samples(spark, f)).select("line")), 1704153600, 1705276800)
    return got.select("metric", F.col("labels")["kind"].alias("kind"), F.col("labels")["note"].alias("note"), "ts", "value")


@query("summed_text")
def _(spark, f):
    return prom.sum_labels(prom.read_text(spark, _written(spark, sinks.text_lines(_samples(spark, f)).select("line"))))


@query("csv_round_trip")
def _(spark, f):
    at = _folder(spark)
    rows = _samples(spark, f).withColumn("labels", F.map_filter("labels", lambda k, _: k == "kind"))
    sinks.write_csv(rows, f"{at}/d", f"{at}/l")
    return prom.read_csv(spark, f"{at}/d", f"{at}/l").select("id", F.col("labels")["kind"].alias("kind"), "ts", "value")


@query("histogram_text")
def _(spark, f):
    day = m.events(spark, f).groupBy(F.date_trunc("day", "ts").alias("ts"))
    wide = day.agg(F.sum((F.col("value") <= 10).cast("double")).alias("10"), F.sum((F.col("value") <= 100).cast("double")).alias("100"), F.count(F.lit(1)).cast("double").alias("+Inf"))
    rows = wide.unpivot("ts", ["10", "100", "+Inf"], "le", "value").select(F.lit("latency_bucket").alias("metric"), F.create_map(F.lit("le"), F.col("le")).alias("labels"), "ts", "value")
    return prom.histogram_rows(prom.read_text(spark, _written(spark, sinks.text_lines(rows).select("line")))).where(F.col("le") < float("inf"))


@query("response_rows")
def _(spark, f):
    """One response for each series and month."""
    rows = _samples(spark, f, "day").groupBy(F.col("labels")["kind"].alias("kind"), F.trunc("ts", "month")).agg(F.collect_list(F.array(F.unix_seconds("ts").cast("string"), F.col("value").cast("string"))).alias("values"))
    series = rows.select(F.array(F.struct(F.create_map(F.lit("__name__"), F.lit("up"), F.lit("kind"), F.col("kind")).alias("metric"), "values")).alias("result"))
    got = prom.read_response(spark, _written(spark, series.select(F.to_json(F.struct(F.struct("result").alias("data"))).alias("value")), maxRecordsPerFile=1))
    return got.select("metric", F.col("labels")["kind"].alias("kind"), "ts", "value")


@query("last_written")
def _(spark, f):
    return prom.last_written(m.events(spark, f).select("user_id", "ts", "value", "event_type"), ["user_id"], "ts")


@query("file_ranges")
def _(spark, f):
    """Ranges in the names of hourly files, which the events' hours give; names without a range drop out."""
    hours = m.events(spark, f).select("event_type", F.date_trunc("hour", "ts").alias("hour")).distinct()
    named = hours.select(F.concat("event_type", F.lit("_"), range_name("hour", F.expr("hour + interval 3599 seconds")), F.lit(".prom")).alias("file"))
    ranges = prom.file_ranges(named.unionByName(hours.select(F.concat("event_type", F.lit(".prom")).alias("file")).distinct()))
    newest = prom.latest_range(ranges).select(F.col("end_ts").alias("newest"))  # one row
    return ranges.join(F.broadcast(newest), F.col("end_ts") == F.col("newest"), "left").withColumn("newest", F.col("newest").isNotNull())


@query("metric_types")
def _(spark, f):
    """Kinds of metrics named after the events, with an ending by user, and how many events each has."""
    endings = F.array(*[F.lit(x) for x in ("_bucket", "_total", "_count", "_sum", "_queue", "_Latency_ms", "_duration")])
    names = m.events(spark, f).select(F.concat("event_type", F.element_at(endings, (F.pmod("user_id", F.lit(7)) + 1).cast("int"))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", st.metric_type("name").alias("kind"), st.is_bucket_metric("name").alias("bucket"))


def _stream(spark, f):
    """The event table; the stream operators work on tables too, where no row is late."""
    return m.events(spark, f).select(F.col("event_type").alias("series_id"), "ts", "value")


for _name, _work in {
    "tumbling_windows": lambda spark, f: ops.windowed(_stream(spark, f), "30 minutes"), "sliding_windows": lambda spark, f: ops.windowed(_stream(spark, f), "2 hours", "1 hour"), "session_windows": lambda spark, f: ops.sessions(_stream(spark, f), "30 minutes"),
    "counter_rate_gap": lambda spark, f: s.counter_rate(m.counters(spark, f), ["series_id", "key"], max_gap=3600), "seasonal_period": lambda spark, f: g.seasonal_periods(planted(m.hourly(spark, f))),
}.items():
    query(_name)(_work)


def _days(spark, length):
    a = F.lit(1704067200) + F.col("id") * 86400
    return spark.range(29).select(F.lit("all").alias("series_id"), "id", a.alias("a"), (a + length).alias("b"))


@query("window_correlation")
def _(spark, f):
    windows = _days(spark, 90_000).select("series_id", "id", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    return s.window_correlation(planted(m.hourly(spark, f)), m.latency(spark, f), windows, KEY)


@query("high_coverage")
def _(spark, f):
    points = m.latency(spark, f)
    limit = points.groupBy("series_id").agg((1.2 * F.median("value")).alias("limit"))
    return ev.high_points(_days(spark, 43_200).withColumnRenamed("id", "event_id").join(limit, "series_id"), points).select(F.lit("all").alias("series_id"), F.col("event_id").alias("id"), "covered", "first_high", "last_high")


def _categories(spark, f, value):
    category = F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write")
    rows = m.events(spark, f).groupBy(F.lit("all").alias("series_id"), category.alias("category"), "instance", F.date_trunc("day", "ts").alias("ts")).agg(value.alias("value"))
    return rows.withColumn("value", F.col("value") * F.when(F.col("instance") == "kv-7", 6).otherwise(1))


query("load_imbalance")(lambda spark, f: d.category_imbalance(_categories(spark, f, F.count(F.lit(1)).cast("double"))))
query("latency_imbalance")(lambda spark, f: d.category_imbalance(_categories(spark, f, F.avg("value") / 1000), latency=True))


SQL.update({name: sql for name, sql in oracles.SQL.items() if name in QUERIES})
QUERIES.update(catalog_store.QUERIES)
SQL.update(catalog_store.SQL)
for _name, _work in catalog_cluster.QUERIES.items():
    query(_name, catalog_cluster.SQL[_name])(_work)
