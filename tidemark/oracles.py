"""SQL that must agree with registered queries: the shared fragments and the longer statements.

The statements are written from the operators' definitions, with plain joins, lists and recursion where the
operators use windows, folds or grouped maps. Findings of hourly series are an hour apart or at equal times.
"""

from __future__ import annotations

H = "h AS (SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
BY_TYPE = "h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
HOUR = "(floor(epoch(ts))::BIGINT // 3600)"
FACTOR = f"CASE WHEN {HOUR} % 97 = 5 THEN 6.0 WHEN {HOUR} % 97 = 50 THEN 0.02 WHEN {HOUR} % 211 < 9 THEN 4.0 ELSE 1.0 END"
P = H + f", p AS (SELECT series_id, ts, value * {FACTOR} AS value FROM h)"
L = "l AS (SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, quantile_disc(value, 0.99) / 1000 AS value FROM events GROUP BY ALL)"
KIND = "CASE event_type WHEN 'view' THEN 'Select' WHEN 'click' THEN 'Update' WHEN 'purchase' THEN 'Insert' WHEN 'signup' THEN 'Begin' WHEN 'error' THEN 'Rollback' END"
K = f"k AS (SELECT 'all' AS series_id, {KIND} AS key, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
C = K + ", c AS (SELECT series_id, key, ts, sum(value) OVER (PARTITION BY key, floor(epoch(ts))::BIGINT // 604800 ORDER BY ts) AS value FROM k)"
#: Median, deviations and median absolute deviation of a series in table {t}.
STATS = "s AS (SELECT series_id, median(value) AS m, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM {t} GROUP BY ALL), a AS (SELECT {t}.series_id, median(abs(value - m)) AS mad FROM {t} JOIN s USING (series_id) GROUP BY ALL)"
ROBUST = "abs(value - m) / (CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END)"
SIDE = "CASE WHEN value >= {b} THEN 'QPS_SPIKE' ELSE 'QPS_DROP' END"
GRADE = "CASE WHEN {z} > {c} THEN 'CRITICAL' WHEN {z} > {h} THEN 'HIGH' ELSE 'MEDIUM' END"
INSTANCE = "CASE WHEN user_id % 9 < 6 THEN 'sql-' ELSE 'kv-' END || (user_id % 9)"
I = f"i AS (SELECT 'all' AS series_id, {INSTANCE} AS instance, date_trunc('day', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
IL = f"il AS (SELECT 'all' AS series_id, {INSTANCE} AS instance, date_trunc('day', ts) AS ts, quantile_disc(value, 0.99) / 1000 AS value FROM events GROUP BY ALL)"
KL = f"kl AS (SELECT 'all' AS series_id, {KIND} AS key, date_trunc('hour', ts) AS ts, quantile_disc(value, 0.99) / 1000 AS value FROM events GROUP BY ALL)"
#: A gauge every ten minutes with planted rises.
TEN = """t0 AS (SELECT to_timestamp(floor(epoch(ts) / 600) * 600)::TIMESTAMP AS ts, avg(value) / 100 AS value FROM events GROUP BY ALL),
t AS (SELECT 'all' AS series_id, ts, value * CASE WHEN day(ts) % 4 = 0 AND hour(ts) BETWEEN 9 AND 10 THEN 100 ELSE 1 END AS value FROM t0)"""
#: Rows of the planted series with their place.
N = P + ", n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM p)"
SEC = "floor(epoch({x}))::BIGINT"
WHOLE, TIME = "PARTITION BY series_id", "PARTITION BY series_id ORDER BY ts"

SQL: dict[str, str] = {}


def text(names: str) -> str:
    """A list as Spark shows it."""
    return f"('[' || array_to_string({names}, ', ') || ']')"


def rows(source: str, where: str, detector: str, type_: str, severity: str, baseline: str, z: str, value: str = "value", ts: str = "ts", end: str = "NULL", duration: str = "0", confidence: str = "NULL", instance: str = "NULL", by: str | None = None, detail: str | None = None, rounded: bool = True) -> str:
    """SELECT of findings with all their columns."""
    r = (lambda x: f"round(({x})::DOUBLE, 6)") if rounded else (lambda x: f"({x})::DOUBLE")
    end_ = "NULL::BIGINT" if end == "NULL" else SEC.format(x=end)
    return f"SELECT series_id, {type_} AS type, {severity} AS severity, {SEC.format(x=ts)} AS ts, {end_} AS end_ts, ({duration})::INT AS duration_sec, {r(value)} AS value, {r(baseline)} AS baseline, {r(z)} AS z_score, {r(confidence)} AS confidence, {by or repr('[' + detector + ']')} AS detected_by, {instance}::VARCHAR AS instance, {detail or repr(detector)} AS detail FROM {source} WHERE {where}"


def short(source: str, where: str, type_: str, severity: str, baseline: str, z: str) -> str:
    return f"SELECT series_id, {type_} AS type, {severity} AS severity, {SEC.format(x='ts')} AS ts, round(value, 6) AS value, round({baseline}, 6) AS baseline, round({z}, 6) AS z_score FROM {source} WHERE {where}"


# profile ---------------------------------------------------------------------------------------------------------

SQL["burstiness"] = f"""WITH {BY_TYPE}, r AS (SELECT *, var_pop(value) OVER ({TIME} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv, quantile_cont(value, 0.9) OVER ({WHOLE}) AS p90, row_number() OVER ({TIME}) AS i FROM h),
g AS (SELECT series_id, avg(value) AS m, var_pop(value) AS v, quantile_cont(value, 0.1) AS a, median(value) AS b, quantile_cont(value, 0.9) AS c, stddev_pop(rv) FILTER (WHERE i > 5) / avg(rv) FILTER (WHERE i > 5) AS vv, avg((value > p90)::INT) AS top FROM r GROUP BY series_id)
SELECT series_id, round(0.25 * least(1, v / (m * m)) + 0.3 * least(1, (c - a) / b / 3) + 0.25 * least(1, vv) + 0.2 * top, 6) AS burstiness FROM g"""

SQL["trend"] = f"""WITH {BY_TYPE}, p AS (SELECT series_id, ts, value * {FACTOR} AS value FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back, ntile(2) OVER ({TIME}) AS half, row_number() OVER ({TIME}) - 1 AS x FROM p),
g AS (SELECT series_id, list(value ORDER BY ts) AS v, avg(value) FILTER (WHERE back <= 10) AS l, avg(value) FILTER (WHERE back BETWEEN 11 AND 20) AS b, regr_slope(value, x) FILTER (WHERE half = 1) AS s1, regr_slope(value, x) FILTER (WHERE half = 2) AS s2, regr_slope(value, x) AS s, avg(value) AS m, arg_max(value, ts) AS last FROM r GROUP BY series_id),
e AS (SELECT *, list_reduce(v, lambda a, x: 0.2 * x + 0.8 * a) AS fast, list_reduce(v, lambda a, x: 0.05 * x + 0.95 * a) AS slow FROM g)
SELECT series_id, CASE WHEN (fast - slow) / slow > 0.05 THEN 'increasing' WHEN (fast - slow) / slow < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction, round(fast, 6) AS fast, round(slow, 6) AS slow, round((l - b) / b, 6) AS recent_change, round(s1, 6) AS slope_1, round(s2, 6) AS slope_2, round(last * (1 + s / m * 24), 6) AS forecast FROM e"""

SQL["change_point_count"] = f"""WITH {N}, x AS (SELECT *, avg(value) OVER (ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ml, avg(value) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS mr, var_pop(value) OVER (ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS vl, var_pop(value) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS vr, avg(value) OVER () AS m FROM n),
y AS (SELECT series_id, list({{'at': i, 'k': 0}} ORDER BY i) FILTER (WHERE i >= 15 AND i <= n - 15 AND abs(mr - ml) > 3.5 * sqrt((vl + vr) / 15) AND abs(mr - ml) >= 0.2 * abs(m)) AS f FROM x GROUP BY series_id)
SELECT series_id, (list_reduce(list_prepend({{'at': -20::BIGINT, 'k': 0}}, coalesce(f, [])), lambda a, x: CASE WHEN x['at'] - a['at'] >= 20 THEN {{'at': x['at'], 'k': a['k'] + 1}} ELSE a END))['k']::INT AS change_points FROM y"""

SKEW = f"{I}, m AS (SELECT series_id, instance, avg(value) AS m FROM i GROUP BY ALL), ma AS (SELECT *, avg(m) OVER ({WHOLE}) AS al FROM m), sk AS (SELECT series_id, stddev_pop(m) / avg(m) AS skew, coalesce(list(instance ORDER BY instance) FILTER (WHERE m > 1.3 * al), []) AS hot, coalesce(list(instance ORDER BY instance) FILTER (WHERE m < 0.7 * al), []) AS cold, count(*) AS instances FROM ma GROUP BY series_id)"
SQL["instance_skew"] = f"WITH {SKEW} SELECT series_id, round(skew, 6) AS skew, {text('hot')} AS hot, {text('cold')} AS cold, instances, CASE WHEN skew > 0.5 THEN 'high' WHEN skew > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM sk"

# core detectors --------------------------------------------------------------------------------------------------

LEVEL = "CASE WHEN mu < 50 THEN 3.0 WHEN mu < 200 THEN 2.0 WHEN mu < 1000 THEN 1.5 WHEN mu < 10000 THEN 1.2 ELSE 1.0 END"


def _core(values: str) -> str:
    """Table x of what the core detectors take, over table v (series_id, ts, value), and dark, the hours to leave out."""
    return f"""v AS ({values}), s AS (SELECT series_id, median(value) AS m, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT v.*, m, sd, n, {LEVEL} AS k FROM v JOIN s USING (series_id) WHERE n >= 10 AND m >= 10 AND sd >= 0.1 * m),
hs AS (SELECT series_id, hour(ts) AS h, avg(value) AS a FROM v GROUP BY ALL), pt AS (SELECT series_id, count(*) AS hours, avg(a) FILTER (WHERE h >= 22 OR h <= 5) AS night, avg(a) FILTER (WHERE h BETWEEN 6 AND 21) AS day FROM hs GROUP BY ALL),
dark AS (SELECT series_id, h FROM hs JOIN pt USING (series_id) JOIN s USING (series_id) WHERE n >= 48 AND hours >= 12 AND day > 0 AND night / day < 0.7 AND a < 0.6 * m)"""


def _drops(small: int) -> tuple[str, str]:
    where = f"value <= m - 1.5 * k * sd AND (m - value) / m >= 0.3 AND NOT (m - value < 0.5 * m AND m < {small}) AND NOT EXISTS (SELECT 1 FROM dark WHERE dark.series_id = x.series_id AND dark.h = hour(x.ts))"
    return where, "CASE WHEN (m - value) / m > 0.9 OR (value = 0 AND m > 100) THEN 'CRITICAL' WHEN (m - value) / m > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END"


_w, _s = _drops(1)
SQL["core_drops"] = f"WITH {P}, {_core('SELECT series_id, ts, CASE WHEN hour(ts) % 11 = 3 THEN 1.0::DOUBLE ELSE 150.0::DOUBLE END AS value FROM p')} " + short("x", _w, "'QPS_DROP'", _s, "m", "(value - m) / sd")


def _windows(busy: int) -> str:
    return f"""w6 AS (SELECT series_id, m, sd, k, row_number() OVER ({TIME}) - 1 AS i, n, avg(value) OVER f AS mean, first(ts) OVER f AS ts, last(ts) OVER f AS last FROM x WINDOW f AS ({TIME} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, mean < 0.4 * k * m AND m > {busy} AS low, mean > 2 * k * m AS high FROM w6 WHERE n >= 24 AND i >= 6 AND i % 3 = 0)"""


_SUSTAINED = ("w", "low OR high", "CoreSustained", "CASE WHEN low THEN 'SUSTAINED_LOW_QPS' ELSE 'SUSTAINED_HIGH_QPS' END", "CASE WHEN low AND mean < 0.2 * m THEN 'HIGH' WHEN NOT low AND mean > 3 * m THEN 'HIGH' ELSE 'MEDIUM' END", "m", "(mean - m) / sd", "mean", "ts", "last", "epoch(last) - epoch(ts)")
SQL["core_sustained"] = f"WITH {P}, {_core('SELECT series_id, ts, value FROM p')}, {_windows(1)} " + rows(*_SUSTAINED)

RANKED = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
UNRANKED = "CASE {r} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"


def _anchored(found: str) -> str:
    """Findings of one time as one event, from table ``found``: at hourly steps the anchor never reaches further."""
    f = "arg_min({c}, type || detected_by)"
    return f"""SELECT series_id, CASE WHEN count(DISTINCT type) > 1 THEN 'QPS_SPIKE' ELSE min(type) END AS type, {UNRANKED.format(r=f'max({RANKED})')} AS severity, ts, max(coalesce(end_ts, ts)) AS end_ts, (max(coalesce(end_ts, ts)) - ts)::INT AS duration_sec,
round({f.format(c='value')}, 6) AS value, round({f.format(c='baseline')}, 6) AS baseline, round({f.format(c='z_score')}, 6) AS z_score, NULL::DOUBLE AS confidence, {text("list_sort(list(DISTINCT detected_by[2:-2]))")} AS detected_by, NULL::VARCHAR AS instance,
CASE WHEN count(DISTINCT type) > 1 THEN 'Multiple anomalies' ELSE {f.format(c='detail')} END AS detail FROM {found} GROUP BY series_id, ts"""


_w, _s = _drops(500)
SQL["core_all"] = (
    f"WITH {P}, {_core('SELECT series_id, ts, value * 50 AS value FROM p')}, {_windows(100)}, f AS ("
    + rows("x", _w, "CoreDrop", "'QPS_DROP'", _s, "m", "(value - m) / sd", rounded=False) + " UNION ALL "
    + rows("x", "value >= m + 2 * k * sd AND value / m >= 1.5 + 0.3 * k AND NOT (value - m < 0.5 * m AND m < 500) AND value >= 200", "CoreSpike", "'QPS_SPIKE'", GRADE.format(z="value / m", h=3, c=5), "m", "(value - m) / sd", rounded=False) + " UNION ALL "
    + rows(*_SUSTAINED, rounded=False) + ") " + _anchored("f")
)

SQL["latency_anomalies"] = f"WITH {L}, v AS (SELECT series_id, ts, value * {FACTOR} AS value FROM l), s AS (SELECT series_id, median(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.9) AS p90, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT * FROM v JOIN s USING (series_id)) " + rows("x", "n >= 10 AND value > CASE WHEN m < 0.01 THEN 5.0 ELSE 2.5 END * m AND value - m >= 0.01 AND value >= 1.2 * p90", "Latency", "'LATENCY_SPIKE'", GRADE.format(z="value / m", h=4, c=10), "m * 1000", "(value - m) / sd", "value * 1000")
SQL["imbalance"] = f"WITH {I}, v AS (SELECT series_id, instance, ts, value * CASE WHEN instance = 'kv-7' THEN 5 ELSE 1 END AS value FROM i), g AS (SELECT series_id, instance, avg(value) AS value, count(*) AS n, min(ts) AS ts, max(ts) AS last FROM v GROUP BY ALL), x AS (SELECT *, avg(value) OVER ({WHOLE}) AS b, count(*) OVER ({WHOLE}) AS k FROM g WHERE n >= 10 AND value >= 1) " + rows("x", "k >= 2 AND abs(value / b - 1) >= 0.5", "Imbalance", "'INSTANCE_IMBALANCE'", "CASE WHEN abs(value / b - 1) > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "value / b - 1", end="last", instance="instance")
SQL["workload_types"] = f"WITH {K}, v AS (SELECT series_id || '/' || key AS series_id, ts, value * {FACTOR} AS value FROM k), s AS (SELECT series_id, median(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT *, value < m - 2 * sd AND (m - value) / m >= 0.3 AS low, value > m + 2 * sd AND value / m >= 1.5 AS high FROM v JOIN s USING (series_id) WHERE n >= 10 AND m >= 1 AND sd >= 0.2 * m) " + rows("x", "low OR high", "WorkloadType", SIDE.format(b="m"), "CASE WHEN low THEN CASE WHEN (m - value) / m > 0.7 THEN 'CRITICAL' WHEN (m - value) / m > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END WHEN value / m > 3 THEN 'CRITICAL' WHEN value / m > 2 THEN 'HIGH' ELSE 'MEDIUM' END", "m", "(value - m) / sd")

# robust and seasonal ---------------------------------------------------------------------------------------------


def _context(c: str, by: str) -> str:
    return f"{c} AS (SELECT {by} AS c, median(value) AS m, count(*) AS k FROM p GROUP BY ALL), {c}d AS (SELECT {c}.c, {c}.m, 1.4826 * median(abs(value - {c}.m)) AS d FROM p JOIN {c} ON {c}.c = {by} WHERE k >= 5 GROUP BY ALL HAVING d > 0)"


SQL["contextual"] = (
    f"WITH {P}, {_context('c1', 'hour(ts)')}, {_context('c2', 'dayofweek(ts)')}, {_context('c3', 'dayofweek(ts) * 24 + hour(ts)')}, u AS (" + " UNION ALL ".join(f"SELECT series_id, ts, value, abs(value - m) / d AS z, m AS b FROM p JOIN {c}d ON c = {by}" for c, by in (("c1", "hour(ts)"), ("c2", "dayofweek(ts)"), ("c3", "dayofweek(ts) * 24 + hour(ts)")))
    + "), x AS (SELECT series_id, ts, value, avg(z) AS z, avg(b) AS b FROM u GROUP BY ALL) " + rows("x", "z > 3 AND (SELECT count(*) FROM p) >= 35", "Contextual", SIDE.format(b="b"), GRADE.format(z="z", h=4.5, c=6.0), "b", "z")
)

DYNAMIC = f"""{N}, f AS (SELECT *, list(value) OVER w AS f, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS dev, value - median(value) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS de FROM n WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_aggregate(f, 'median') AS base FROM f), d AS (SELECT *, list_aggregate([abs(v - base) FOR v IN f], 'median') AS fd, avg(de) OVER (PARTITION BY i % 24) AS ph FROM g), ce AS (SELECT avg(ph) AS centre FROM (SELECT DISTINCT i % 24, ph FROM d)),
st AS (SELECT series_id, ts, i, value, base, ph - centre AS seasonal, CASE WHEN fd > 0 THEN 1.4826 * fd ELSE 0.01 * abs(base) END AS spread, CASE WHEN dev / mean > 0.5 THEN 1.5 WHEN dev / mean > 0.3 THEN 1.2 ELSE 1.0 END AS factor FROM d, ce),
sb AS (SELECT *, base + 3 * spread * factor + seasonal AS upper, base - 3 * spread * factor + seasonal AS lower FROM st)"""
SQL["dynamic_threshold_states"] = f"WITH {DYNAMIC} SELECT series_id, {SEC.format(x='ts')} AS ts, i::INT AS i, value, round(base, 6) AS base, round(seasonal, 6) AS seasonal, round(spread, 6) AS spread, round(factor::DOUBLE, 6) AS factor, round(upper, 6) AS upper, round(lower, 6) AS lower FROM sb"
SQL["dynamic_threshold"] = f"WITH {DYNAMIC}, x AS (SELECT *, abs(value - base) / (spread * factor) AS z FROM sb WHERE i >= 10 AND spread > 0) " + rows("x", "value > upper OR value < lower", "DynamicThreshold", SIDE.format(b="base"), GRADE.format(z="z", h=6, c=9), "base", "z")

_SCALES = (6, 12, 24, 48)
SQL["multi_scale"] = (
    f"WITH {N}" + "".join(f", m{s} AS (SELECT *, avg(value) OVER f AS mf, stddev_pop(value) OVER f AS sf, avg(value) OVER l AS ml, avg(value) OVER r AS mr, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr FROM n WINDOW f AS (ORDER BY ts ROWS BETWEEN {s // 2} PRECEDING AND {s // 2} FOLLOWING), l AS (ORDER BY ts ROWS BETWEEN {s // 2} PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {s // 2} FOLLOWING)), z{s} AS (SELECT i, CASE WHEN sf > 0 THEN abs(value - mf) / sf + 0.5 * CASE WHEN vl + vr > 0 THEN abs(ml - mr) / sqrt(vl + vr) ELSE abs(ml - mr) END ELSE 0 END AS z FROM m{s} WHERE i >= {s // 2} AND i < n - {s // 2})" for s in _SCALES)
    + ", u AS (" + " UNION ALL ".join(f"SELECT i, z FROM z{s} WHERE z > 3" for s in _SCALES) + "), q AS (SELECT i, count(*) AS hits, avg(z) AS z FROM u GROUP BY i HAVING count(*) >= 2), x AS (SELECT series_id, ts, value, hits, z, (SELECT median(value) FROM p) AS b FROM n JOIN q USING (i) WHERE n >= 96) "
    + rows("x", "true", "MultiScale", SIDE.format(b="b"), "CASE WHEN hits >= 4 THEN 'CRITICAL' WHEN hits = 3 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "z")
)

STL = f"""{N}, md AS (SELECT i, median(value) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS md FROM n), tr AS (SELECT a.i, sum(b.md * exp(-((a.i - b.i) ** 2) / 9.0)) / sum(exp(-((a.i - b.i) ** 2) / 9.0)) AS trend FROM md a JOIN md b ON abs(a.i - b.i) <= 3 GROUP BY a.i),
ph AS (SELECT i % 24 AS ph, avg(value - trend) AS mean FROM n JOIN tr USING (i) GROUP BY ALL), stl AS (SELECT series_id, ts, i, value, trend, mean - (SELECT sum(mean) / 24 FROM ph) AS seasonal FROM n JOIN tr USING (i) JOIN ph ON ph = i % 24 WHERE n >= 48), re AS (SELECT *, value - trend - seasonal AS residual FROM stl)"""
SQL["stl_parts"] = f"WITH {STL} SELECT series_id, {SEC.format(x='ts')} AS ts, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM re"
SQL["stl_mad"] = f"WITH {STL}, s AS (SELECT median(residual) AS m, stddev_pop(residual) AS sd FROM re), a AS (SELECT median(abs(residual - m)) AS mad FROM re, s), x AS (SELECT *, trend + seasonal AS b, abs(residual - m) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS z FROM re, s, a) " + rows("x", "z > 3.5", "STL", SIDE.format(b="b"), GRADE.format(z="z", h=5.25, c=7.0), "b", "z")
SQL["sustained_residual"] = f"WITH {STL}, w AS (SELECT series_id, i, avg(residual) OVER () AS mu, stddev_pop(residual) OVER () AS sd, avg(residual) OVER f AS r, avg(value) OVER f AS mean, avg(trend + seasonal) OVER f AS base, first(ts) OVER f AS ts, last(ts) OVER f AS last FROM re WINDOW f AS (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), x AS (SELECT *, abs(r - mu) / sd AS z FROM w WHERE i >= 12 AND (i - 12) % 6 = 0) " + rows("x", "z > 0.8", "SustainedResidual", "CASE WHEN r > 0 THEN 'SUSTAINED_HIGH_QPS' ELSE 'SUSTAINED_LOW_QPS' END", "CASE WHEN z > 3.5 THEN 'HIGH' ELSE 'MEDIUM' END", "base", "z", "mean", end="last", duration="epoch(last) - epoch(ts)")

# folds -----------------------------------------------------------------------------------------------------------

SQL["esd"] = (
    f"""WITH RECURSIVE {N}, s AS (SELECT list({{'i': i, 'v': value}} ORDER BY i) AS xs, avg(value) AS mu, greatest(1, (0.02 * count(*))::INT) AS most FROM n),
r(k, xs, i, d, c) AS (SELECT 0, xs, -1::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM s UNION ALL SELECT k + 1, list_filter(xs, lambda x: x['i'] <> top['i']), top['i'], top['d'], lim FROM (SELECT k, xs, list_reduce([{{'i': x['i'], 'd': abs(x['v'] - mu) / sd}} FOR x IN xs], lambda a, b: CASE WHEN b['d'] > a['d'] THEN b ELSE a END) AS top, (len(xs) - 1) / sqrt(len(xs)) * sqrt(100.0 / (len(xs) + 98)) AS lim FROM (SELECT k, xs, list_aggregate([x['v'] FOR x IN xs], 'avg') AS mu, list_aggregate([x['v'] FOR x IN xs], 'stddev_pop') AS sd FROM r WHERE k < (SELECT most FROM s) AND len(xs) >= 10)) WHERE top['d'] > lim),
x AS (SELECT series_id, ts, value, mu, d, c FROM r JOIN n USING (i), s) """
    + rows("x", "true", "ESD", SIDE.format(b="mu"), "CASE WHEN d > 1.5 * c THEN 'HIGH' ELSE 'MEDIUM' END", "mu", "d")
)
SQL["ema_detector"] = (
    f"""WITH RECURSIVE {N}, r(i, mean, dev) AS (SELECT 0::BIGINT, (SELECT value FROM n WHERE i = 0), (SELECT stddev_pop(value) FROM n) UNION ALL SELECT n.i, 0.2 * value + 0.8 * mean, sqrt(0.2 * (value - mean) ** 2 + 0.8 * dev ** 2) FROM r JOIN n ON n.i = r.i + 1),
x AS (SELECT series_id, ts, value, mean, abs(value - mean) / dev AS z FROM r JOIN n USING (i) WHERE i >= 10 AND dev > 0) """
    + rows("x", "z > 0.9", "EMA", SIDE.format(b="mean"), GRADE.format(z="z", h=1.5, c=2.1), "mean", "z")
)
SQL["holt_winters"] = (
    f"""WITH RECURSIVE {N}, f AS (SELECT avg(value) FILTER (WHERE i < 24) AS level, (avg(value) FILTER (WHERE i BETWEEN 24 AND 47) - avg(value) FILTER (WHERE i < 24)) / 24 AS trend, list(value ORDER BY i) FILTER (WHERE i < 24) AS v FROM n),
r(i, fit, level, trend, s) AS (SELECT 23::BIGINT, NULL::DOUBLE, level, trend, [x - level FOR x IN v] FROM f UNION ALL SELECT i, fit, l2, 0.1 * (l2 - level) + 0.9 * trend, [CASE WHEN j = i % 24 + 1 THEN 0.1 * (value - l2) + 0.9 * own ELSE s[j] END FOR j IN range(1, 25)] FROM (SELECT n.i, value, level, trend, s, s[n.i % 24 + 1] AS own, level + trend + s[n.i % 24 + 1] AS fit, 0.3 * (value - s[n.i % 24 + 1]) + 0.7 * (level + trend) AS l2 FROM r JOIN n ON n.i = r.i + 1)),
q AS (SELECT n.series_id, n.ts, n.i, value, coalesce(fit, value) AS fit FROM n LEFT JOIN r ON r.i = n.i), st AS (SELECT avg(value - fit) AS mu, stddev_pop(value - fit) AS sd FROM q), x AS (SELECT *, abs(value - fit - mu) / sd AS z FROM q, st WHERE i >= 48) """
    + rows("x", "z > 3", "HoltWinters", SIDE.format(b="fit"), GRADE.format(z="z", h=4.5, c=6.0), "fit", "z")
)
SQL["dbscan"] = (
    f"WITH {N}, s AS (SELECT median(value) AS m, stddev_pop(value) AS sd FROM n), a AS (SELECT median(abs(value - m)) AS mad FROM n, s), z AS (SELECT n.*, m, (value - m) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END AS z FROM n, s, a), nb AS (SELECT x.i, y.i AS j FROM z x JOIN z y ON y.i BETWEEN x.i - 24 AND x.i + 24 AND x.i <> y.i AND abs(x.z - y.z) <= 2), co AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= 5) "
    + rows("z", "i NOT IN (SELECT i FROM co) AND i NOT IN (SELECT i FROM nb WHERE j IN (SELECT i FROM co))", "DBSCAN", SIDE.format(b="m"), GRADE.format(z="abs(z)", h=3, c=4), "m", "z")
)

AROUND = "avg(value) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean_before, avg(value) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS mean_after, stddev_pop(value) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS std_before, stddev_pop(value) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS std_after"
NEAR = f"ar AS (SELECT *, {AROUND}, stddev_pop(value) OVER () AS sd FROM n)"


def _points(source: str, confidence: str, method: str) -> str:
    return f"SELECT series_id, i::INT AS idx, {SEC.format(x='ts')} AS ts, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after, round(std_before, 6) AS std_before, round(std_after, 6) AS std_after, round({confidence}, 6) AS confidence, '{method}' AS method FROM {source} JOIN ar USING (i)"


SQL["cusum"] = (
    f"""WITH RECURSIVE {N}, {NEAR}, st AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM n), r(i, up, down, last, hit) AS (SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, -10::BIGINT, false UNION ALL SELECT i, CASE WHEN hit THEN 0 ELSE u END, CASE WHEN hit THEN 0 ELSE d END, CASE WHEN hit THEN i ELSE last END, hit FROM (SELECT *, (u > 2 * s OR d > 2 * s) AND i - last >= 10 AND i > 0 AS hit FROM (SELECT n.i, s, last, greatest(0, up + value - m - s / 2) AS u, greatest(0, down + m - value - s / 2) AS d FROM r JOIN n ON n.i = r.i + 1, st))),
c AS (SELECT i FROM r WHERE hit) """
    + _points("c", "abs(mean_after - mean_before) / sd", "cusum")
)
SQL["sliding_window"] = (
    f"""WITH RECURSIVE {N}, {NEAR}, tt AS (SELECT i, abs(mean_after - mean_before) / sqrt((std_before ** 2 + std_after ** 2) / 2) / sqrt(0.2) AS t FROM ar WHERE i BETWEEN 10 AND n - 10 AND std_before ** 2 + std_after ** 2 > 0), hs AS (SELECT list(i ORDER BY i) AS xs FROM tt WHERE t > 2),
r(i, xs) AS (SELECT -1::BIGINT, xs FROM hs UNION ALL SELECT xs[1], list_filter(xs, lambda x: x >= xs[1] + 6) FROM r WHERE len(xs) > 0), c AS (SELECT r.i, t FROM r JOIN tt USING (i)) """
    + _points("c", "t / 2", "window")
)
PELT = f"""{N}, {NEAR}, pre AS (SELECT list_prepend(0.0::DOUBLE, list(a ORDER BY i)) AS s1, list_prepend(0.0::DOUBLE, list(b ORDER BY i)) AS s2, max(i) + 1 AS n, 3 * var_pop(value) * ln(count(*)) AS pen FROM (SELECT i, value, sum(value) OVER (ORDER BY i) AS a, sum(value * value) OVER (ORDER BY i) AS b FROM n)),
r(e, best, back) AS (SELECT 0::BIGINT, [-pen], [0::BIGINT] FROM pre UNION ALL SELECT e + 1, list_append(best, coalesce(low['c'], 'inf'::DOUBLE)), list_append(back, coalesce(low['s'], 0)) FROM (SELECT e, best, back, list_reduce([{{'c': best[s + 1] + (s2[e + 2] - s2[s + 1]) - (s1[e + 2] - s1[s + 1]) ** 2 / (e + 1 - s) + pen, 's': s}} FOR s IN range(0, e - 8)], lambda a, b: CASE WHEN b['c'] < a['c'] THEN b ELSE a END) AS low FROM r, pre WHERE e < n AND e >= 9 UNION ALL SELECT e, best, back, NULL FROM r, pre WHERE e < 9)),
fin AS (SELECT back FROM r JOIN pre ON e = n), cuts(e) AS (SELECT back[len(back)] FROM fin UNION ALL SELECT back[e + 1] FROM cuts, fin WHERE e > 0), c AS (SELECT DISTINCT e AS i FROM cuts WHERE e > 0)"""
SQL["pelt"] = f"WITH RECURSIVE {PELT} " + _points("c", "abs(mean_after - mean_before) / sd", "pelt")


def _forecast(beta: float | None) -> str:
    trend0, trend = ("b.value - a.value", f"{beta} * (l2 - l) + {1 - beta} * t") if beta is not None else ("0.0::DOUBLE", "0.0::DOUBLE")
    half = "sqrt(1 + 0.1 * st)" if beta is not None else "sqrt(1 + st * 0.04)"
    return f"""WITH RECURSIVE {N}, r(i, l, t, e, x) AS (SELECT 0::BIGINT, a.value, {trend0}, NULL::DOUBLE, NULL::DOUBLE FROM n a, n b WHERE a.i = 0 AND b.i = 1 UNION ALL SELECT i, l2, {trend}, value - l - t, value FROM (SELECT n.i, l, t, value, 0.2 * value + 0.8 * (l + t) AS l2 FROM r JOIN n ON n.i = r.i + 1)),
er AS (SELECT sqrt(greatest(0, avg(e * e) - avg(e) ** 2)) AS s, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, coalesce(avg(abs(e) / abs(x)) FILTER (WHERE x <> 0), 0) * 100 AS mape FROM r), la AS (SELECT l, t FROM r ORDER BY i DESC LIMIT 1)
SELECT 'all' AS series_id, '{'holt' if beta is not None else 'ses'}' AS method, st::INT AS step, round(l + st * t, 6) AS prediction, round(l + st * t - 1.96 * s * {half}, 6) AS lower, round(l + st * t + 1.96 * s * {half}, 6) AS upper, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape FROM la, er, range(1, 25) q(st)"""


SQL["forecast_ses"], SQL["forecast_holt"] = _forecast(None), _forecast(0.1)

PEAKS = f"""{N}, pe AS (SELECT i, value, n FROM (SELECT *, lag(value) OVER (ORDER BY i) AS a, lead(value) OVER (ORDER BY i) AS b FROM n) WHERE value > a AND value > b), st AS (SELECT pe.i, pe.value AS v, pe.n, coalesce(max(y.i) FILTER (WHERE y.i < pe.i), 0) AS lo, coalesce(min(y.i) FILTER (WHERE y.i > pe.i), pe.n - 1) AS hi FROM pe LEFT JOIN n y ON y.value > pe.value GROUP BY pe.i, pe.value, pe.n),
ba AS (SELECT st.i, v, st.n, arg_min(y.i, (y.value, -y.i)) FILTER (WHERE y.i <= st.i) AS lb, arg_min(y.i, (y.value, y.i)) FILTER (WHERE y.i >= st.i) AS rb, v - greatest(min(y.value) FILTER (WHERE y.i <= st.i), min(y.value) FILTER (WHERE y.i >= st.i)) AS pm FROM st JOIN n y ON y.i BETWEEN lo AND hi GROUP BY st.i, v, st.n),
wd AS (SELECT ba.i, v, lb, rb, pm, 1 + ba.i - coalesce(max(y.i) FILTER (WHERE y.i < ba.i), 0) + coalesce(min(y.i) FILTER (WHERE y.i > ba.i), ba.n - 1) - ba.i AS width FROM ba LEFT JOIN n y ON y.value < v - pm / 2 GROUP BY ba.i, v, lb, rb, pm, ba.n),
pl(i, xs) AS (SELECT -9::BIGINT, (SELECT list(i ORDER BY pm DESC, i) FROM wd) UNION ALL SELECT xs[1], list_filter(xs, lambda x: abs(x - xs[1]) >= 5) FROM pl WHERE len(xs) > 0), pk AS (SELECT n.series_id, n.ts, wd.* FROM pl JOIN wd USING (i) JOIN n USING (i))"""
SQL["peaks"] = f"WITH RECURSIVE {PEAKS} SELECT series_id, i::INT AS idx, {SEC.format(x='ts')} AS ts, v AS value, round(pm, 6) AS prominence, width::INT AS width, lb::INT AS left_base, rb::INT AS right_base FROM pk"
SQL["peak_anomalies"] = f"WITH RECURSIVE {PEAKS}, sd AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM n), x AS (SELECT * FROM pk, sd WHERE sd > 0) " + rows("x", "true", "Peaks", "'QPS_SPIKE'", "CASE WHEN pm > 5 * sd THEN 'CRITICAL' WHEN pm > 3 * sd THEN 'HIGH' ELSE 'MEDIUM' END", "mu", "(v - mu) / sd", "v")


def _lines(out: str, source: str, phase: bool) -> str:
    """Local lines with Gaussian weights through the seven rows (of a phase) around each row of source (i, x)."""
    on = "a.i % 24 = b.i % 24 AND abs(a.i - b.i) <= 72" if phase else "abs(a.i - b.i) <= 3"
    d = "((b.i - a.i) // 24)" if phase else "(b.i - a.i)"
    return f"{out}s AS (SELECT a.i, {d} AS d, exp(-({d} * {d}) / 9.0) AS w, b.x FROM {source} a JOIN {source} b ON {on}), {out}t AS (SELECT i, sum(w) AS sw, sum(w * d) AS sx, sum(w * d * d) AS sxx, sum(w * x) AS sy, sum(w * d * x) AS sxy FROM {out}s GROUP BY i), {out} AS (SELECT i, CASE WHEN abs(sw * sxx - sx * sx) > 1e-12 THEN (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) ELSE sy / sw END AS x FROM {out}t)"


def _pass(k: int, trend: str) -> str:
    return f"v{k} AS (SELECT n.i, value - {trend} AS x FROM n{'' if k == 1 else f' JOIN tr{k - 1} t USING (i)'}), {_lines(f'cy{k}', f'v{k}', True)}, sea{k} AS (SELECT i, x - avg(x) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM cy{k}), u{k} AS (SELECT n.i, value - x AS x FROM n JOIN sea{k} USING (i)), {_lines(f'tr{k}', f'u{k}', False)}"


SQL["robust_stl"] = f"WITH {N}, {_pass(1, '0')}, {_pass(2, 't.x')} SELECT series_id, {SEC.format(x='ts')} AS ts, value, round(t.x, 6) AS trend, round(s.x, 6) AS seasonal, round(value - t.x - s.x, 6) AS residual FROM n JOIN tr2 t USING (i) JOIN sea2 s USING (i)"

SQL["modes"] = f"""WITH {N}, q AS (SELECT min(value) AS lo, max(value) AS hi, 1.06 * stddev_pop(value) * count(*) ** -0.2 AS width, count(*) AS n FROM p), g AS (SELECT k, lo + k * ((hi - lo) / 999) AS x FROM q, range(0, 1000) t(k)), de AS (SELECT k, any_value(x) AS x, sum(exp(-0.5 * ((x - value) / width) ** 2)) AS d FROM g, p, q GROUP BY k),
mo AS (SELECT x FROM (SELECT x, d, lag(d) OVER (ORDER BY k) AS a, lead(d) OVER (ORDER BY k) AS b FROM de) WHERE d > a AND d > b), di AS (SELECT max(abs(r / n - (value - lo) / (hi - lo))) AS dip FROM (SELECT value, row_number() OVER (ORDER BY value) AS r FROM p), q)
SELECT 'all' AS series_id, round(x, 6) AS mode, round((SELECT avg((abs(value - x) <= (hi - lo) / 20)::INT) FROM p), 6) AS weight, round(dip, 6) AS dip, (SELECT count(*) FROM mo)::INT AS n_modes FROM mo, q, di"""

SQL["regimes"] = f"""WITH RECURSIVE {N}, rl AS (SELECT i, CASE WHEN i >= 9 THEN avg(value) OVER f END AS a, CASE WHEN i >= 9 THEN stddev_pop(value) OVER f END AS b FROM n WINDOW f AS (ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), w AS (SELECT i, avg(a) OVER l AS al, avg(a) OVER r AS ar, var_pop(a) OVER l + var_pop(a) OVER r AS av, avg(b) OVER l AS bl, avg(b) OVER r AS br, var_pop(b) OVER l + var_pop(b) OVER r AS bv FROM rl WINDOW l AS (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
hx AS (SELECT list(i ORDER BY i) AS xs FROM w WHERE i >= 14 AND i < (SELECT count(*) FROM n) - 5 AND ((av > 0 AND abs(ar - al) / sqrt(av / 5) > 2.5) OR (bv > 0 AND abs(br - bl) / sqrt(bv / 5) > 2.5))), r(i, xs) AS (SELECT 0::BIGINT, coalesce(xs, []) FROM hx UNION ALL SELECT xs[1], list_filter(xs, lambda x: x >= xs[1] + 6) FROM r WHERE len(xs) > 0),
c AS (SELECT i AS a, lead(i, 1, (SELECT count(*) FROM n)) OVER (ORDER BY i) AS b, row_number() OVER (ORDER BY i) - 1 AS k FROM r)
SELECT series_id, k::INT AS regime, {SEC.format(x='min(ts)')} AS start_ts, {SEC.format(x='max(ts)')} AS end_ts, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*)::INT AS n FROM c JOIN n ON n.i >= a AND n.i < b GROUP BY series_id, k"""

#: Recursive best splits, a queue of segments: table ed (i, confidence).
DIVIDED = """pr AS (SELECT list_prepend(0.0::DOUBLE, list(a ORDER BY i)) AS s1, list_prepend(0.0::DOUBLE, list(b ORDER BY i)) AS s2, max(i) + 1 AS n, var_pop(value) AS va FROM (SELECT i, value, sum(value) OVER (ORDER BY i) AS a, sum(value * value) OVER (ORDER BY i) AS b FROM n)),
dv(todo, got) AS (SELECT [{'a': 0::BIGINT, 'b': n}], [{'i': -1::BIGINT, 'c': 0.0::DOUBLE}] FROM pr UNION ALL SELECT CASE WHEN hit THEN list_concat(todo[2:], [{'a': a, 'b': a + k}, {'a': a + k, 'b': b}]) ELSE todo[2:] END, CASE WHEN hit THEN list_append(got, {'i': a + k, 'c': stat / lim}) ELSE got END FROM
(SELECT *, best['k'] AS k, best['s'] AS stat, b - a >= 20 AND best['s'] > lim AS hit FROM (SELECT todo, got, a, b, 1.645 * sqrt(b - a) * 0.5 * va AS lim, CASE WHEN b - a >= 20 THEN list_reduce([{'k': k, 's': ((b - a - k) * (s2[a + k + 1] - s2[a + 1]) + k * (s2[b + 1] - s2[a + k + 1]) - 2 * (s1[a + k + 1] - s1[a + 1]) * (s1[b + 1] - s1[a + k + 1])) / (b - a)
- (s2[a + k + 1] - s2[a + 1] - (s1[a + k + 1] - s1[a + 1]) ** 2 / k + s2[b + 1] - s2[a + k + 1] - (s1[b + 1] - s1[a + k + 1]) ** 2 / (b - a - k))} FOR k IN range(5, b - a - 4)], lambda x, y: CASE WHEN y['s'] > x['s'] THEN y ELSE x END) END AS best FROM (SELECT *, todo[1]['a'] AS a, todo[1]['b'] AS b FROM dv, pr WHERE len(todo) > 0 AND len(got) <= 10)))),
ed AS (SELECT x['i'] AS i, x['c'] AS c FROM (SELECT unnest(got) AS x FROM (SELECT got FROM dv ORDER BY len(got) DESC, len(todo) LIMIT 1)) WHERE x['i'] >= 0)"""
#: The hourly series with a level that rises twice.
SHIFTED = H + ", p AS (SELECT series_id, ts, value + CASE WHEN day(ts) >= 21 THEN 160 WHEN day(ts) >= 11 THEN 60 ELSE 0 END AS value FROM h), n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM p)"
SQL["e_divisive"] = f"WITH RECURSIVE {SHIFTED}, {NEAR}, {DIVIDED} " + _points("ed", "c", "e_divisive")


def _tables(sql: str) -> str:
    """The tables of a statement on N and NEAR, without these."""
    return sql.split(NEAR + ", ", 1)[1].rsplit(" SELECT series_id", 1)[0]


SQL["all_change_points"] = (
    f"WITH RECURSIVE {N}, {NEAR}, {_tables(SQL['cusum']).replace('r(i', 'cr(i').replace('FROM r ', 'FROM cr ').replace(' r.i', ' cr.i').replace('c AS (SELECT i', 'cc AS (SELECT i')}, {_tables(SQL['sliding_window']).replace('r(i', 'sr(i').replace('FROM r ', 'FROM sr ').replace('c AS (SELECT r.i, t FROM sr JOIN', 'sc AS (SELECT sr.i, t FROM sr JOIN')}, {PELT.split(NEAR + ', ', 1)[1].replace('c AS (SELECT DISTINCT', 'pc AS (SELECT DISTINCT')}, {DIVIDED}, "
    f"au AS ({_points('cc', 'abs(mean_after - mean_before) / sd', 'cusum')} UNION ALL {_points('sc', 't / 2', 'window')} UNION ALL {_points('pc', 'abs(mean_after - mean_before) / sd', 'pelt')} UNION ALL {_points('ed', 'c', 'e_divisive')}), ab AS (SELECT *, row_number() OVER (PARTITION BY series_id, idx // 10 ORDER BY confidence DESC, method) AS k FROM au), ac AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY series_id ORDER BY confidence DESC, idx) AS k FROM ab WHERE k = 1) SELECT * EXCLUDE (k) FROM ac WHERE k <= 10"
)

#: S-H-ESD in pieces of 48 to 99 points, where one point may go.
SQL["shesd"] = (
    f"""WITH {N}, sz AS (SELECT CASE WHEN count(*) > 240 THEN greatest(count(*) // 10, 48) ELSE count(*) END AS size FROM n), pc AS (SELECT n.*, i // size AS piece, i % size AS j, count(*) OVER (PARTITION BY i // size) AS m FROM n, sz), pp AS (SELECT * FROM pc WHERE m >= 48),
tr AS (SELECT a.piece, a.j, sum(b.value * exp(-((a.j - b.j) ** 2) / 144.0)) / sum(exp(-((a.j - b.j) ** 2) / 144.0)) AS trend FROM pp a JOIN pp b ON a.piece = b.piece AND abs(a.j - b.j) <= 12 GROUP BY ALL), ph AS (SELECT piece, j % 24 AS ph, avg(value - trend) AS mean FROM pp JOIN tr USING (piece, j) GROUP BY ALL),
re AS (SELECT pp.*, trend + mean - avg_mean AS base, value - trend - (mean - avg_mean) AS r FROM pp JOIN tr USING (piece, j) JOIN ph ON ph.piece = pp.piece AND ph.ph = pp.j % 24 JOIN (SELECT piece, avg(mean) AS avg_mean FROM ph GROUP BY ALL) am ON am.piece = pp.piece), q AS (SELECT piece, median(r) AS med FROM re GROUP BY ALL), q2 AS (SELECT piece, any_value(med) AS med, 1.4826 * median(abs(r - med)) AS dev, count(*) AS m FROM re JOIN q USING (piece) GROUP BY ALL),
x AS (SELECT * FROM (SELECT re.*, abs(r - med) / dev AS d, (q2.m - 1) / sqrt(q2.m) * sqrt(25.0 / (q2.m + 23)) AS c, row_number() OVER (PARTITION BY re.piece ORDER BY abs(r - med) DESC, j) AS rk FROM re JOIN q2 USING (piece) WHERE dev > 0) WHERE rk = 1 AND d > c) """
    + rows("x", "true", "SHESD", SIDE.format(b="base"), "CASE WHEN d > 2 * c THEN 'CRITICAL' WHEN d > 1.5 * c THEN 'HIGH' ELSE 'MEDIUM' END", "base", "d")
)
_ERRORS = "avg(abs(value - {p})) AS mae, sqrt(avg((value - {p}) ** 2)) AS rmse, coalesce(avg(abs(value - {p}) / abs(value)) FILTER (WHERE value <> 0), 0) * 100 AS mape"
_STEPS = "round(pr, 6) AS prediction, round(pr - hf, 6) AS lower, round(pr + hf, 6) AS upper, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape"
SQL["forecast_auto"] = f"""WITH RECURSIVE {N}, pd AS (SELECT coalesce(max(a), 0) AS a FROM (SELECT k, sum(x.d * y.d) / (SELECT sum((value - mu) ** 2) FROM n, (SELECT avg(value) AS mu FROM n)) AS a FROM (SELECT i, value - avg(value) OVER () AS d, n FROM n) x JOIN range(6, 168) t(k) ON k < least(x.n // 2, 168) JOIN (SELECT i, value - avg(value) OVER () AS d FROM n) y ON y.i = x.i + k GROUP BY k)),
st AS (SELECT stddev_pop(value) / avg(value) AS cv, avg(value) FILTER (WHERE third = 1) AS a, avg(value) FILTER (WHERE third = 3) AS b, count(*) AS n FROM (SELECT *, ntile(3) OVER (ORDER BY i) AS third FROM n)), ch AS (SELECT CASE WHEN cv < 0.1 THEN 'sma' WHEN cv < 0.3 THEN 'ses' WHEN st.n >= 48 AND pd.a > 0.3 THEN 'seasonal_naive' WHEN abs((b - st.a) / st.a) > 0.5 THEN 'linear' ELSE 'holt' END AS method FROM st, pd),
ma AS (SELECT 'sma' AS method, p, s, {_ERRORS.format(p='p')} FROM n, (SELECT avg(value) FILTER (WHERE i >= n - 5) AS p, stddev_pop(value) AS s FROM n) GROUP BY p, s), sl AS (SELECT list(value ORDER BY i) FILTER (WHERE i >= n - 24) AS v, stddev_pop(value) FILTER (WHERE i >= n - 24) AS s FROM n), se AS (SELECT v, s, {_ERRORS.format(p='v[24]')} FROM n, sl GROUP BY v, s),
lf AS (SELECT regr_slope(value, i) AS b, regr_intercept(value, i) AS a, count(*) AS n, avg(i) AS mx, regr_sxx(value, i) AS sxx FROM n), li AS (SELECT a, b, lf.n, mx, sxx, sqrt(sum((value - a - b * i) ** 2) / (lf.n - 2)) AS e, {_ERRORS.format(p='(a + b * i)')} FROM n, lf GROUP BY a, b, lf.n, mx, sxx),
al AS (SELECT 'sma' AS method, st::INT AS step, p AS pr, 1.96 * s * sqrt(1 + (st - 1) / 5) AS hf, mae, rmse, mape FROM ma, range(1, 25) t(st) UNION ALL SELECT 'seasonal_naive', st::INT, v[st], 1.96 * s, mae, rmse, mape FROM se, range(1, 25) t(st) UNION ALL SELECT 'linear', st::INT, a + b * (n + st - 1), 1.96 * e * sqrt(1 + 1 / n + (n + st - 1 - mx) ** 2 / sxx), mae, rmse, mape FROM li, range(1, 25) t(st)),
sx AS ({SQL['forecast_ses'].replace('WITH RECURSIVE ' + N + ', r(', 'WITH RECURSIVE r(')}), hx AS ({SQL['forecast_holt'].replace('WITH RECURSIVE ' + N + ', r(', 'WITH RECURSIVE r(')})
SELECT 'all' AS series_id, method, step, {_STEPS} FROM al JOIN ch USING (method) UNION ALL SELECT series_id, method, step, prediction, lower, upper, mae, rmse, mape FROM sx JOIN ch USING (method) UNION ALL SELECT series_id, method, step, prediction, lower, upper, mae, rmse, mape FROM hx JOIN ch USING (method)"""

#: The hourly series on a floor, with lone peaks.
LONE = H + f", p AS (SELECT series_id, ts, CASE WHEN {HOUR} % 331 = 5 THEN 900 ELSE 100 + value END AS value FROM h), n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM p)"
SQL["spectral_residual"] = (
    f"""WITH {LONE}, m AS (SELECT (2 ** ceil(log2(count(*))))::BIGINT AS n2 FROM n), f AS (SELECT k, any_value(n2) AS n2, sum(value * cos(2 * pi() * ((k * i) % n2) / n2)) AS re, -sum(value * sin(2 * pi() * ((k * i) % n2) / n2)) AS im FROM n, m, range(0, 65536) t(k) WHERE k < n2 GROUP BY k),
am AS (SELECT *, ln(sqrt(re * re + im * im) + 1e-10) AS a FROM f), sm AS (SELECT *, exp(a - (lag(a, 1, a) OVER (ORDER BY k) + a + lead(a, 1, a) OVER (ORDER BY k)) / 3) AS g, atan2(im, re) AS ph FROM am), sa AS (SELECT i, abs(sum(g * cos(ph) * cos(2 * pi() * ((k * i) % n2) / n2) - g * sin(ph) * sin(2 * pi() * ((k * i) % n2) / n2)) / any_value(n2)) AS s FROM n, sm GROUP BY i),
z0 AS (SELECT i, s, avg(s) OVER w AS mean, stddev_pop(s) OVER w AS dev FROM sa WINDOW w AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), z1 AS (SELECT i, CASE WHEN dev > 0 THEN (s - mean) / dev ELSE 0 END AS z FROM z0), z2 AS (SELECT i, z, list_sort(list_filter(list(z) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), lambda x: x > 0)) AS near FROM z1),
z3 AS (SELECT i, z, CASE WHEN len(near) > 0 THEN near[(len(near) * 3) // 4 + 1] * 3 ELSE 3 END AS lim FROM z2), x AS (SELECT n.*, z, lim, (SELECT median(value) FROM n) AS b FROM n JOIN z3 USING (i) WHERE i >= 21 AND i < n - 21 AND z > lim) """
    + rows("x", "true", "SpectralResidual", SIDE.format(b="b"), GRADE.format(z="z / lim", h=2, c=3), "b", "z")
)

# raw gauges ------------------------------------------------------------------------------------------------------

STEP = "gp AS (SELECT (epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts))::BIGINT AS g FROM t), sp AS (SELECT greatest(60, least(900, list_sort(list(g))[len(list(g)) // 2 + 1])) AS step FROM gp WHERE g > 0)"


def _runs(flagged: str, least: int) -> str:
    """Runs of flagged points (table with rank, b, z) with gaps of three steps at most, by their strongest point."""
    return f"""{STEP}, rn AS (SELECT f.*, step, coalesce((epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) > 3 * step)::INT, 1) AS new FROM {flagged} f, sp), ri AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM rn),
x AS (SELECT series_id, min(ts) AS ts, max(ts) AS last, max(step) AS step, arg_max(value, rank) AS value, arg_max(b, rank) AS b, arg_max(z, rank) AS z, max(rank) AS rank FROM ri GROUP BY series_id, g HAVING count(*) >= {least})"""


SQL["raw_rolling"] = (
    f"""WITH {TEN}, v AS (SELECT *, list_sort(list(value) OVER (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS f, row_number() OVER (ORDER BY ts) - 1 AS i, median(value) OVER () AS gm, count(*) OVER () AS n FROM t), y AS (SELECT *, f[(len(f) - 1) * 50 // 100 + 1] AS b FROM v WHERE i >= 60 AND n >= 80),
d AS (SELECT *, (value - b) / (1.4826 * list_sort([abs(q - b) FOR q IN f])[(len(f) - 1) * 50 // 100 + 1] + 1e-9) AS z FROM y), fl AS (SELECT series_id, ts, value, b, z, abs(z) AS rank FROM d WHERE abs(z) >= 6 AND abs(value - b) >= CASE WHEN gm < 1 THEN 5 ELSE greatest(0.2, 0.1 * gm) END), {_runs('fl', 3)} """
    + rows("x", "true", "RawRolling", SIDE.format(b="b"), "CASE WHEN rank >= 12 THEN 'CRITICAL' WHEN rank >= 9 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "z", end="last", duration="epoch(last) - epoch(ts) + step", confidence="least(0.95, 0.55 + least(0.35, rank / 30))")
)
SQL["sustained_latency"] = (
    f"""WITH {TEN}, q AS (SELECT count(*) AS n, greatest(1.0, 8 * median(value), 3 * quantile_cont(value, 0.75)) AS lim, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.99) AS p99 FROM t), q2 AS (SELECT n, b, CASE WHEN p99 > 5 * lim THEN 1.5 * lim ELSE lim END AS lim FROM q),
fl AS (SELECT series_id, ts, value, b, value / lim AS z, value / lim AS rank FROM t, q2 WHERE n >= 60 AND value >= lim), {_runs('fl', 6)} """
    + rows("x", "true", "sustained_latency", "'LATENCY_DEGRADED'", "'HIGH'", "b", "z", end="last", duration="epoch(last) - epoch(ts) + step", confidence="CASE WHEN rank >= 1.8 THEN 0.85 ELSE 0.72 END")
)

SQL["raw_rolling_mad"] = (
    f"""WITH {P}, t AS (SELECT * FROM p), v AS (SELECT *, list_sort(list(value) OVER (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS f, row_number() OVER (ORDER BY ts) - 1 AS i, median(value) OVER () AS gm, count(*) OVER () AS n FROM t), y AS (SELECT *, f[(len(f) - 1) * 50 // 100 + 1] AS b FROM v WHERE i >= 60 AND n >= 80),
d AS (SELECT *, (value - b) / (1.4826 * list_sort([abs(q - b) FOR q IN f])[(len(f) - 1) * 50 // 100 + 1] + 1e-9) AS z FROM y), fl AS (SELECT series_id, ts, value, b, z, abs(z) AS rank FROM d WHERE abs(z) >= 6 AND abs(value - b) >= CASE WHEN gm < 1 THEN 5 ELSE greatest(0.2, 0.1 * gm) END), {_runs('fl', 1)} """
    + rows("x", "true", "RawRolling", SIDE.format(b="b"), "CASE WHEN rank >= 12 THEN 'CRITICAL' WHEN rank >= 9 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "z", end="last", duration="epoch(last) - epoch(ts) + step", confidence="least(0.95, 0.55 + least(0.35, rank / 30))")
)
SQL["multi_scale_scores"] = f"WITH {N}, x AS (SELECT *, avg(value) OVER w AS mf, stddev_pop(value) OVER w AS sf, avg(value) OVER l AS ml, avg(value) OVER r AS mr, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr FROM n WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), l AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT series_id, {SEC.format(x='ts')} AS ts, round(CASE WHEN sf > 0 THEN abs(value - mf) / sf + 0.5 * CASE WHEN vl + vr > 0 THEN abs(ml - mr) / sqrt(vl + vr) ELSE abs(ml - mr) END ELSE 0 END, 6) AS score FROM x WHERE i >= 3 AND i < n - 3"

# events ----------------------------------------------------------------------------------------------------------

FOUND = (
    f"{P}, {STATS.format(t='p')}, mx AS (SELECT *, {ROBUST} AS z FROM p JOIN s USING (series_id) JOIN a USING (series_id)), hx AS (SELECT *, abs(value - b) / sd AS z FROM (SELECT *, avg(value) OVER w AS b, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY series_id, hour(ts))) WHERE k >= 2 AND sd > 0), f AS ("
    + rows("mx", "z > 3.5", "MAD", SIDE.format(b="m"), GRADE.format(z="z", h=5.25, c=7.0), "m", "z", rounded=False) + " UNION ALL "
    + rows("hx", "z > 3", "HourlyBaseline", SIDE.format(b="b"), "CASE WHEN z > 4.5 THEN 'HIGH' ELSE 'MEDIUM' END", "b", "z", rounded=False) + ")"
)


def _sessions(base: int) -> str:
    """Table ev: findings in sessions by the adaptive window."""
    return f"""{FOUND}, gg AS (SELECT series_id, ts - lag(ts) OVER ({TIME}) AS g FROM f), gm AS (SELECT series_id, list_sort(list(g))[len(list(g)) // 2 + 1] AS m FROM gg WHERE g > 0 GROUP BY ALL), ww AS (SELECT series_id, CASE WHEN m < 60 THEN 60 WHEN m > {base} THEN least(m, 900) ELSE {base} END AS w FROM (SELECT DISTINCT series_id FROM f) LEFT JOIN gm USING (series_id)),
sn AS (SELECT f.*, coalesce(end_ts, ts) AS e, coalesce((ts - max(coalesce(end_ts, ts)) OVER (PARTITION BY f.series_id ORDER BY ts, detected_by ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > w)::INT, 1) AS new FROM f JOIN ww USING (series_id)), si AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts, detected_by ROWS UNBOUNDED PRECEDING) AS id FROM sn),
ev AS (SELECT series_id, min(ts) AS ts, max(e) AS end_ts, max({RANKED}) AS rank, arg_max(type, abs(z_score)) AS type, arg_max(value, abs(z_score)) AS value, arg_max(baseline, abs(z_score)) AS baseline, arg_max(z_score, abs(z_score)) AS z_score, list_sort(list(DISTINCT detected_by[2:-2])) AS det, count(*) AS k FROM si GROUP BY series_id, id),
ec AS (SELECT *, least(1.0, 0.2 * len(det)) AS conf FROM ev), ex AS (SELECT *, {UNRANKED.format(r='greatest(rank, CASE WHEN conf >= 0.8 THEN 3 WHEN conf >= 0.6 THEN 2 WHEN conf >= 0.4 THEN 1 ELSE 0 END)')} AS severity FROM ec)"""


_EVENT = f"SELECT series_id, type, severity, ts, end_ts, (end_ts - ts)::INT AS duration_sec, round(value, 6) AS value, round(baseline, 6) AS baseline, round(z_score, 6) AS z_score, round(conf::DOUBLE, 6) AS confidence, {text('det')} AS detected_by, NULL::VARCHAR AS instance, k || ' signals' AS detail FROM ex"
SQL["session_merge"] = f"WITH {_sessions(300)} {_EVENT}"
SQL["confident_events"] = f"WITH {_sessions(7200)} {_EVENT} WHERE conf >= 0.25 AND len(det) >= 2"
SQL["event_summary"] = f"WITH {_sessions(300)} SELECT series_id, severity, count(*) AS events FROM ex GROUP BY ALL"
SQL["anchored_merge"] = f"WITH {FOUND} " + _anchored("f")
SQL["dynamic_gap"] = f"WITH {FOUND}, gg AS (SELECT series_id, ts - lag(ts) OVER ({TIME}) AS g FROM f), v AS (SELECT series_id, list_sort(list(g)) AS v FROM gg WHERE g > 0 GROUP BY ALL) SELECT series_id, greatest(120, least(1800, greatest(240, least(1200, (v[(len(v) - 1) * 50 // 100 + 1] + v[(len(v) - 1) * 75 // 100 + 1]) // 2))))::BIGINT AS gap FROM v"
SQL["first_per_bucket"] = f"WITH {FOUND}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts // 7200 ORDER BY ts, detected_by) AS k FROM f) SELECT series_id, type, severity, ts, end_ts, duration_sec, round(value, 6) AS value, round(baseline, 6) AS baseline, round(z_score, 6) AS z_score, confidence, detected_by, instance, detail FROM b WHERE k = 1"

#: Events of hourly findings, table st: findings of one time are one, and events up to two steps apart that share a
#: detector and a family of types go on (wider windows never come to bear at this step).
STITCHED = f"""{FOUND}, mg AS (SELECT series_id, ts AS a, max(coalesce(end_ts, ts)) AS b, arg_max(f, abs(z_score)) AS top, list(DISTINCT type) AS types, list(DISTINCT detected_by[2:-2]) AS dets, max({RANKED}) AS rank, count(*) AS k FROM f GROUP BY series_id, ts), mi AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY a) AS i FROM mg),
fd(series_id, i, b, types, dets, g) AS (SELECT series_id, i, b, types, dets, 1 FROM mi WHERE i = 1 UNION ALL SELECT series_id, i, CASE WHEN go THEN greatest(b0, b) ELSE b END, CASE WHEN go THEN list_distinct(list_concat(t0, types)) ELSE types END, CASE WHEN go THEN list_distinct(list_concat(d0, dets)) ELSE dets END, g + (NOT go)::INT
FROM (SELECT m.series_id, m.i, m.b, m.types, m.dets, fd.b AS b0, fd.types AS t0, fd.dets AS d0, g, m.a - fd.b BETWEEN 0 AND 7200 AND len(list_intersect(fd.dets, m.dets)) > 0 AND len(list_intersect([CASE WHEN x LIKE '%QPS%' THEN 'LOAD' ELSE x END FOR x IN fd.types], [CASE WHEN x LIKE '%QPS%' THEN 'LOAD' ELSE x END FOR x IN m.types])) > 0 AS go FROM fd JOIN mi m ON m.series_id = fd.series_id AND m.i = fd.i + 1)),
sg AS (SELECT mi.series_id, g, min(a) AS ts, max(mi.b) AS end_ts, arg_max(top, abs(top.z_score)) AS top, list_sort(list_distinct(flatten(list(mi.types)))) AS types, list_sort(list_distinct(flatten(list(mi.dets)))) AS dets, max(rank) AS rank, sum(k) AS k FROM fd JOIN mi USING (series_id, i) GROUP BY mi.series_id, g),
st AS (SELECT series_id, CASE WHEN len(types) > 1 THEN 'QPS_SPIKE' ELSE top.type END AS type, {UNRANKED.format(r='rank')} AS severity, ts, end_ts, end_ts - ts + 3600 AS d, top.value AS value, top.baseline AS baseline, top.z_score AS z_score, dets, CASE WHEN k > 1 THEN 'Merged anomaly event (' || k || ' signals, ' || (end_ts - ts + 3600) || ' s)' ELSE top.detail END AS detail FROM sg)"""
SQL["stitched_events"] = f"WITH RECURSIVE {STITCHED} SELECT series_id, type, severity, ts, end_ts, d::INT AS duration_sec, round(value, 6) AS value, round(baseline, 6) AS baseline, round(z_score, 6) AS z_score, NULL::DOUBLE AS confidence, {text('dets')} AS detected_by, NULL::VARCHAR AS instance, detail FROM st"


def _window(name: str, points: str, a: str, b: str) -> str:
    """Statistics of the points in the window from a to b of each event."""
    floor = lambda p: f"v[(len(v) - 1) * {p} // 100 + 1]"
    return f"{name} AS (SELECT series_id, t0, len(v) AS n, {floor(50)} AS med, {floor(90)} AS p90, {floor(95)} AS p95, {floor(99)} AS p99, len(list_filter(v, lambda x: x = 0)) / len(v) AS zr FROM (SELECT e.series_id, t0, list_sort(list(x.value)) AS v FROM e JOIN {points} x ON x.series_id = e.series_id AND epoch(x.ts) BETWEEN {a} AND {b} GROUP BY e.series_id, t0))"


_z = lambda w, f: f"coalesce({w}.{f}, 0)"
EVIDENCE = (
    f"{STITCHED}, {L}, e AS (SELECT *, ts AS t0, end_ts AS t1, CASE WHEN end_ts > ts AND end_ts - ts < 21600 THEN greatest(3600, 3 * (end_ts - ts)) ELSE 21600 END AS len FROM st), "
    + ", ".join(_window(*x) for x in (("qb", "p", "t0 - 3600 - len", "t0 - 3600"), ("qe", "p", "t0", "t1"), ("gb", "p", "greatest(t0 - 3600 - len, t0 - 1800)", "t0 - 3600"), ("ge", "p", "t0", "least(t1, t0 + 1800)"), ("qp", "p", "t0 - 86400", "t1 - 86400"), ("lb", "l", "t0 - 3600 - len", "t0 - 3600"), ("le", "l", "t0", "t1"), ("lv", "l", "t0 - 86400", "t1 - 86400")))
    + f""", ev0 AS (SELECT e.series_id, e.t0, t1, d, {_z('qb', 'med')} < 1 AS quiet, CASE WHEN {_z('qb', 'med')} < 1 THEN {_z('qe', 'p95')} >= greatest(5, 3 * {_z('qb', 'p95')}) ELSE {_z('qe', 'p90')} > 1.25 * {_z('qb', 'p95')} AND {_z('qe', 'med')} - {_z('qb', 'med')} > greatest(0.2, 0.15 * {_z('qb', 'med')}) END AS q,
{_z('lb', 'n')} >= 3 AND {_z('le', 'n')} >= 3 AND {_z('le', 'p99')} > greatest(1, 2.5 * {_z('lb', 'p99')}) AND {_z('le', 'p90')} > greatest(0.2, 1.8 * {_z('lb', 'p90')}) AS l, {_z('le', 'n')} >= 6 AND {_z('le', 'p95')} > 1 AND {_z('le', 'p95')} > greatest(1, 1.3 * {_z('lb', 'p95')}) AS k,
({_z('qe', 'p95')} + 1e-9) / ({_z('qb', 'p95')} + 1e-9) AS amp, {_z('ge', 'n')} >= 3 AND {_z('gb', 'n')} >= 3 AND (({_z('ge', 'med')} + 1e-9) / ({_z('gb', 'med')} + 1e-9) >= 1.2 OR {_z('ge', 'med')} - {_z('gb', 'med')} > greatest(5, 0.2 * {_z('qb', 'med')})) AS ed,
{_z('qe', 'n')} AS nq, {_z('qe', 'zr')} AS zr, {_z('qe', 'p95')} AS e95, {_z('qb', 'p95')} AS b95, {_z('qe', 'med')} AS em, {_z('qb', 'med')} AS bm, {_z('qp', 'n')} AS np, CASE WHEN {_z('qp', 'p90')} <> 0 THEN {_z('qe', 'p90')} / {_z('qp', 'p90')} ELSE 0 END AS rq, CASE WHEN {_z('lv', 'p95')} <> 0 THEN {_z('le', 'p95')} / {_z('lv', 'p95')} ELSE 1 END AS rl
FROM e {' '.join(f'LEFT JOIN {w} ON {w}.series_id = e.series_id AND {w}.t0 = e.t0' for w in ('qb', 'qe', 'gb', 'ge', 'qp', 'lb', 'le', 'lv'))}),
ev1 AS (SELECT *, nq < 3 OR NOT (q OR l OR k) OR (d >= 10800 AND q AND NOT l AND NOT ed) OR (d >= 7200 AND q AND NOT l AND zr >= 0.6) OR (d >= 7200 AND q AND l) AS dropped FROM ev0),
ev2 AS (SELECT *, CASE WHEN dropped THEN NULL WHEN quiet AND e95 >= 5 THEN 'LOW_BASELINE_BURST' WHEN (k OR l) AND NOT q THEN 'LATENCY_ONLY_DEGRADATION' WHEN q AND l THEN 'LOAD_AND_LATENCY_COUPLED' WHEN q AND d <= 7200 AND e95 > 1.8 * b95 AND em > greatest(1.8 * bm, bm + 10) THEN 'SHORT_INTENSE_BURST' WHEN q AND amp >= 1.8 THEN 'MIXED_OR_UNCERTAIN' END AS reason FROM ev1),
ev3 AS (SELECT *, CASE reason WHEN 'LOW_BASELINE_BURST' THEN 0.55 WHEN 'LATENCY_ONLY_DEGRADATION' THEN CASE WHEN k THEN 0.68 ELSE 0.72 END WHEN 'LOAD_AND_LATENCY_COUPLED' THEN 0.74 WHEN 'SHORT_INTENSE_BURST' THEN 0.7 WHEN 'MIXED_OR_UNCERTAIN' THEN 0.56 END AS conf, reason = 'LOAD_AND_LATENCY_COUPLED' AND d >= 7200 AND np >= 3 AND rq BETWEEN 0.75 AND 1.35 AND rl BETWEEN 0.7 AND 1.5 AS again FROM ev2)"""
)
SQL["evidence"] = f"WITH RECURSIVE {EVIDENCE} SELECT series_id, t0 AS ts, t1 AS end_ts, q AS \"Q\", l AS \"L\", k AS \"K\", ed AS \"E\", reason, round(conf::DOUBLE, 6) AS confidence, reason IS NOT NULL AND NOT coalesce(again, false) AS keep FROM ev3"

# workload --------------------------------------------------------------------------------------------------------

CLASS = "CASE WHEN key IN ('Insert', 'Update') THEN 'DML' WHEN key = 'Select' THEN 'DQL' WHEN key IN ('Begin', 'Rollback') THEN 'TCL' ELSE 'Other' END"
OP = "CASE WHEN key IN ('Rollback') THEN 'transaction' ELSE 'other' END"
MIX = f"{K}, mx AS (SELECT series_id, key, sum(value) AS total, 100 * sum(value) / sum(sum(value)) OVER () AS percent FROM k GROUP BY ALL)"
COMPLEX = "cx AS (SELECT series_id, least(1.0, 2 * sum(CASE key WHEN 'Select' THEN 0.1 WHEN 'Insert' THEN 0.05 WHEN 'Update' THEN 0.1 ELSE 0 END * value) / sum(value)) AS complexity FROM k GROUP BY ALL)"
SQL["complexity"] = f"WITH {K}, {COMPLEX} SELECT series_id, round(complexity, 6) AS complexity FROM cx"
WORK = f"""{MIX}, {COMPLEX}, rw AS (SELECT series_id, sum(value) FILTER (WHERE key = 'Select') AS r, sum(value) FILTER (WHERE key IN ('Insert', 'Update')) AS w FROM k GROUP BY ALL), rq AS (SELECT series_id, r / (r + w) AS read_ratio, w / (r + w) AS write_ratio FROM rw),
mc AS (SELECT series_id, greatest(0, 1 - sum((percent / 100) ** 2) * count(*)) AS balance, coalesce(sum(percent) FILTER (WHERE {CLASS} = 'DML'), 0) / 100 AS dml, coalesce(sum(percent) FILTER (WHERE {CLASS} = 'DQL'), 0) / 100 AS dql, coalesce(sum(percent) FILTER (WHERE {CLASS} = 'TCL'), 0) / 100 AS tcl, arg_max(key, percent) AS top_op, max(percent) AS top_percent FROM mx GROUP BY ALL),
wp AS (SELECT series_id, read_ratio, write_ratio, read_ratio > 0.6 AS read_heavy, write_ratio > 0.3 OR (write_ratio > 2 * read_ratio AND read_ratio < 0.2) AS write_heavy, complexity, balance, 0.0::DOUBLE AS write_amplification, 0.0::DOUBLE AS "DDL", dml AS "DML", dql AS "DQL", tcl AS "TCL", 0.0::DOUBLE AS "Other", top_op, top_percent,
CASE WHEN write_ratio > 0.5 THEN 'write_intensive' WHEN read_ratio > 0.7 THEN 'read_intensive' WHEN complexity > 0.5 THEN 'complex_queries' WHEN balance > 0.7 THEN 'balanced' ELSE 'mixed' END AS pattern, CASE WHEN write_ratio > 0.4 THEN 'medium' ELSE 'low' END AS hotspot_risk,
CASE WHEN dml > 0.5 THEN 'write_intensive' WHEN dql > 0.7 THEN 'read_intensive' WHEN tcl > 0.3 THEN 'transactional' WHEN complexity > 0.3 THEN 'analytical' ELSE 'mixed' END AS category FROM rq JOIN cx USING (series_id) JOIN mc USING (series_id))"""
SQL["workload_profile"] = f'WITH {WORK} SELECT series_id, round(read_ratio, 6) AS read_ratio, round(write_ratio, 6) AS write_ratio, read_heavy, write_heavy, round(complexity, 6) AS complexity, round(balance, 6) AS balance, write_amplification, "DDL", round("DML", 6) AS "DML", round("DQL", 6) AS "DQL", round("TCL", 6) AS "TCL", "Other", top_op, round(top_percent, 6) AS top_percent, pattern, hotspot_risk, category FROM wp'

TOTALS = f"{C}, ct AS (SELECT series_id, key, greatest(0, arg_max(value, ts) - arg_min(value, ts)) AS count, (epoch(max(ts)) - epoch(min(ts)))::BIGINT AS span FROM c GROUP BY ALL), cp AS (SELECT *, 100 * count / sum(count) OVER () AS percent, count / span AS per_second, 3600 * (count / span) AS per_hour FROM ct), {KL}, lt AS (SELECT series_id, key, avg(value) * 1000 AS latency_mean, quantile_cont(value, 0.99) * 1000 AS latency_p99, stddev_pop(value) / avg(value) AS latency_cv FROM kl GROUP BY ALL)"
SQL["fingerprints"] = f"""WITH {TOTALS}, g AS (SELECT *, {CLASS} AS class, least(1.0, 0.3 * percent / 100 + 0.4 * least(1.0, latency_mean / 1000) + 0.3 * least(1.0, latency_p99 / 5000)) AS resource FROM cp JOIN lt USING (series_id, key))
SELECT series_id, key, span, count, round(percent, 6) AS percent, round(per_second, 6) AS per_second, round(per_hour, 6) AS per_hour, round(latency_mean, 6) AS latency_mean, round(latency_p99, 6) AS latency_p99, class, CASE WHEN key = 'Select' THEN 'interactive' ELSE 'transactional' END AS pattern, false AS has_join, false AS has_subquery, false AS has_group, round(resource, 6) AS resource, 0.1::DOUBLE AS complexity,
row_number() OVER (ORDER BY count DESC, key)::INT AS rank_count, row_number() OVER (ORDER BY resource DESC, key)::INT AS rank_resource, row_number() OVER (ORDER BY latency_p99 DESC, key)::INT AS rank_p99 FROM g"""
OPS = f"""{TOTALS}, mv AS (SELECT key, value - lag(value) OVER (PARTITION BY key ORDER BY ts) AS d, ntile(2) OVER (PARTITION BY key ORDER BY ts) AS half FROM c), mh AS (SELECT key, avg(d) FILTER (WHERE half = 1) AS a, avg(d) FILTER (WHERE half = 2) AS b FROM mv GROUP BY ALL),
op AS (SELECT cp.*, latency_mean, latency_p99, latency_cv, CASE WHEN (b - a) / a > 0.2 THEN 'increasing' WHEN (b - a) / a < -0.2 THEN 'decreasing' ELSE 'stable' END AS trend, {OP} AS category, least(1.0, 0.5 * percent / 100 + 0.5 * least(1.0, latency_mean / 500)) AS intensity, CASE WHEN latency_p99 > 1000 THEN 'latency' WHEN percent > 50 THEN 'volume' WHEN latency_cv > 1 THEN 'jitter' ELSE 'none' END AS bottleneck, row_number() OVER (ORDER BY percent + 10 * latency_cv DESC, key)::INT AS rank FROM cp JOIN lt USING (series_id, key) JOIN mh USING (key))"""
SQL["operations"] = f"WITH {OPS} SELECT series_id, key, span, count, round(percent, 6) AS percent, round(per_second, 6) AS per_second, round(per_hour, 6) AS per_hour, round(latency_mean, 6) AS latency_mean, round(latency_p99, 6) AS latency_p99, round(latency_cv, 6) AS latency_cv, trend, category, round(intensity, 6) AS intensity, bottleneck, rank FROM op"
SQL["op_categories"] = f"WITH {OPS} SELECT series_id, category, sum(count) AS count, round(sum(percent), 6) AS percent, round(avg(latency_mean), 6) AS latency_mean, round(max(latency_p99), 6) AS latency_p99 FROM op GROUP BY ALL"


def _volume(c: str) -> str:
    return f"""vd AS (SELECT series_id, key, ts, value - lag(value) OVER w AS v, epoch(ts) - lag(epoch(ts)) OVER w AS dt FROM {c} WINDOW w AS (PARTITION BY series_id, key ORDER BY ts)), vr AS (SELECT series_id, {OP} AS category, ts, key, v / dt AS rate FROM vd WHERE v > 0 AND dt > 0), vh AS (SELECT *, ntile(2) OVER (PARTITION BY series_id, category ORDER BY ts, key) AS half FROM vr),
vo AS (SELECT series_id, category, avg(rate) AS mean, quantile_cont(rate, 0.99) AS peak, (avg(rate) FILTER (WHERE half = 2) - avg(rate) FILTER (WHERE half = 1)) / avg(rate) FILTER (WHERE half = 1) AS ch FROM vh GROUP BY ALL)"""


SQL["volume"] = f"WITH {C}, {_volume('c')} SELECT series_id, category, round(mean, 6) AS mean, round(peak, 6) AS peak, CASE WHEN ch > 0.1 THEN 'increasing' WHEN ch < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend, CASE WHEN peak > 100000 THEN 'high' WHEN peak > 50000 THEN 'medium' ELSE 'low' END AS saturation FROM vo"

HEALTH = f"""{I}, {IL}, ir AS (SELECT series_id, instance, avg(value) AS mean, stddev_pop(value) / avg(value) AS cv FROM i GROUP BY ALL), ip AS (SELECT series_id, instance, quantile_cont(value, 0.99) * 1000 AS p99 FROM il GROUP BY ALL),
ih AS (SELECT ir.*, p99, mean / avg(mean) OVER () AS temperature, CASE WHEN p99 > 1000 THEN 0 WHEN p99 > 500 OR cv > 1 THEN 1 ELSE 2 END AS hl FROM ir JOIN ip USING (series_id, instance)),
ch AS (SELECT series_id, count(*) AS instances, avg((hl = 2)::INT) AS healthy, avg((hl = 1)::INT) AS degraded, greatest(0, least(100, 100 * avg((hl = 2)::INT) + 50 * avg((hl = 1)::INT) - 20 * stddev_pop(mean) / avg(mean))) AS score, sum((temperature > 1.5)::INT)::BIGINT AS hot, sum((temperature < 0.5)::INT)::BIGINT AS cold FROM ih GROUP BY ALL)"""
SQL["cluster_health"] = f"WITH {HEALTH} SELECT series_id, instances, round(healthy, 6) AS healthy, round(degraded, 6) AS degraded, round(score, 6) AS score, hot, cold FROM ch"

SQL["tails_by_kind"] = f"""WITH {K}, v AS (SELECT series_id || '/' || key AS series_id, value FROM k), q AS (SELECT series_id, quantile_cont(value, 0.95) AS a, quantile_cont(value, 0.99) AS b, quantile_cont(value, 0.999) AS c FROM v GROUP BY ALL), e AS (SELECT series_id, count(*) AS k, avg(value - a) AS m, var_pop(value - a) AS v FROM v JOIN q USING (series_id) WHERE value > a GROUP BY ALL),
x AS (SELECT *, CASE WHEN c > b AND b > a THEN log10((c - b) / (b - a)) ELSE 0 END AS ti, CASE WHEN k > 10 AND v > 0 THEN 0.5 * (m * m / v - 1) END AS shape FROM q LEFT JOIN e USING (series_id))
SELECT series_id, round(a, 6) AS p95, round(b, 6) AS p99, round(c, 6) AS p999, round(ti, 6) AS tail_index, CASE WHEN ti > 1 THEN 'heavy' WHEN ti > 0.5 THEN 'moderate' ELSE 'light' END AS tail, round(shape, 6) AS gpd_shape, round(m * (1 - shape), 6) AS gpd_scale FROM x"""

SQL["volatility_metrics"] = f"""WITH {N}, r AS (SELECT *, CASE WHEN pv <> 0 THEN value / pv - 1 WHEN pv IS NOT NULL THEN 0 END AS ret FROM (SELECT *, lag(value) OVER (ORDER BY i) AS pv, max(value) OVER w AS hi, min(value) OVER w AS lo FROM n WINDOW w AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))),
v AS (SELECT *, CASE WHEN lo > 0 AND i > 9 THEN ln(hi / lo) ** 2 / (4 * 0.6931471805599453) END AS pk, stddev_pop(ret) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rv FROM r), w AS (SELECT *, lead(rv) OVER (ORDER BY i) AS nx FROM v),
g AS (SELECT series_id, stddev_pop(ret) AS s, count(ret) AS n, sqrt(avg(pk)) AS parkinson, stddev_pop(rv) FILTER (WHERE i > 10) AS vv, covar_pop(ret, nx) AS c, stddev_pop(nx) AS sn FROM w GROUP BY series_id)
SELECT series_id, round(s * sqrt(n), 6) AS realised, round(parkinson, 6) AS parkinson, round(1.1 * s * sqrt(n), 6) AS garman_klass, round(vv, 6) AS vol_of_vol, round(vv / s, 6) AS vol_ratio, round(c / (s * sn), 6) AS leverage FROM g"""

SQL["spectrum"] = f"""WITH {N}, m AS (SELECT avg(value) AS m, (2 ** ceil(log2(count(*))))::BIGINT AS n2 FROM n), f AS (SELECT q.k, sum((value - m) * cos(2 * pi() * q.k * i / n2)) AS re, sum((value - m) * sin(2 * pi() * q.k * i / n2)) AS im, max(n2) AS n2 FROM n, m, range(0, 4097) q(k) WHERE q.k <= n2 // 2 GROUP BY q.k),
pw AS (SELECT k, n2, CASE WHEN k = 0 THEN 0 ELSE (re * re + im * im) / (n2 * n2) END AS p FROM f), pk AS (SELECT *, p > lag(p) OVER (ORDER BY k) AND p > lead(p) OVER (ORDER BY k) AS peak, sum(p) OVER () AS total FROM pw),
t AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS rank, n2 / k AS period FROM pk WHERE peak)
SELECT 'all' AS series_id, rank::INT AS rank, round(period, 6) AS period, round(p, 6) AS power, round(p / total, 6) AS share, CASE WHEN p / total < 0.1 THEN NULL WHEN period BETWEEN 23 AND 25 THEN 'daily' WHEN period BETWEEN 167 AND 169 THEN 'weekly' WHEN period BETWEEN 350 AND 380 THEN 'biweekly' WHEN period BETWEEN 700 AND 760 THEN 'monthly' END AS cycle FROM t WHERE rank <= 5"""

# the whole load profile and what stands on it ----------------------------------------------------------------------

#: One row each, of the planted hourly series p and the latency l.
PROFILE = f"""{N}, {L}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, median(value) AS m, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM p),
tr AS (SELECT value FROM p, q WHERE value BETWEEN a - 3 * (b - a) AND b + 3 * (b - a)), tv AS (SELECT value FROM tr WHERE 2 * (SELECT count(*) FROM tr) >= (SELECT count(*) FROM p) UNION ALL SELECT value FROM p WHERE 2 * (SELECT count(*) FROM tr) < (SELECT count(*) FROM p)),
q1 AS (SELECT min(value) AS qps_min, max(value) AS qps_max, avg(value) AS qps_mean, median(value) AS qps_median, stddev_pop(value) AS qps_std, quantile_cont(value, 0.1) AS qps_p10, quantile_cont(value, 0.9) AS qps_p90, quantile_cont(value, 0.99) AS qps_p99, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS qps_iqr, least(100, quantile_cont(value, 0.99) / avg(value)) AS qps_peak_to_avg, least(10, stddev_pop(value) / avg(value)) AS qps_cv FROM tv),
q2 AS (SELECT avg(((value - mu) / sd) ** 3) AS qps_skewness, avg(((value - mu) / sd) ** 4) - 3 AS qps_kurtosis, median(abs(value - m)) AS qps_mad, avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT) AS qps_outlier_ratio FROM p, q),
q3 AS (SELECT -sum(e * log2(e)) / log2(10) AS qps_entropy FROM (SELECT count(*) / (SELECT count(*) FROM p) AS e FROM p, q GROUP BY floor((value - lo) / (hi - lo) * 9))),
bh AS (SELECT hour(ts) AS h, avg(value) AS av, stddev_pop(value) AS sd, count(*) AS k FROM p GROUP BY ALL), bm AS (SELECT *, median(av) OVER () AS m, stddev_pop(av) OVER () AS s, avg(av) OVER () AS al FROM bh),
da AS (SELECT coalesce(list(h ORDER BY h) FILTER (WHERE av > greatest(m + 0.5 * s, 1.2 * m)), []) AS daily_peak_hours, coalesce(list(h ORDER BY h) FILTER (WHERE av < least(m - 0.5 * s, 0.8 * m)), []) AS daily_off_peak_hours, max(av) / min(av) AS daily_peak_to_off_peak, 1 - avg(av) FILTER (WHERE h >= 22 OR h <= 5) / avg(av) FILTER (WHERE h BETWEEN 6 AND 21) AS daily_night_drop, avg(av) FILTER (WHERE h BETWEEN 9 AND 17) / avg(av) FILTER (WHERE h NOT BETWEEN 9 AND 17) AS daily_business_ratio, greatest(0, 1 - coalesce(avg(sd / av) FILTER (WHERE k > 1 AND av > 0), 1)) AS daily_consistency, least(1, 2 * avg((av / al - 1) ** 2)) AS daily_periodicity FROM bm), d1 AS (SELECT *, greatest(0, least(1, (daily_peak_to_off_peak - 1) / 2)) AS daily_strength FROM da),
bd AS (SELECT dayofweek(ts) AS d, avg(value) AS av, stddev_pop(value) AS sd, count(*) AS k FROM p GROUP BY ALL), w0 AS (SELECT avg(av) FILTER (WHERE d BETWEEN 1 AND 5) AS weekly_weekday_avg, avg(av) FILTER (WHERE d IN (0, 6)) AS weekly_weekend_avg, coalesce(list(d ORDER BY d) FILTER (WHERE av > 1.2 * (SELECT avg(av) FROM bd)), []) AS weekly_heavy_days, greatest(0, 1 - coalesce(avg(sd / av) FILTER (WHERE k > 1 AND av > 0), 1)) AS weekly_consistency, (max(av) - min(av)) / avg(av) AS weekly_spread FROM bd), w1 AS (SELECT *, coalesce(1 - weekly_weekend_avg / weekly_weekday_avg, 0) AS weekly_weekend_drop, greatest(0, least(1, weekly_spread)) AS weekly_strength FROM w0),
bu AS (SELECT 0.25 * least(1, var_pop(value) / avg(value) ** 2) + 0.3 * least(1, (quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / median(value) / 3) + 0.25 * least(1, stddev_pop(rv) FILTER (WHERE i > 4) / avg(rv) FILTER (WHERE i > 4)) + 0.2 * avg((value > p90)::INT) AS burstiness FROM (SELECT *, var_pop(value) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv, quantile_cont(value, 0.9) OVER () AS p90 FROM n)),
se AS (SELECT 0.6 * least(1, 2 * (s2 - s1 * s1) / (s1 * s1)) + 0.4 * least(1, (hi - lo) / s1 / 3) AS seasonality FROM (SELECT sum(av) / 24 AS s1, sum(av * av) / 24 AS s2, max(av) AS hi, CASE WHEN count(*) < 24 THEN 0 ELSE min(av) END AS lo FROM bh)),
no AS (SELECT (least(1, avg(d) / avg(value)) + least(1, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / avg(value))) / 2 AS noise FROM (SELECT value, abs(value - lag(value) OVER (ORDER BY i)) AS d FROM n)),
ac AS (SELECT sum(v * a) / sum(v * v) AS acf_1, sum(v * b) / sum(v * v) AS acf_2, sum(v * c) / sum(v * v) AS acf_3 FROM (SELECT v, lag(v, 1) OVER (ORDER BY i) AS a, lag(v, 2) OVER (ORDER BY i) AS b, lag(v, 3) OVER (ORDER BY i) AS c FROM (SELECT i, value - mu AS v FROM n, q))), a1 AS (SELECT *, greatest(-1, least(1, 0.5 * acf_1 + 0.3 * acf_2 + 0.2 * acf_3)) AS autocorrelation FROM ac),
ts0 AS (SELECT regr_slope(value, i) AS trend_slope, regr_r2(value, i) AS trend_r2, count(*) AS trend_n, regr_slope(value, i) / avg(value) AS trend_relative_slope FROM n), t1 AS (SELECT *, 0.5 * least(1, abs(trend_relative_slope) * sqrt(trend_n) * 5) + 0.5 * trend_r2 AS trend_trend_strength FROM ts0),
cpx AS ({SQL['change_point_count'].replace('WITH ' + N + ', x AS', 'WITH x AS')}),
ol AS (SELECT list(value ORDER BY i) AS v, avg(value) FILTER (WHERE i >= n - 10) AS l10, avg(value) FILTER (WHERE i BETWEEN n - 20 AND n - 11) AS b10, regr_slope(value, i) FILTER (WHERE half = 1) AS outlook_slope_1, regr_slope(value, i) FILTER (WHERE half = 2) AS outlook_slope_2, regr_slope(value, i) / avg(value) AS rs, arg_max(value, i) AS last FROM (SELECT *, ntile(2) OVER (ORDER BY i) AS half FROM n)),
o1 AS (SELECT list_reduce(v, lambda a, x: 0.2 * x + 0.8 * a) AS outlook_fast, list_reduce(v, lambda a, x: 0.05 * x + 0.95 * a) AS outlook_slow, (l10 - b10) / b10 AS outlook_recent_change, outlook_slope_1, outlook_slope_2, last * (1 + rs * 24) AS outlook_forecast FROM ol), o2 AS (SELECT *, CASE WHEN (outlook_fast - outlook_slow) / outlook_slow > 0.05 THEN 'increasing' WHEN (outlook_fast - outlook_slow) / outlook_slow < -0.05 THEN 'decreasing' ELSE 'stable' END AS outlook_direction FROM o1),
mo AS (SELECT count(*) AS monthly_weeks, max(av) / min(av) AS monthly_peak_ratio, (max(av) - min(av)) / avg(av) AS monthly_strength, (max(av) - min(av)) / avg(av) > 0.15 AS monthly_monthly FROM (SELECT avg(value) AS av FROM n WHERE n >= 672 GROUP BY least((day(ts) - 1) // 7, 4)) HAVING count(*) >= 3),
la AS (SELECT 1000 * quantile_cont(value, 0.5) AS latency_p50, 1000 * quantile_cont(value, 0.9) AS latency_p90, 1000 * quantile_cont(value, 0.95) AS latency_p95, 1000 * quantile_cont(value, 0.99) AS latency_p99, 1000 * max(value) AS latency_max, 1000 * avg(value) AS latency_mean, 1000 * stddev_pop(value) AS latency_std, stddev_pop(value) / avg(value) AS latency_cv, 1000 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS latency_iqr FROM l), l1 AS (SELECT *, latency_p99 / latency_p50 AS latency_tail_ratio, (latency_p99 - latency_p50) / latency_p50 AS latency_tail_excess, latency_max / latency_mean AS latency_max_to_mean, 1 - least(1, latency_cv) AS latency_stability FROM la),
cb AS (SELECT p.ts, p.value AS x, l.value AS y, lead(l.value) OVER (ORDER BY p.ts) AS y1 FROM p JOIN l USING (ts)), cq AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(y, 0.25) AS c, quantile_cont(y, 0.75) AS d FROM cb),
cr AS (SELECT corr(x, y) FILTER (WHERE x BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AND y BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c)) AS cross_correlation, corr(x, y1) AS cross_lag1_correlation FROM cb, cq), c1 AS (SELECT *, CASE WHEN abs(cross_correlation) > 0.5 THEN 'high' WHEN abs(cross_correlation) > 0.3 THEN 'medium' ELSE 'low' END AS cross_sensitivity FROM cr),
pr AS (SELECT *, coalesce(monthly_strength, 0) AS ms, greatest(daily_strength, weekly_strength, coalesce(monthly_strength, 0)) AS topst FROM q1, q2, q3, d1, w1, bu, se, no, a1, t1, cpx, o2, l1, c1 LEFT JOIN mo ON true),
lp AS (SELECT * EXCLUDE (ms, topst), 0.5 * daily_strength + 0.3 * weekly_strength + 0.2 * ms AS periodicity, CASE WHEN topst < 0.1 THEN 'none' WHEN topst = daily_strength THEN 'daily' WHEN topst = weekly_strength THEN 'weekly' ELSE 'monthly' END AS dominant_period,
CASE WHEN qps_mean < 50 THEN 'very_low' WHEN qps_mean < 200 THEN 'low' WHEN qps_mean < 1000 THEN 'medium' WHEN qps_mean < 5000 THEN 'high' WHEN qps_mean < 20000 THEN 'very_high' ELSE 'extreme' END AS load_class,
CASE WHEN daily_peak_to_off_peak > 2 AND abs(weekly_weekend_drop) > 0.15 AND daily_business_ratio > 1.15 THEN 'business_traffic' WHEN daily_peak_to_off_peak > 1.4 AND weekly_strength > 0.15 THEN 'periodic_with_weekly_variation' WHEN daily_peak_to_off_peak > 1.4 THEN 'daily_periodic' WHEN qps_cv < 0.15 AND qps_peak_to_avg < 2 THEN 'constant' WHEN (qps_peak_to_avg > 4 OR burstiness > 0.4) AND qps_cv > 0.5 THEN 'highly_bursty' WHEN qps_peak_to_avg > 4 OR burstiness > 0.4 THEN 'bursty' WHEN seasonality > 0.3 AND daily_strength > 0.2 THEN 'multimodal' WHEN qps_cv > 0.5 THEN 'variable' ELSE 'mixed' END AS traffic_type,
CASE WHEN qps_cv < 0.1 THEN 2.0 WHEN qps_cv < 0.25 THEN 1.5 WHEN qps_cv < 0.45 THEN 1.0 WHEN qps_cv < 0.7 THEN 0.5 ELSE 0 END + CASE WHEN trend_trend_strength < 0.1 THEN 1.0 WHEN trend_trend_strength < 0.3 THEN 0.5 ELSE 0 END + CASE WHEN acf_1 > 0.7 THEN 0.5 ELSE 0 END + CASE WHEN change_points = 0 THEN 0.5 WHEN change_points > 3 THEN -0.5 ELSE 0 END + CASE WHEN daily_periodicity > 0.5 THEN 0.5 WHEN daily_periodicity > 0.3 THEN 0.25 ELSE 0 END AS steady,
0.3 * qps_mean / qps_max + 0.25 * (1 - least(1, qps_peak_to_avg / 10)) + 0.25 * (1 - least(1, qps_cv)) + CASE WHEN qps_cv < 0.3 THEN 0.2 ELSE 0.1 END AS efficiency, least(1, CASE WHEN qps_cv > 0.5 THEN 0.3 ELSE 0 END + CASE WHEN qps_outlier_ratio > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN latency_tail_ratio > 5 THEN 0.2 ELSE 0 END + CASE WHEN change_points > 3 THEN 0.2 ELSE 0 END) AS anomaly_score FROM pr)"""

_DOUBLES = """qps_min qps_max qps_mean qps_median qps_std qps_p10 qps_p90 qps_p99 qps_iqr qps_peak_to_avg qps_cv qps_skewness qps_kurtosis qps_mad qps_entropy qps_outlier_ratio daily_peak_to_off_peak daily_night_drop daily_business_ratio daily_consistency daily_periodicity daily_strength
weekly_weekday_avg weekly_weekend_avg weekly_consistency weekly_spread weekly_weekend_drop weekly_strength burstiness seasonality noise acf_1 acf_2 acf_3 autocorrelation trend_slope trend_r2 trend_relative_slope trend_trend_strength outlook_fast outlook_slow outlook_recent_change outlook_slope_1 outlook_slope_2 outlook_forecast
monthly_peak_ratio monthly_strength latency_p50 latency_p90 latency_p95 latency_p99 latency_max latency_mean latency_std latency_cv latency_iqr latency_tail_ratio latency_tail_excess latency_max_to_mean latency_stability cross_correlation cross_lag1_correlation periodicity efficiency anomaly_score""".split()
_STEADY = "CASE WHEN steady >= 3.5 THEN 'very_stable' WHEN steady >= 2.5 THEN 'stable' WHEN steady >= 1.5 THEN 'moderate' WHEN steady >= 0.5 THEN 'variable' ELSE 'highly_variable' END AS stability"
_SHOWN = ", ".join([f"round({x}::DOUBLE, 6) AS {x}" for x in _DOUBLES] + [f"{text(x)} AS {x}" for x in ("daily_peak_hours", "daily_off_peak_hours", "weekly_heavy_days")]) + f", trend_n, change_points, outlook_direction, monthly_weeks, monthly_monthly, cross_sensitivity, dominant_period, load_class, traffic_type, {_STEADY}"
SQL["load_profile"] = f"WITH {PROFILE} SELECT 'all' AS series_id, {_SHOWN} FROM lp"

_RISK = "CASE WHEN skew > 0.5 THEN 'high' WHEN skew > 0.3 THEN 'medium' ELSE 'low' END"
_RULES = [
    ("latency_p99 > 500", "look into tail latency"), ("imbalance > 0.3", "rebalance instances"), ("hotspot > 0.7", "spread the dominant statement"), ("volume_peak > 50000", "add storage capacity"),
    ("false", "batch writes"), ("qps_cv > 0.5", "smooth load peaks"), ("bottleneck <> 'none'", "remove the dominant bottleneck"),
]
#: The six dimensions: table dm.
DIMENSIONS = f"""{PROFILE}, {SKEW}, {WORK}, {_volume('k')}, {HEALTH.replace(I + ', ', '')}, vm AS (SELECT max(peak) AS volume_peak, sum(mean) AS volume_mean, coalesce(sum(mean) FILTER (WHERE category = 'transaction'), 0) / sum(mean) AS volume_transactions FROM vo), ho AS (SELECT max(percent) / 100 AS hotspot, list(key ORDER BY percent DESC, key)[1:3] AS dominant FROM mx),
jd AS (SELECT lp.*, skew AS imbalance, {_RISK} AS balance_risk, hot, cold, wp.* EXCLUDE (series_id), volume_peak, volume_mean, volume_transactions, CASE WHEN volume_peak / volume_mean > 3 THEN 0.3 ELSE 0 END + CASE WHEN NOT read_ratio / write_ratio BETWEEN 0.5 AND 10 THEN 0.2 ELSE 0 END + CASE WHEN volume_transactions > 0.5 THEN 0.3 ELSE 0 END AS volume_score, hotspot, dominant, score AS instance_score FROM lp, (SELECT skew, sk.hot, sk.cold FROM sk) s0, wp, vm, ho, (SELECT score FROM ch) h0),
bn AS (SELECT list({{'o': -s, 'n': name}} ORDER BY s DESC, name) AS b FROM (SELECT unnest([{{'n': 'latency', 's': (latency_tail_ratio / 10)::DOUBLE}}, {{'n': 'balance', 's': imbalance::DOUBLE}}, {{'n': 'sql_hotspot', 's': hotspot::DOUBLE}}, {{'n': 'load_burst', 's': (qps_peak_to_avg / 10)::DOUBLE}}, {{'n': 'volume', 's': volume_score::DOUBLE}}]) AS x, x['n'] AS name, x['s'] AS s FROM jd)),
j1 AS (SELECT jd.*, CASE WHEN volume_peak > 100000 THEN 'high' WHEN volume_peak > 50000 THEN 'medium' ELSE 'low' END AS saturation_risk, CASE WHEN -b[1]['o'] >= 0.3 THEN b[1]['n'] ELSE 'none' END AS bottleneck, CASE WHEN -b[2]['o'] >= 0.2 THEN b[2]['n'] ELSE 'none' END AS second_bottleneck FROM jd, bn),
j2 AS (SELECT *, greatest(0, least(100, 100 - (CASE WHEN latency_p99 > 500 THEN 15 WHEN latency_p99 > 200 THEN 8 ELSE 0 END + CASE WHEN latency_tail_ratio > 10 THEN 10 WHEN latency_tail_ratio > 5 THEN 5 ELSE 0 END + CASE WHEN imbalance > 0.5 THEN 12 WHEN imbalance > 0.3 THEN 6 ELSE 0 END + CASE WHEN qps_cv > 0.8 THEN 8 WHEN qps_cv > 0.5 THEN 4 ELSE 0 END + CASE WHEN bottleneck <> 'none' THEN 8 ELSE 0 END + CASE saturation_risk WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 0 END + CASE WHEN hotspot > 0.7 THEN 8 ELSE 0 END) + CASE WHEN abs(cross_correlation) > 0.6 THEN 5 ELSE 0 END))::DOUBLE AS health, greatest(0.1, least(0.95, 1 - qps_cv - 0.5 * burstiness)) AS forecast_confidence FROM j1),
dm AS (SELECT *, CASE WHEN health >= 80 THEN 'low' WHEN health >= 60 THEN 'medium' WHEN health >= 40 THEN 'high' ELSE 'critical' END AS risk, CASE WHEN health < 50 THEN 'high' WHEN health < 70 OR change_points > 3 THEN 'medium' ELSE 'low' END AS degradation_risk,
CASE WHEN daily_strength > 0.5 AND weekly_strength > 0.2 THEN 'multi_periodic' WHEN daily_strength > 0.5 THEN 'daily_periodic' WHEN burstiness > 0.5 THEN 'bursty' WHEN qps_cv < 0.2 THEN 'stable' ELSE 'variable' END AS qps_pattern, CASE WHEN qps_peak_to_avg > 10 THEN 'extreme_peaks' WHEN qps_cv > 1 THEN 'highly_variable' WHEN qps_max > 50000 THEN 'high_volume' WHEN qps_peak_to_avg > 5 THEN 'peaky' ELSE 'normal' END AS critical_load,
(list_filter([{', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _RULES)}], lambda x: x IS NOT NULL))[1:5] AS recommendations FROM j2)"""
_WORK_DOUBLES = "imbalance read_ratio write_ratio complexity balance write_amplification top_percent volume_peak volume_mean volume_transactions volume_score hotspot instance_score health forecast_confidence".split()
SQL["six_dimensions"] = f"""WITH {DIMENSIONS} SELECT 'all' AS series_id, {_SHOWN}, {', '.join(f'round({x}::DOUBLE, 6) AS {x}' for x in _WORK_DOUBLES)}, round("DDL", 6) AS "DDL", round("DML", 6) AS "DML", round("DQL", 6) AS "DQL", round("TCL", 6) AS "TCL", round("Other", 6) AS "Other", {', '.join(f'{text(x)} AS {x}' for x in ('hot', 'cold', 'dominant', 'recommendations'))},
balance_risk, read_heavy, write_heavy, top_op, pattern, hotspot_risk, category, saturation_risk, bottleneck, second_bottleneck, risk, degradation_risk, qps_pattern, critical_load FROM dm"""
_METRICS = ("qps_mean", "qps_cv", "latency_p99", "latency_tail_ratio", "imbalance", "hotspot", "burstiness")
SQL["similarity"] = f"WITH {DIMENSIONS}, v AS (SELECT unnest([{', '.join(f'{{' + repr('m') + f': {chr(39)}{x}{chr(39)}, ' + repr('v') + f': {x}' + '}' for x in _METRICS)}]) AS x FROM dm) SELECT 'all' AS series_id, a.x['m'] AS metric_a, b.x['m'] AS metric_b, round(CASE WHEN a.x['v'] = 0 AND b.x['v'] = 0 THEN 1 WHEN a.x['v'] = 0 OR b.x['v'] = 0 THEN 0 ELSE least(a.x['v'], b.x['v']) / greatest(a.x['v'], b.x['v']) END, 6) AS similarity FROM v a, v b"
SQL["alerts"] = f"""WITH {DIMENSIONS}, t AS (SELECT 'qps' AS metric, qps_mean AS current, qps_mean + 2 * (1 + 0.5 * burstiness) * qps_std AS warning, qps_mean + 3 * (1 + 0.5 * burstiness) * qps_std AS critical FROM dm UNION ALL SELECT 'latency', latency_p99, latency_mean + 2 * latency_std, latency_mean + 3 * latency_std FROM dm UNION ALL SELECT 'balance', imbalance, 0.3, 0.6 FROM dm UNION ALL SELECT 'hotspot', hotspot, 0.5, 0.7 FROM dm UNION ALL SELECT 'tail', latency_tail_ratio, 5.0, 10.0 FROM dm),
s AS (SELECT *, CASE WHEN current >= critical THEN 'firing' WHEN current >= warning THEN 'warning' ELSE 'ok' END AS state FROM t), f AS (SELECT *, least(1, 0.2 * sum((state = 'firing')::INT) OVER ()) AS fatigue FROM s)
SELECT 'all' AS series_id, metric, round(current, 6) AS current, round(warning, 6) AS warning, round(critical, 6) AS critical, state, round(fatigue::DOUBLE, 6) AS fatigue, round((0.3 * CASE state WHEN 'firing' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END + 0.4 * least(1, current / critical) + 0.3 * CASE state WHEN 'firing' THEN 1 WHEN 'warning' THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS priority, fatigue >= 0.8 AND state <> 'firing' AS suppressed FROM f"""
SQL["monitor"] = f"""WITH {DIMENSIONS} SELECT 'all' AS series_id, CASE WHEN health >= 80 THEN 'healthy' WHEN health >= 60 THEN 'degraded' ELSE 'critical' END AS status, round(greatest(0, least(100, health - 20 * greatest(0, outlook_recent_change))), 6) AS predicted_health, round(greatest(0, least(1, 0.5 + 0.5 * forecast_confidence)), 6) AS confidence, bottleneck AS root_cause, round(1.2 * qps_max / qps_mean, 6) AS capacity_factor, outlook_forecast > 0.8 * qps_max AS capacity_alert, {text('recommendations')} AS recommendations FROM dm"""

# insight -----------------------------------------------------------------------------------------------------------

SQL["latency_dimension"] = f"""WITH {L}, v AS (SELECT ts, value * 1000 AS v, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM l), w AS (SELECT *, CASE WHEN i % 25 = 0 AND i <= n - 50 THEN quantile_cont(v, 0.99) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS w99 FROM v), q AS (SELECT median(v) AS a, quantile_cont(v, 0.99) AS b, avg(v) AS mu, stddev_pop(v) AS sd FROM v),
g AS (SELECT count(*) AS n, sum((v > 1.5 * b)::INT) AS spikes, any_value(sd) / any_value(mu) AS cv, avg(((v - mu) / sd) ** 4) - 3 AS kurt, avg(v) FILTER (WHERE i < n // 2) AS fa, avg(v) FILTER (WHERE i >= n // 2) AS fb, stddev_pop(w99) / avg(w99) AS c99, count(w99) AS k99, any_value(b) / any_value(a) AS tail FROM w, q),
h AS (SELECT hour(ts) AS h, avg(v) AS v FROM v GROUP BY ALL), hh AS (SELECT avg(v) FILTER (WHERE h BETWEEN 9 AND 17) AS business, avg(v) FILTER (WHERE h >= 22 OR h <= 5) AS off, stddev_pop(v) / avg(v) AS hcv, count(*) AS hours FROM h)
SELECT 'all' AS series_id, round(business, 6) AS business_ms, round(off, 6) AS off_peak_ms, spikes::BIGINT AS spikes, CASE WHEN spikes = 0 THEN 'none' WHEN spikes > 20 AND cv > 0.5 THEN 'frequent_bursty' WHEN spikes > 10 THEN 'periodic' ELSE 'occasional' END AS spike_pattern, hours >= 12 AND hcv > 0.3 AS periodic, CASE WHEN n < 20 THEN 'unknown' WHEN (fb - fa) / fa > 0.2 THEN 'increasing' WHEN (fb - fa) / fa < -0.2 THEN 'decreasing' ELSE 'stable' END AS trend,
round(CASE WHEN n >= 100 AND k99 >= 2 THEN greatest(0, 1 - c99) ELSE 1 END, 6) AS p99_stability, CASE WHEN tail > 10 OR kurt > 10 THEN 'severe' WHEN tail > 5 OR kurt > 5 THEN 'moderate' WHEN tail > 3 OR kurt > 3 THEN 'mild' ELSE 'normal' END AS long_tail FROM g, hh"""

LAGGED = f"""{P}, {L}, b AS (SELECT row_number() OVER (ORDER BY p.ts) AS i, p.value AS x, l.value AS y FROM p JOIN l USING (ts)), lc AS (SELECT k::INT AS lag, corr(a.x, b.y) AS c, count(*) AS n FROM b a, b, range(-6, 7) t(k) WHERE a.i + k = b.i GROUP BY k),
ls AS (SELECT lag, c, n, CASE WHEN n < 10 THEN 0.3 * c ELSE least(0.99, 1 - 1 / (1 + abs(c * sqrt((n - 2) / (1 - c * c + 0.001))) / 10)) END AS sg FROM lc)"""
SQL["lagged_correlations"] = f"WITH {LAGGED} SELECT 'all' AS series_id, lag, round(c, 6) AS correlation, n, round(sg, 6) AS significance FROM ls"
SQL["causality"] = f"WITH {LAGGED} SELECT 'all' AS series_id, 'qps' AS cause, 'latency' AS effect, lag, round(c, 6) AS correlation, round(sg, 6) AS significance, CASE WHEN lag > 0 THEN 'qps_leads' WHEN lag < 0 THEN 'latency_leads' ELSE 'together' END AS direction, abs(c) > 0.3 AND lag >= 0 AS causal FROM ls ORDER BY abs(c) DESC, abs(lag), lag LIMIT 1"
SQL["dimension_links"] = f"""
    WITH {DIMENSIONS}, {KL},
    ks AS (SELECT key, quantile_cont(value, 0.99) * 1000 AS p99, avg(value) AS mean FROM kl GROUP BY ALL),
    sl AS (SELECT sum(CASE WHEN p99 > 0.8 * latency_p99 THEN percent ELSE 0 END) / 100 AS sql FROM mx JOIN ks USING (key), dm),
    st AS (SELECT (SELECT avg(mean) FROM ks) / (SELECT avg(value) FROM kl) AS storage),
    sp AS (SELECT sum((value > 1.5 * p99)::INT) AS spikes FROM l, (SELECT quantile_cont(value, 0.99) AS p99 FROM l))
    SELECT 'all' AS series_id, round(least(1, sql)::DOUBLE, 6) AS sql, round(least(1, storage)::DOUBLE, 6) AS storage,
           round((CASE WHEN qps_cv > 0.5 AND latency_cv > 0.5 THEN 0.7 WHEN burstiness > 0.5 AND spikes > 5 THEN 0.6 ELSE 0.5 * qps_cv END)::DOUBLE, 6) AS load,
           round((CASE WHEN volume_peak / volume_mean > 3 AND latency_tail_ratio > 5 THEN 0.7 ELSE volume_peak / volume_mean / 10 END)::DOUBLE, 6) AS volume,
           round(imbalance, 6) AS balance
    FROM dm, sl, st, sp
"""
SQL["propagation"] = f"""WITH {DIMENSIONS}, s AS (SELECT 'qps_burst' AS source, burstiness AS score, CASE WHEN burstiness > 0.4 AND latency_tail_ratio > 3 THEN 'qps_burst > storage_bottleneck > latency_spike' END AS chain, cross_correlation AS c FROM dm UNION ALL SELECT 'latency_spike', latency_tail_ratio / 10, NULL, cross_correlation FROM dm UNION ALL SELECT 'load_imbalance', imbalance, CASE WHEN imbalance > 0.3 THEN 'load_imbalance > hot_instance > latency_spike' END, cross_correlation FROM dm UNION ALL SELECT 'storage_bottleneck', volume_score, NULL, cross_correlation FROM dm UNION ALL SELECT 'sql_hotspot', hotspot, NULL, cross_correlation FROM dm)
SELECT 'all' AS series_id, source, round(score, 6) AS score, score > 0.3 AS is_source, round(((1 + 0.5 * score) * CASE WHEN c > 0.5 THEN 1.2 ELSE 1 END)::DOUBLE, 6) AS amplification, chain FROM s WHERE score > 0.2"""
_ADVICE = [("latency_mean > 100", "optimise for latency"), ("count > 1000 AND complexity > 0.5", "cache or materialise"), ("class = 'DDL' AND percent > 1", "move schema changes out of peak hours"), ("resource > 0.3", "spread its resource use")]
SQL["sql_advice"] = f"WITH f AS ({SQL['fingerprints']}) SELECT series_id, key, {text('list_filter([' + ', '.join(f'CASE WHEN {c} THEN {t!r} END' for c, t in _ADVICE) + '], lambda x: x IS NOT NULL)')} AS recommendations FROM f"
SQL["instance_findings"] = f"""WITH {I}, {IL}, x AS (SELECT *, ntile(2) OVER (PARTITION BY instance ORDER BY ts) AS half FROM i), r AS (SELECT instance, avg(value) AS mean, stddev_pop(value) / avg(value) AS cv, avg(value) FILTER (WHERE half = 1) AS a, avg(value) FILTER (WHERE half = 2) AS b FROM x GROUP BY ALL), y AS (SELECT instance, value, avg(value) OVER (PARTITION BY instance) AS m FROM il), z AS (SELECT instance, quantile_cont(value, 0.99) * 1000 AS p99, sum((value > 2 * m)::INT)::BIGINT AS spikes FROM y GROUP BY ALL),
f AS (SELECT instance, cv, spikes, (b - a) / a AS ch, mean / avg(mean) OVER () AS t, p99 FROM r JOIN z USING (instance)), k AS (SELECT *, CASE WHEN p99 > 1000 THEN 'latency' WHEN t > 1.5 THEN 'hot' WHEN cv > 1 THEN 'unsteady' WHEN spikes > 10 THEN 'spikes' WHEN t < 0.5 THEN 'cold' ELSE 'none' END AS finding FROM f)
SELECT 'all' AS series_id, instance, finding, CASE finding WHEN 'latency' THEN 'look into its storage and network' WHEN 'hot' THEN 'move load away' WHEN 'unsteady' THEN 'look for bursts of a single client' WHEN 'spikes' THEN 'look for bursts of a single client' WHEN 'cold' THEN 'give it more load' ELSE 'keep' END AS recommendation, CASE WHEN ch > 0.15 THEN 'increasing' WHEN ch < -0.15 THEN 'decreasing' ELSE 'stable' END AS trend, spikes AS latency_spikes FROM k"""
NODES = f"""{I}, {IL}, cu AS (SELECT instance, avg(v) AS cpu FROM (SELECT {INSTANCE} AS instance, date_trunc('day', ts) AS ts, sum(value) / 1000 AS v FROM events GROUP BY ALL) WHERE v > 0.1 GROUP BY ALL), nq AS (SELECT series_id, instance, avg(value) AS qps, max(value) AS peak FROM i WHERE contains(instance, 'sql') GROUP BY ALL), nl AS (SELECT instance, median(value) * 1000 AS p50, quantile_cont(value, 0.99) * 1000 AS p99 FROM il GROUP BY ALL),
nr AS (SELECT *, cpu / 8 AS u, 1000 * cpu / qps AS ck FROM nq LEFT JOIN nl USING (instance) LEFT JOIN cu USING (instance))"""
SQL["node_report"] = f"WITH {NODES} SELECT series_id, instance, round(qps, 6) AS qps, peak AS peak_qps, round(p50, 6) AS p50_ms, round(p99, 6) AS p99_ms, round(cpu, 6) AS cpu, round(u, 6) AS utilisation, CASE WHEN u IS NULL THEN 'unknown' WHEN u < 0.3 THEN 'over_provisioned' WHEN u < 0.5 THEN 'comfortable' WHEN u < 0.7 THEN 'balanced' ELSE 'tight' END AS cost, round(ck, 6) AS cpu_per_kqps, coalesce(ck > 1.15 * avg(ck) OVER (), false) AS cpu_outlier FROM nr"
SQL["node_balance"] = f"WITH {NODES}, b AS (SELECT series_id, count(*) AS nodes, stddev_pop(qps) / avg(qps) AS q, stddev_pop(cpu) / avg(cpu) AS c FROM nr GROUP BY ALL) SELECT series_id, nodes, round(q, 6) AS qps_cv, round(c, 6) AS cpu_cv, CASE WHEN q < 0.1 THEN 'balanced' WHEN q < 0.2 THEN 'slightly_uneven' ELSE 'uneven' END AS balance FROM b"
SQL["fetch_order"] = "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_cache, row_number() OVER (ORDER BY c_custkey IN (SELECT o_custkey FROM orders), c_custkey)::INT AS rank FROM customer"
SQL["resumed"] = "WITH g AS (SELECT user_id, ts, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, floor(epoch(ts))::BIGINT AS ts, gap FROM g WHERE gap > 86400"
_FIRST = "SELECT user_id FROM events WHERE event_type = "
SQL["common_users"] = f"{_FIRST} 'purchase' INTERSECT {_FIRST} 'error'"
SQL["missing_users"] = f"{_FIRST} 'purchase' EXCEPT {_FIRST} 'error'"
_VALID = f"""{BY_TYPE}, g AS (SELECT series_id, count(*) AS samples, (floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600 AS hours, avg(value) AS mean, stddev_pop(value) / avg(value) AS cv FROM h GROUP BY ALL), bq AS ({SQL['burstiness'].replace('WITH ' + BY_TYPE + ', r AS', 'WITH r AS').replace('round(', '(').replace(', 6) AS burstiness', ') AS burstiness')}),
hs AS (SELECT series_id, hour(ts) AS hr, avg(value) AS v FROM h GROUP BY ALL), sx AS (SELECT series_id, sum(v) / 24 AS mu, sum(v * v) / 24 AS q, max(v) AS hi, CASE WHEN count(*) < 24 THEN 0 ELSE min(v) END AS lo FROM hs GROUP BY ALL), sq AS (SELECT series_id, 0.6 * least(1, 2 * (q - mu * mu) / (mu * mu)) + 0.4 * least(1, (hi - lo) / mu / 3) AS seasonality FROM sx),
va AS (SELECT *, CASE WHEN mean < 50 THEN 'very_low' WHEN mean < 200 THEN 'low' WHEN mean < 1000 THEN 'medium' WHEN mean < 5000 THEN 'high' WHEN mean < 20000 THEN 'very_high' ELSE 'extreme' END AS load_class, CASE WHEN cv < 0.2 THEN 'low' WHEN cv < 0.5 THEN 'medium' WHEN cv < 1 THEN 'high' ELSE 'extreme' END AS cv_class, CASE WHEN burstiness < 0.2 THEN 'low' WHEN burstiness < 0.5 THEN 'medium' WHEN burstiness < 1 THEN 'high' ELSE 'extreme' END AS burst_class, cv >= 0 AND burstiness BETWEEN 0 AND 1 AND seasonality BETWEEN 0 AND 1 AS valid FROM g JOIN bq USING (series_id) JOIN sq USING (series_id) WHERE samples >= 50 AND hours >= 24)"""
SQL["validation"] = f"WITH {_VALID} SELECT series_id, samples, round(hours, 6) AS hours, round(mean, 6) AS mean, round(cv, 6) AS cv, round(burstiness, 6) AS burstiness, round(seasonality, 6) AS seasonality, load_class, cv_class, burst_class, valid FROM va"
SQL["class_distribution"] = f"WITH {_VALID}, u AS (SELECT 'load_class' AS field, load_class AS class, valid FROM va UNION ALL SELECT 'cv_class', cv_class, valid FROM va UNION ALL SELECT 'burst_class', burst_class, valid FROM va) SELECT field, class, count(*) AS series, sum((NOT valid)::INT)::BIGINT AS invalid FROM u GROUP BY ALL"

# sources, sinks and streams on the event table -----------------------------------------------------------------------

_TEXT = f"m AS (SELECT 'requests_total' AS metric, {KIND} AS kind, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
SQL["text_round_trip"] = f"WITH {_TEXT} SELECT metric, kind, 'a\"b,c' AS note, {SEC.format(x='ts')} AS ts, value FROM m WHERE epoch(ts) >= 1704153600 AND epoch(ts) <= 1705276800"
SQL["summed_text"] = f"WITH {_TEXT} SELECT metric, {SEC.format(x='ts')} AS ts, sum(value) AS value FROM m GROUP BY ALL"
SQL["csv_round_trip"] = f"WITH {_TEXT}, k AS (SELECT kind, row_number() OVER (ORDER BY 'kind=\"' || kind || '\"')::BIGINT AS id FROM (SELECT DISTINCT kind FROM m)) SELECT id, kind, {SEC.format(x='ts')} AS ts, value FROM m JOIN k USING (kind)"
SQL["histogram_text"] = f"WITH m AS (SELECT date_trunc('day', ts) AS ts, count(*) FILTER (WHERE value <= 10)::DOUBLE AS a, count(*) FILTER (WHERE value <= 100)::DOUBLE AS b, count(*)::DOUBLE AS c FROM events GROUP BY ALL) SELECT 'latency_bucket' AS metric, {SEC.format(x='ts')} AS ts, le, cum FROM (SELECT ts, 10.0::DOUBLE AS le, a AS cum FROM m UNION ALL SELECT ts, 100.0, b FROM m)"
SQL["response_rows"] = f"WITH m AS (SELECT {KIND} AS kind, date_trunc('day', ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY ALL) SELECT 'up' AS metric, kind, {SEC.format(x='ts')} AS ts, value FROM m"
SQL["last_written"] = "SELECT user_id, floor(epoch(max(ts)))::BIGINT AS ts, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY ALL"
SQL["file_ranges"] = """
    WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events)
    SELECT event_type || '_' || strftime(hour, '%Y-%m-%d_%H-%M-%S') || '_' || strftime(hour + INTERVAL 3599 SECOND, '%Y-%m-%d_%H-%M-%S') || '.prom' AS file,
           epoch(hour)::BIGINT AS start_ts, epoch(hour)::BIGINT + 3599 AS end_ts, hour = (SELECT date_trunc('hour', max(ts)) FROM events) AS newest
    FROM h
"""
SQL["metric_types"] = """
    WITH v AS (SELECT event_type || ['_bucket', '_total', '_count', '_sum', '_queue', '_Latency_ms', '_duration'][user_id % 7 + 1] AS name, count(*) AS n FROM events GROUP BY 1)
    SELECT name, n, CASE WHEN name LIKE '%#_bucket' ESCAPE '#' THEN 'histogram' WHEN regexp_matches(name, '(_total|_count|_sum)$') THEN 'counter' ELSE 'gauge' END AS kind,
           lower(name) LIKE '%#_bucket' ESCAPE '#' OR lower(name) LIKE '%latency%' OR lower(name) LIKE '%duration%' AS bucket
    FROM v
"""
SQL["tumbling_windows"] = "SELECT event_type AS series_id, epoch(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start_ts, epoch(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'))::BIGINT + 1800 AS end_ts, round(avg(value), 6) AS mean, round(max(value), 6) AS max, count(*) AS n FROM events GROUP BY ALL"
SQL["sliding_windows"] = "SELECT event_type AS series_id, s AS start_ts, s + 7200 AS end_ts, round(avg(value), 6) AS mean, round(max(value), 6) AS max, count(*) AS n FROM (SELECT event_type, value, unnest([floor(epoch(ts) / 3600)::BIGINT * 3600, floor(epoch(ts) / 3600)::BIGINT * 3600 - 3600]) AS s FROM events) GROUP BY ALL"
SQL["session_windows"] = "WITH e AS (SELECT event_type, ts, value, coalesce((ts >= lag(ts) OVER w + INTERVAL 30 MINUTE)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT event_type AS series_id, floor(epoch(min(ts)))::BIGINT AS start_ts, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS end_ts, count(*) AS k, round(max(value), 6) AS value FROM g GROUP BY event_type, g"

# more of rates, imbalance and correlation ----------------------------------------------------------------------------

SQL["counter_rate_gap"] = f"WITH {C}, d AS (SELECT *, lag(value) OVER w AS v0, lag(ts) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY key ORDER BY ts)) SELECT series_id, key, {SEC.format(x='ts')} AS ts, round(CASE WHEN value < v0 THEN value ELSE value - v0 END / (epoch(ts) - epoch(t0)), 6) AS value FROM d WHERE t0 IS NOT NULL AND epoch(ts) - epoch(t0) <= 3600"
SQL["window_correlation"] = f"WITH {P}, {L}, w AS (SELECT k AS id, 1704067200 + k * 86400 AS a, 1704067200 + k * 86400 + 90000 AS b FROM range(0, 29) t(k)) SELECT 'all' AS series_id, id, round(CASE WHEN count(*) >= 3 THEN corr(p.value, l.value) END, 6) AS corr FROM w JOIN p ON epoch(p.ts) BETWEEN a AND b JOIN l USING (ts) GROUP BY id"
_CATEGORY = "CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END"


def _imbalance(values: str, floor: str, least: float, high: float, critical: float | None, scale: float, type_: str) -> str:
    grade = f"CASE WHEN abs(value / b - 1) > {critical} THEN 'CRITICAL' WHEN abs(value / b - 1) > {high} THEN 'HIGH' ELSE 'MEDIUM' END" if critical else f"CASE WHEN abs(value / b - 1) > {high} THEN 'HIGH' ELSE 'MEDIUM' END"
    return f"WITH v AS ({values}), g AS (SELECT series_id, instance, avg(value) AS value, count(*) AS n, min(ts) AS ts, max(ts) AS last FROM v GROUP BY ALL), x AS (SELECT *, avg(value) OVER ({WHOLE}) AS b, count(*) OVER ({WHOLE}) AS k FROM g WHERE n >= 10 AND value >= {floor}) " + rows("x", f"k >= 2 AND abs(value / b - 1) >= {least}", "Imbalance", repr(type_), grade, f"b * {scale}", "value / b - 1", f"value * {scale}", end="last", instance="instance")


SQL["load_imbalance"] = _imbalance(f"SELECT 'all/' || {_CATEGORY} AS series_id, {INSTANCE} AS instance, date_trunc('day', ts) AS ts, count(*)::DOUBLE * CASE WHEN user_id % 9 = 7 THEN 6 ELSE 1 END AS value FROM events GROUP BY {_CATEGORY}, user_id % 9, date_trunc('day', ts)", "10", 0.5, 0.7, 1.0, 1.0, "LOAD_IMBALANCE")
SQL["latency_imbalance"] = _imbalance(f"SELECT 'all/' || {_CATEGORY} AS series_id, {INSTANCE} AS instance, date_trunc('day', ts) AS ts, avg(value) / 1000 * CASE WHEN user_id % 9 = 7 THEN 6 ELSE 1 END AS value FROM events GROUP BY {_CATEGORY}, user_id % 9, date_trunc('day', ts)", "0.001", 0.8, 1.5, 2.0, 1000.0, "LATENCY_IMBALANCE")
SQL["seasonal_period"] = f"WITH {N}, d AS (SELECT i, n, value - avg(value) OVER () AS d FROM n), a AS (SELECT k, sum(x.d * y.d) / (SELECT sum(d * d) FROM d) AS a FROM d x JOIN range(4, 168) t(k) ON k < least(x.n // 2, 168) JOIN d y ON y.i = x.i + k GROUP BY k) SELECT 'all' AS series_id, CASE WHEN max(a) > 0 THEN arg_max(k, (a, -k)) ELSE 24 END::INT AS period FROM a"
SQL["high_coverage"] = f"WITH {L}, s AS (SELECT median(value) AS m FROM l), e AS (SELECT k AS id, 1704067200 + k * 86400 AS a, 1704067200 + k * 86400 + 43200 AS b FROM range(0, 29) t(k)), x AS (SELECT id, floor(epoch(ts))::BIGINT AS t, value >= 1.2 * m AS high FROM e JOIN l ON epoch(ts) BETWEEN a AND b, s) SELECT 'all' AS series_id, id, round(avg(high::INT), 6) AS covered, min(t) FILTER (WHERE high) AS first_high, max(t) FILTER (WHERE high) AS last_high FROM x GROUP BY id"
