"""Trailing order statistics and cluster reports against plain versions."""

import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import cluster, rolling
from tidemark.operators import insight
from tidemark.plans import dimensions as dim

DAY = datetime(2024, 1, 1)


def plain(values):
    known = sorted(v for v in values if v is not None and v == v)
    if not known:
        return None, None
    k = (len(known) - 1) // 2
    return known[k], sorted(abs(v - known[k]) for v in known)[k]


def test_sorted_window_keeps_its_order():
    r = random.Random(5)
    for size in (1, 2, 7, 60):
        window, came = rolling.SortedWindow(size), []
        for _ in range(400):
            v = r.choice([None, float("nan"), -0.0, 0.0, r.randint(-3, 3) / 2, r.gauss(0, 5)])
            assert (window.median(), window.deviation()) == plain(came[-size:])
            window.add(v)
            came.append(v)


def test_trailing_over_blocks_and_series(spark):
    r = random.Random(7)
    rows = []
    for series, n in (("hot", 900), ("a", 1), ("b", 61), (None, 40)):
        rows += [(series, DAY + timedelta(seconds=k), r.choice([None, float("nan"), float(r.randint(0, 9)), r.random()]), k) for k in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "series_id string, ts timestamp, value double, extra int")
    for block in (1, 64, 5000):
        got = rolling.trailing(df, ["series_id"], 20, order=["ts"], block=block).collect()
        assert Counter((x.series_id, x.extra) for x in got) == Counter((s, k) for s, _, _, k in rows)
        want = {}
        for s in {x[0] for x in rows}:
            own = [v for t, _, v, _ in rows if t == s]
            want |= {(s, k): (min(k, 20), *plain(own[max(0, k - 20) : k])) for k in range(len(own))}
        assert all((x.before, x.med, x.dev) == want[x.series_id, x.extra] for x in got)
    assert rolling.trailing(df.where("false"), ["series_id"], 20).count() == 0


def test_instance_report_weighs_latency_by_what_came(spark):
    load, buckets, cpu = [], [], []
    counts = [(0, 10, 10), (8, 2, 10), (1, 9, 30), (5, 5, 10)]  # within 0.1 s, within 1 s, load
    low = high = 0
    for k, (a, b, n) in enumerate(counts):
        low, high, t = low + a, high + a + b, DAY + timedelta(hours=k)
        load.append(("s", "sql-1", t, float(n)))
        buckets += [("s", "sql-1", t, 0.1, float(low)), ("s", "sql-1", t, 1.0, float(high)), ("s", "sql-1", t, float("inf"), float(high))]
        cpu.append(("s", "sql-1", t, 0.05 if k else 6.0))
    load.append(("s", "sql-9", DAY, 50.0))  # neither latency nor processor samples
    kind = "series_id string, instance string, ts timestamp, "
    report = cluster.instance_report(spark.createDataFrame(load, kind + "value double"), spark.createDataFrame(buckets, kind + "le double, cum double"), spark.createDataFrame(cpu, kind + "value double"), least=3)
    got = {x.instance: x for x in report.collect()}

    def quantile(a, b, q):
        target = q * (a + b)
        return 0.1 * target / a if target <= a else 0.1 + 0.9 * (target - a) / b

    for name, q in (("p50_ms", 0.5), ("p99_ms", 0.99)):
        want = sum(1000 * quantile(a, b, q) * (a + b) for a, b, _ in counts[1:]) / sum(a + b for a, b, _ in counts[1:])
        assert abs(got["sql-1"][name] - want) < 1e-9
    want = statistics.correlation([n for *_, n in counts[1:]], [quantile(a, b, 0.99) for a, b, _ in counts[1:]])
    assert abs(got["sql-1"].load_p99 - want) < 1e-9
    assert (got["sql-1"].cpu, got["sql-1"].peak_load) == (6.0, 30.0)
    assert got["sql-9"].p99_ms is None and got["sql-9"].cpu is None and got["sql-9"].sensitivity == "unknown"
    one = cluster.component_report(report, F.lit("sql")).collect()[0]
    assert (one.nodes, one.peak_load, one.cost, one.balance) == (2, 80.0, "under_used" if 6 / 16 >= 0.3 else "severely_under_used", "uneven")
    assert cluster.component_report(report.where("false"), F.lit("sql")).count() == 0


def test_detailed_imbalance_names_its_sources(spark):
    days = [DAY + timedelta(days=k) for k in range(10)]
    make = lambda values, *extra: [("s", *extra, i, t, v) for i, v in values.items() for t in days]
    kind = "series_id string, category string, instance string, ts timestamp, value double"
    load = spark.createDataFrame(make({"a": 100.0, "b": 100.0, "c": 700.0}, "read") + make({"a": 5.0, "b": 90.0}, "small"), kind)
    whole = spark.createDataFrame(make({"a": 0.01, "b": 0.01, "c": 0.09}), "series_id string, instance string, ts timestamp, value double")
    even = spark.createDataFrame(make({"a": 50.0, "b": 50.0}, "write"), kind)
    got = sorted((x.source, x.series_id, x.instance, x.type, x.severity) for x in cluster.detailed_imbalance(load, whole, even, even).collect())
    assert got == [
        ("latency", "s", "c", "LATENCY_IMBALANCE", "MEDIUM"),
        ("statements", "s/read", "a", "LOAD_IMBALANCE", "MEDIUM"),
        ("statements", "s/read", "b", "LOAD_IMBALANCE", "MEDIUM"),
        ("statements", "s/read", "c", "LOAD_IMBALANCE", "CRITICAL"),
    ]


def test_links_and_bottlenecks_follow_their_rules(spark):
    row = dict(series_id="s", qps_cv=0.3, latency_cv=0.6, burstiness=0.6, volume_peak=40.0, volume_mean=10.0, latency_tail_ratio=4.0, imbalance=0.2, latency_p99=100.0)
    profile = spark.createDataFrame([row])
    statements = spark.createDataFrame([("s", "x", 30.0, 81.0), ("s", "y", 70.0, 79.0)], "series_id string, key string, percent double, latency_p99 double")
    points = [("s", "x", DAY, 0.3), ("s", "x", DAY, 0.3), ("s", "y", DAY, 0.1)]
    operations = spark.createDataFrame(points, "series_id string, key string, ts timestamp, value double")
    latency = spark.createDataFrame([("s", DAY + timedelta(hours=k), 0.1) for k in range(48)], "series_id string, ts timestamp, value double")
    got = insight.dimension_links(profile, statements, operations, latency).collect()[0]
    assert abs(got.sql - 0.3) < 1e-9 and abs(got.storage - 0.2 / (0.7 / 3)) < 1e-9
    assert (got.load, got.volume, got.balance) == (0.15, 0.4, 0.2)  # no spikes, so no burst rule
    scores = dict(volume_peak=40.0, volume_mean=10.0, read_ratio=0.2, write_ratio=0.8, volume_transactions=0.6, latency_tail_ratio=2.0, imbalance=0.1, hotspot=0.25, qps_peak_to_avg=3.0)
    one = spark.createDataFrame([scores]).withColumn("volume_score", dim.volume_score()).withColumn("b", dim.bottlenecks()).collect()[0]
    assert abs(one.volume_score - 0.8) < 1e-9
    assert [x.name for x in one.b] == ["volume", "load_burst", "sql_hotspot", "latency", "balance"]
