"""Detectors, folds and evidence on literal series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changepoints as cp
from tidemark.operators import detectors as d
from tidemark.operators import events as ev
from tidemark.operators import grouped as g
from tidemark.operators import profile as p
from tidemark.operators import workload as w

from test_series import rows


def noisy(n=300, seed=1, base=1000.0):
    r = np.random.default_rng(seed)
    return base + 50 * np.sin(np.arange(n) * 2 * np.pi / 24) + 20 * r.standard_normal(n)


def test_planted_point_is_found_by_each(spark):
    v = noisy()
    v[150] = 4000
    df = rows(spark, v, step=3600).cache()
    at = 1000 + 150 * 3600
    for detect in (d.mad_anomalies, d.hourly_baseline, d.decomposition_anomalies, d.dynamic_threshold, d.multi_scale, d.contextual, g.esd, g.shesd, g.ema_detector, g.isolation_forest, g.dbscan, g.holt_winters, g.peak_anomalies, g.random_cut_forest):
        got = [int(r.t) for r in detect(df).select(F.unix_seconds("ts").alias("t")).collect()]
        assert at in got, detect.__name__


def test_core_detectors(spark):
    v = noisy(200) + 120 * np.sin(np.arange(200))
    v[60] = 0
    assert [r.severity for r in d.core_drops(rows(spark, v, step=3600)).collect()] == ["CRITICAL"]
    v[100] = 9000
    v[120:140] = 5000
    df = rows(spark, v, step=3600)
    assert "CRITICAL" in [r.severity for r in d.core_spikes(df).collect()]
    assert d.core_sustained(df).where("type = 'SUSTAINED_HIGH_QPS'").count() >= 4
    assert d.core_all(df).count() >= 2
    assert d.core_spikes(df.limit(5)).count() == 0


def test_sustained_latency(spark):
    df = rows(spark, [2.5 if 20 <= k < 35 else 0.02 for k in range(80)])
    got = d.sustained_latency(df).collect()
    assert len(got) == 1 and got[0].type == "LATENCY_DEGRADED" and got[0].duration_sec == 15 * 120


def test_change_points_and_forecasts(spark):
    v = np.r_[np.full(60, 10.0), np.full(60, 30.0)] + np.random.default_rng(0).standard_normal(120)
    df = rows(spark, v, step=3600)
    for find in (cp.cusum, cp.pelt, cp.sliding_window, cp.e_divisive):
        assert any(abs(r.idx - 60) <= 4 for r in find(df).collect()), find.__name__
    assert cp.all_change_points(df).count() <= 10
    line = rows(spark, np.arange(60.0), step=3600)
    got = {r.step: r.prediction for r in cp.linear(line, 3).collect()}
    assert got[1] == pytest.approx(60) and got[3] == pytest.approx(62)
    holt = {r.step: r.prediction for r in cp.exponential(line, beta=0.1, horizon=2).collect()}
    assert holt[1] == pytest.approx(60) and holt[2] == pytest.approx(61)
    assert {r.method for r in cp.auto(line, 2).select("method").distinct().collect()} == {"seasonal_naive"}


def finding(t, kind="QPS_SPIKE", severity="MEDIUM", z=4.0, by=("A",), end=None):
    return ("s", kind, severity, pd.Timestamp(t, unit="s"), pd.Timestamp(end, unit="s") if end else None, 0, 1.0, 1.0, z, 0.5, list(by), None, "x")


def frame(spark, items):
    return spark.createDataFrame([(x[0], x[1], x[2], x[3].to_pydatetime(), x[4].to_pydatetime() if x[4] is not None else None, *x[5:]) for x in items], g.SCHEMA)


CASES = {
    "contiguous": ([finding(1000, "QPS_DROP", z=-3.1), finding(1120, "LATENCY_SPIKE", "HIGH", by=("B",))], 240, 1),
    "separated": ([finding(1000, "QPS_DROP"), finding(2000, "QPS_DROP")], 120, 2),
    "adaptive window": ([finding(t, by=("A", "B")) for t in (1000, 1720, 2440)], 240, 1),
    "no over-merge": ([finding(1000), finding(4600)], 240, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_compact(spark, name):
    items, gap, want = CASES[name]
    got = ev.stitched(frame(spark, items), 120, gap, with_cadence=False).collect()
    assert len(got) == want
    if name == "contiguous":
        assert got[0].type == "QPS_SPIKE" and got[0].duration_sec >= 240 and len(got[0].detected_by) == 2 and got[0].severity == "HIGH"


def test_span_guards(spark):
    def count(starts, by=("A",), end=0, **options):
        items = [finding(x, z=1.0, by=by, end=x + end if end else None) for x in starts]
        return ev.stitched(frame(spark, items), 120, 480, **options).count()

    rhythm, gaps = {"with_gaps": False}, {"with_cadence": False}
    assert count([1000 + 1800 * k for k in range(8)], **rhythm) == 8
    assert count([1000 + 360 * k for k in range(40)], **rhythm) > 1
    assert count([1000 + 480 * k for k in range(30)], ("x_latency",), **rhythm) > 1
    assert count([1000 + 360 * k for k in range(100)], **gaps) > 1
    assert count([1000, 1000 + 14400 + 360], end=14400, **gaps) == 1


def test_ensemble_counts_votes(spark, monkeypatch):
    made = {
        "mad": [finding(1000, by=("MAD",), z=4.0), finding(2000, by=("MAD",)), finding(3000, by=("MAD",), z=5.0), finding(4000, by=("MAD",))],
        "esd": [finding(1000, by=("ESD",), z=9.0), finding(3000, by=("ESD",), z=4.0), finding(4000, by=("ESD",))],
        "forest": [finding(3000, by=("IsolationForest",), z=0.7), finding(4000, by=("IsolationForest",)), finding(5000, by=("IsolationForest",))],
        "shesd": [finding(4000, by=("SHESD",)), finding(5060, by=("SHESD",))],
    }
    for module, name, key in ((d, "mad_anomalies", "mad"), (g, "esd", "esd"), (g, "isolation_forest", "forest"), (g, "shesd", "shesd")):
        monkeypatch.setattr(module, name, lambda df, key=key: frame(spark, made[key]))
    got = {int(r.ts.timestamp()): r for r in g.ensemble(rows(spark, noisy(30), step=60)).collect()}
    assert {t: len(r.detected_by) for t, r in got.items()} == {1000: 2, 3000: 3, 4000: 4}
    assert got[1000].z_score == 9.0 and got[3000].z_score == 5.0
    assert got[3000].severity == "HIGH" and got[4000].severity == "CRITICAL"
    assert got[1000].detail.endswith("(agreement: 2/4 methods)")


def test_ensemble_finds_a_planted_point(spark):
    v = noisy()
    v[150] = 4000
    got = g.ensemble(rows(spark, v, step=3600)).select(F.unix_seconds("ts").alias("t"), "severity").collect()
    assert (1000 + 150 * 3600, "CRITICAL") in [(r.t, r.severity) for r in got]
    assert g.ensemble(rows(spark, v[140:160], step=3600)).count() == 0
    assert g.ensemble(rows(spark, noisy(), step=3600)).collect() == []  # no method finds anything


def test_abnormal_runs_every_detector(spark, monkeypatch):
    from tidemark import catalog
    from tidemark.plans import abnormal as ab

    v = noisy()
    v[100:130] = 100  # a sustained run
    v[200] = 4000
    got = ab.findings(rows(spark, v, step=3600)).groupBy(F.col("detected_by")[0].alias("by")).agg(F.collect_set("type").alias("types"))
    got = {r.by: r.types for r in got.collect()}
    assert "SUSTAINED_LOW_QPS" in got["Core"] and "QPS_SPIKE" in got["Ensemble"]
    asked = []
    monkeypatch.setattr(ab, "findings", lambda qps, latency=None, names=None: asked.append(names) or d.mad_anomalies(qps))
    monkeypatch.setattr(catalog, "planted", lambda df: df)
    monkeypatch.setattr(catalog.m, "hourly", lambda *_: rows(spark, v, step=3600))
    monkeypatch.setattr(catalog.m, "latency", lambda *_: rows(spark, v, step=3600))
    catalog.QUERIES["abnormal"](spark, "")
    assert asked == [None]


def test_session_merge_and_votes(spark):
    df = frame(spark, [finding(1000, by=("MAD",)), finding(1120, "QPS_DROP", "HIGH", z=-9.0, by=("ESD",)), finding(99000, by=("MAD",))])
    got = ev.session_merge(df).orderBy("ts").collect()
    assert [len(r.detected_by) for r in got] == [2, 1] and got[0].confidence == pytest.approx(0.4) and got[0].type == "QPS_DROP"
    assert ev.confident(ev.session_merge(df)).count() == 1
    assert ev.anchored_merge(df).count() == 2
    assert d.votes(df.unionByName(df)).where("hits = 2").count() == 3


def test_evidence_rules(spark):
    t = "struct<count:int,mean:double,median:double,p90:double,p95:double,p99:double,max:double,min:double,zero_ratio:double>"
    z = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)

    def win(n, median=0.0, p90=0.0, p95=0.0, p99=0.0, zero=0.0):
        return (n, 0.0, *map(float, (median, p90, p95, p99)), 0.0, 0.0, zero)

    lat = lambda b, e: (win(40, p90=b[0], p99=b[1]), win(20, p90=e[0], p99=e[1], p95=e[2] if len(e) > 2 else 0.0))
    cases = [
        ("LOW_BASELINE_BURST", win(40, .1, 0, .2), win(20, .4, 6, 8), z, z, z, z, z, z, None, None, 1200),
        ("LATENCY_ONLY_DEGRADATION", win(40, 80, 0, 100), win(20, 82, 100, 105), win(10, 80), win(10, 81), *lat((.03, .1), (.5, 2.0)), z, z, .2, .1, 1800),
        ("WORKLOAD_LINKED_SHIFT", win(40, 100, 0, 120), win(20, 180, 190, 200), win(10, 110), win(10, 170), *lat((.03, .1), (.04, .12)), z, z, .92, .81, 1800),
        ("BACKEND_LATENCY_DEGRADATION", win(40, 100, 0, 120), win(20, 102, 125, 130), win(10, 100), win(10, 101), *lat((.03, .1), (.8, 2.0, 1.5)), win(40, p99=.03), win(20, p99=.12), .1, .2, 2400),
        (None, win(40, 100, 0, 120), win(20, 180, 190, 200), win(10, 165), win(10, 170), *lat((.03, .08), (.03, .09)), z, z, .82, .73, 14400),
        ("SHORT_INTENSE_BURST", win(40, 50, 0, 60), win(20, 120, 180, 220), win(10, 55), win(10, 130), *lat((.03, .08), (.03, .09)), z, z, .2, .1, 5400),
        (None, win(40, 100, 0, 120), win(20, 170, 185, 210), win(10, 110), win(10, 132), *lat((.03, .08), (.8, 2.0)), z, z, .7, .55, 10800),
    ]
    names = ["q_base", "q_event", "q_edge_base", "q_edge", "l_base", "l_event", "b_base", "b_event"]
    schema = "want string, " + ", ".join(f"{n} {t}" for n in names) + ", stmt_corr double, backend_corr double, d long"
    df = spark.createDataFrame(cases, schema).withColumn("q_prev", F.lit(None).cast(t)).withColumn("l_prev", F.lit(None).cast(t))
    got = ev.judged(df).select("want", "reason").collect()
    assert [r.reason for r in got] == [r.want for r in got]


def test_profile_runs_and_labels(spark):
    q = rows(spark, noisy(800), step=3600)
    lat = rows(spark, np.abs(noisy(800, 2)) / 1e4, step=3600)
    got = p.load_profile(q, lat).first()
    assert got.load_class in ("medium", "high") and got.stability in ("stable", "very_stable", "moderate")
    assert got.monthly_weeks >= 3 and 0 <= got.burstiness <= 1.5 and 0 <= got.seasonality <= 1
    assert w.spectrum(q).where("rank = 1").first().cycle == "daily"
    assert w.tail(q).first().tail in ("heavy", "moderate", "light")


def test_workload(spark):
    t = [("s", k, F_, v) for k, vs in {"Select": (6, 8), "Insert": (3, 3), "Begin": (1, 1)}.items() for F_, v in enumerate(vs)]
    df = spark.createDataFrame([(a, b, c * 60, float(v)) for a, b, c, v in t], "series_id string, key string, t long, value double").select("series_id", "key", F.timestamp_seconds("t").alias("ts"), "value")
    got = w.read_write(df).first()
    assert got.read_ratio == pytest.approx(0.7) and got.read_heavy
    assert {r.key: round(r.percent, 3) for r in w.mix(df).collect()}["Select"] == pytest.approx(63.636)
    assert w.write_amplification(df, df).first().write_amplification == 0.0
    assert w.workload_profile(df, df).first().category == "mixed"
