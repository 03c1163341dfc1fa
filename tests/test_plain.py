"""Path-dependent operators against plain versions, and the operators on several series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import pearson
from tidemark.operators import changepoints as cp
from tidemark.operators import detectors as d
from tidemark.operators import events as ev
from tidemark.operators import grouped as g
from tidemark.operators import insight
from tidemark.sources import sinks

from test_series import rows


def test_pelt_like_the_unpruned_search():
    r = np.random.default_rng(3)
    for k in range(60):
        v = np.concatenate([r.normal(r.uniform(-5, 5), 1, r.integers(10, 40)) for _ in range(r.integers(1, 5))])
        penalty = 3 * v.var() * np.log(len(v)) * (0.05 + 0.2 * (k % 3))
        n, best, back = len(v), [-penalty], [0]
        for e in range(1, n + 1):
            options = [(best[s] + v[s:e].var() * (e - s) + penalty, s) for s in range(max(0, e - 9)) if e - s >= 10]
            c, s = min(options, default=(np.inf, 0))
            best.append(c)
            back.append(s)
        cuts, e = [], n
        while back[e] > 0:
            e = back[e]
            cuts.append(e)
        assert cp.pelt_cuts(v, penalty) == cuts[::-1]


def test_density_clusters_like_a_plain_search():
    r = np.random.default_rng(5)
    for _ in range(30):
        x = np.round(r.standard_normal(80) * r.choice([1, 4]), 2)
        near = [{j for j in range(80) if j != k and abs(j - k) <= 24 and abs(x[j] - x[k]) <= 2} for k in range(80)]
        core = {k for k in range(80) if len(near[k]) >= 5}
        noise = {k for k in range(80) if k not in core and not near[k] & core}
        labels = g.dbscan_labels(x)
        assert {k for k in range(80) if labels[k] == -1} == noise
        assert all(labels[a] == labels[b] for a in core for b in near[a] & core)


def test_isolation_scores_tell_what_is_alone():
    r = np.random.default_rng(2)
    x = np.column_stack([np.arange(200) % 24, r.standard_normal(200), np.zeros(200)])
    x[77, 1] = 30
    s = g.isolation_scores(x, trees=60)
    assert np.argmax(s) == 77 and s[77] > np.median(s) + 0.05 and ((s > 0) & (s < 1)).all()
    assert (g.isolation_scores(x, trees=60) == s).all()


def test_random_cut_tree_scores_displacement():
    tree = g.RandomCutTree(np.random.default_rng(0))
    usual = [tree.update(np.array([float(k % 5), float(k % 3)])) for k in range(200)]
    assert tree.score(np.array([90.0, 90.0])) > 5 * np.median(usual)
    assert g.RandomCutTree(np.random.default_rng(0)).score(np.array([1.0])) == 0.0


def test_long_series_are_not_cut(spark):
    n = 120_000
    v = np.full(n, 5.0)
    v[n // 2 :] = 9.0
    got = [r.idx for r in cp.cusum(rows(spark, v + 0.01 * np.sin(np.arange(n)), step=120)).collect()]
    assert got and all(abs(k - n // 2) % 1 == 0 for k in got) and min(got) >= 0
    spread = g.per_series(rows(spark, v), lambda p: p[["series_id"]].head(1).assign(n=len(p)), "series_id string, n long").collect()
    assert [r.n for r in spread] == [n]


def test_null_and_endless_values_do_not_count(spark):
    df = rows(spark, [1.0, float("nan"), float("inf"), 2.0, 3.0])
    assert [r.n for r in g.per_series(df, lambda p: p[["series_id"]].head(1).assign(n=len(p)), "series_id string, n long").collect()] == [3]


def test_windows_of_evidence_meet_points_across_slots(spark):
    q = rows(spark, np.arange(2000.0), step=120)
    e = spark.createDataFrame([("a", "a#1", 100_000, 130_000), ("a", "a#2", 21_000, 22_000)], "series_id string, event_id string, t0 long, t1 long")
    series = q.select("series_id").first()[0]
    e = e.select(F.lit(series).alias("series_id"), "event_id", F.timestamp_seconds("t0").alias("ts"), F.timestamp_seconds("t1").alias("end_ts"))
    got = {r.event_id: r for r in ev.evidence(e, q, q, step=120).collect()}
    at = [1000 + 120 * k for k in range(2000)]
    inside = lambda a, b: [k for k, t in enumerate(at) if a <= t <= b]
    for name, (a, b) in {"a#1": (100_000, 130_000), "a#2": (21_000, 22_000)}.items():
        own = inside(a, b)
        assert got[name].q_event["count"] == len(own) == got[name].l_event["count"] and got[name].q_event["mean"] == pytest.approx(np.mean(own))
        assert got[name].q_event["median"] == own[(len(own) - 1) * 50 // 100]
    assert got["a#1"].q_prev["count"] == len(inside(100_000 - 86_400, 130_000 - 86_400)) and got["a#2"].q_prev is None


def test_lagged_correlation_finds_the_lag(spark):
    x = np.random.default_rng(1).standard_normal(400)
    a, b = rows(spark, x, step=120), rows(spark, np.r_[np.zeros(3), x[:-3]], step=120)
    got = insight.causality(a, b, "x", "y").collect()
    assert [(r.lag, r.direction, r.causal) for r in got] == [(3, "x_leads", True)] and got[0].correlation > 0.99


def test_synthetic_series_are_valid(spark):
    got = insight.validation(insight.synthetic(spark, 20, 300)).collect()
    assert len(got) == 20 and all(r.valid and r.samples == 300 for r in got)


def test_files_merge_with_their_neighbours(spark, tmp_path):
    assert sinks.merge_groups([("b", 200, 300, 5), ("a", 0, 100, 5), ("d", 5000, 6000, 5), ("c", 310, 400, 95)], 100, 300) == [["a", "b"], ["c"], ["d"]]
    made = spark.range(400).select(F.lit("up").alias("metric"), F.create_map(F.lit("job"), F.lit("x")).alias("labels"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"), F.lit(1).alias("seq"))
    made.repartitionByRange(8, "ts").write.parquet(str(tmp_path / "in"))
    done = sinks.compact_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert (done.files, done.groups) == (8, 1) and got.count() == 400 and len(list((tmp_path / "out" / "part=0").glob("*.parquet"))) == 1


def test_first_per_bucket_is_one_row(spark):
    found = d.mad_anomalies(rows(spark, [1.0] * 30 + [90.0, 91.0] + [1.0, 2.0] * 10, step=60))
    assert d.first_per_bucket(found.unionByName(found)).count() <= 2


def test_correlation_without_variance_is_null(spark):
    data = [("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0), ("few", 1.0, 2.0), ("few", 2.0, 3.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", 3.0, 6.0), ("up", 9.0, None), ("none", None, 1.0)]
    got = spark.createDataFrame(data, "k string, x double, y double").groupBy("k").agg(pearson("x", "y").alias("r")).collect()
    assert {r.k: r.r for r in got} == {"flat": None, "few": None, "up": pytest.approx(1.0), "none": None}


def test_evidence_of_events_within_flat_series(spark):
    """Load that moves while the other metrics stand still, as where statements or storage are idle."""
    q, flat = rows(spark, np.arange(600.0), step=120), rows(spark, np.full(600, 3.0), step=120)
    series = q.select("series_id").first()[0]
    e = spark.createDataFrame([(series, "e#1", 21_000, 24_000)], "series_id string, event_id string, t0 long, t1 long")
    e = e.select("series_id", "event_id", F.timestamp_seconds("t0").alias("ts"), F.timestamp_seconds("t1").alias("end_ts"))
    got = ev.evidence(e, q, q, q, flat, q, step=120).first()
    assert got.stmt_corr is None and got.backend_corr == pytest.approx(1.0)


@pytest.mark.parametrize("batch", [1, 7, 4096])
def test_sessions_are_folded_alike_in_any_batch(spark, monkeypatch, batch):
    r = np.random.default_rng(11)
    at = np.cumsum(r.choice([0, 60, 120, 300, 900, 4000, 9000], 400))
    names = r.choice(["MAD", "EMA", "raw_latency"], 400)
    kinds = r.choice(["QPS_SPIKE", "QPS_DROP", "LATENCY_SPIKE"], 400)
    data = [("a", str(kinds[k]), "HIGH", int(at[k]), float(k), [str(names[k])]) for k in range(400)]
    found = spark.createDataFrame(data, "series_id string, type string, severity string, t long, z_score double, detected_by array<string>")
    found = found.select("series_id", "type", "severity", F.timestamp_seconds("t").alias("ts"), F.lit(None).cast("timestamp").alias("end_ts"), F.lit(0).alias("duration_sec"), F.lit(1.0).alias("value"), F.lit(1.0).alias("baseline"), "z_score", F.lit(None).cast("double").alias("confidence"), "detected_by", F.lit(None).cast("string").alias("instance"), F.lit("").alias("detail"))
    monkeypatch.setattr(ev, "BATCH", batch)
    got = sorted((x.ts.timestamp(), x.end_ts.timestamp(), x.type, tuple(x.detected_by), x.detail) for x in ev.stitched(found, 60).collect())
    monkeypatch.setattr(ev, "BATCH", 10**9)
    assert got == sorted((x.ts.timestamp(), x.end_ts.timestamp(), x.type, tuple(x.detected_by), x.detail) for x in ev.stitched(found, 60).collect())
    assert 1 < len(got) < 400
