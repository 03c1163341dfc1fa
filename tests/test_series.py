"""Series construction, intervals and readers on literal inputs."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.functions import timerange as tr
from tidemark.operators import series as s
from tidemark.sources import prom, sinks


def rows(spark, values, start=1000, step=120, series="a"):
    return spark.createDataFrame([(series, start + k * step, float(v)) for k, v in enumerate(values)], "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")


def test_counter_rate(spark):
    df = rows(spark, [10, 130, 30, 90])
    got = [r.value for r in s.counter_rate(df, ["series_id"]).orderBy("ts").collect()]
    assert got == [1.0, 0.25, 0.5]
    assert [r.value for r in s.counter_rate(df, ["series_id"], "drop").orderBy("ts").collect()] == [1.0, 0.5]
    assert s.counter_rate(df, ["series_id"], max_gap=60).count() == 0


def test_histogram(spark):
    inf = float("inf")
    cells = [("a", 1, 1.0, 10.0), ("a", 1, 2.0, 10.0), ("a", 1, inf, 10.0), ("a", 2, 1.0, 15.0), ("a", 2, 2.0, 20.0), ("a", 2, inf, 20.0), ("a", 3, 1.0, 15.0), ("a", 3, 2.0, 20.0), ("a", 3, inf, 20.0)]
    df = spark.createDataFrame(cells, "series_id string, ts long, le double, cum double").withColumn("ts", F.timestamp_seconds("ts"))
    delta = s.bucket_delta(df, ["series_id"])
    assert {(r.le, r.delta) for r in delta.collect()} == {(1.0, 5.0), (2.0, 10.0), (inf, 10.0)}
    assert s.histogram_quantile(delta, ["series_id"], 0.75, "delta").first().value == pytest.approx(1.5)
    beyond = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 1, inf, 10.0)], "series_id string, ts long, le double, cum double")
    assert s.histogram_quantile(beyond, ["series_id"], 0.99).first().value == 1.0


@pytest.mark.parametrize(("ts", "want"), [([1000], [(1000, 1000, 1)]), ([1000, 1015, 1030, 1045], [(1000, 1045, 4)]), ([1000, 1015, 2000, 2015], [(1000, 1015, 2), (2000, 2015, 2)])])
def test_islands(spark, ts, want):
    df = spark.createDataFrame([("a", t) for t in ts], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    got = s.islands(df, ["k"], 300).select(F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "cnt").collect()
    assert sorted(map(tuple, got)) == want


GAPS = [
    ((1000, 2000), [], [(1000, 2000)]), ((1000, 2000), [(500, 2500)], []), ((1000, 2000), [(100, 500)], [(1000, 2000)]), ((1000, 2000), [(500, 1500)], [(1500, 2000)]), ((1000, 2000), [(1500, 2500)], [(1000, 1500)]),
    ((1000, 2000), [(1200, 1800)], [(1000, 1200), (1800, 2000)]), ((1000, 3000), [(500, 1200), (1800, 2200)], [(1200, 1800), (2200, 3000)]), ((1000, 2000), [(1000, 2000)], []), ((1000, 2000), [(500, 1000)], [(1000, 2000)]),
    ((1000, 5000), [(1200, 1500), (2000, 2500), (3000, 3500)], [(1000, 1200), (1500, 2000), (2500, 3000), (3500, 5000)]), ((1000, 2000), [(500, 1500), (1500, 2500)], []), ((1000, 3000), [(500, 1500), (1550, 3500)], [(1500, 1550)]),
]


def test_interval_gaps_and_union(spark):
    request = spark.createDataFrame([(k, *r) for k, (r, _, _) in enumerate(GAPS)], "k int, start long, end long")
    have = spark.createDataFrame([(k, *x) for k, (_, xs, _) in enumerate(GAPS) for x in xs], "k int, start long, end long")
    got = {}
    for r in s.interval_gaps(request, have, ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, _, w) in enumerate(GAPS) if w}
    u = spark.createDataFrame([(1, 100, 200), (1, 200, 300), (2, 100, 200), (2, 150, 250), (3, 100, 200), (3, 300, 400)], "k int, start long, end long")
    assert sorted((r.k, r.start, r.end) for r in s.interval_union(u, ["k"]).collect()) == [(1, 100, 300), (2, 100, 250), (3, 100, 200), (3, 300, 400)]
    cover = s.interval_coverage(request, have, ["k"]).where("k = 5").first()
    assert cover.covered == 600 and cover.percent == 60


def test_sample_interval_and_stats(spark):
    assert s.sample_interval(rows(spark, range(4)), ["series_id"]).first().step == 120
    assert s.sample_interval(rows(spark, [1]), ["series_id"]).first().step == 300
    got = rows(spark, [4, 1, 3, 2, 10]).groupBy("series_id").agg(st.sorted_values("value").alias("v")).select(st.floor_percentile(F.col("v"), 90).alias("p"), st.median_of(F.col("v")).alias("m"), st.mad_of(F.col("v"), F.lit(3.0)).alias("d"), st.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.5).alias("e")).first()
    assert (got.p, got.m, got.d, got.e) == (4.0, 3.0, 1.0, 1.5)
    kinds = spark.createDataFrame([("a_bucket",), ("b_total",), ("c",)], "n string").select(st.metric_type("n").alias("k"))
    assert [r.k for r in kinds.collect()] == ["histogram", "counter", "gauge"]


def test_times():
    assert tr.parse_duration("1d2h30m15s") == timedelta(days=1, hours=2, minutes=30, seconds=15)
    assert tr.parse_duration("500ms") == timedelta(milliseconds=500) and tr.parse_duration("0d") == timedelta(0)
    for bad in ("", "abc", "7w", "h"):
        with pytest.raises(ValueError):
            tr.parse_duration(bad)
    want = datetime(2024, 1, 2, 3, 4, tzinfo=timezone.utc)
    assert all(tr.parse_time(x) == want for x in ("2024-01-02 03:04", "2024-01-02T03:04:00", "2024-01-02T03:04:00Z", "2024-01-02T04:04:00+01:00", str(int(want.timestamp()))))
    assert tr.resolve_range(duration="2h", now=want) == (want - timedelta(hours=2), want)
    with pytest.raises(ValueError):
        tr.resolve_range("2024-01-02", "2024-01-01", now=want)


def test_text_source_and_sink(spark, tmp_path):
    path = tmp_path / "m.prom"
    path.write_text('# TYPE test gauge\ntest{a="1",b="x,y"} 1 1640000000000\n\ntest{a="1",b="x,y"} 2 1640000015000\nx_query_total{result="Error"} 1 1640000000\nx_query_total{result="OK"} 1 1640000000\nh_bucket{le="+Inf"} 5 1640000000\nh_bucket{le="0.5"} 3 1640000000\nbroken\n')
    got = prom.read_text(spark, str(path)).cache()
    assert got.count() == 5 and got.where("metric = 'test'").first().labels == {"a": "1", "b": "x,y"}
    assert {(r.le, r.cum) for r in prom.histogram_rows(got).collect()} == {(float("inf"), 5.0), (0.5, 3.0)}
    line = sinks.text_lines(got.where("metric = 'test'")).orderBy("ts").first().line
    assert line == 'test{a="1",b="x,y"} 1.0 1640000000000'
    sinks.write_csv(got.where("metric = 'test'"), str(tmp_path / "d"), str(tmp_path / "l"))
    back = prom.read_csv(spark, str(tmp_path / "d"), str(tmp_path / "l")).orderBy("ts").collect()
    assert [r.value for r in back] == [1.0, 2.0] and back[0].labels == {"a": "1", "b": "x,y"}
    newer = got.withColumn("value", F.col("value") + 1).withColumn("file", F.lit("z"))
    assert sinks.compacted(got.unionByName(newer)).where("metric = 'test'").agg(F.sum("value")).first()[0] == 5.0


def test_response_and_ranges(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"data":{"result":[{"metric":{"__name__":"m","instance":"i"},"values":[[1640000000.0,"1.5"],[1640000015,"bad"]]}]}}')
    got = prom.read_response(spark, str(path)).orderBy("ts").collect()
    assert [(r.metric, r.value) for r in got] == [("m", 1.5), ("m", 0.0)] and got[0].labels == {"instance": "i"}
    names = spark.createDataFrame([("2026-02-20_12-15-00_2026-02-22_12-15-00.prom",), ("2026-02-19_12-15-00_2026-02-21_12-15-00.prom",), ("x",)], "file string")
    assert prom.file_ranges(names).count() == 2 and prom.latest_range(prom.file_ranges(names)).first().file.startswith("2026-02-20")
    listing = tmp_path / "c.txt"
    listing.write_text("c1 (aws/us-1)\n# no\nc2 (gcp/eu)\n")
    clusters = prom.read_clusters(spark, str(listing))
    assert [tuple(r) for r in prom.active(clusters, spark.createDataFrame([("c2",)], "cluster_id string")).collect()] == [("c1", "aws", "us-1")]


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(3)
    for ts, n in ((1, 3), (2, 2), (1, 1)):
        sinks.save_session(df.limit(n), path, "c", ts)
    assert spark.read.parquet(path).where("session_ts = 1").count() == 1 and sinks.latest_session(spark, path, "c").count() == 2
    assert sinks.delete_session(spark, path, "c", 2) and sinks.sessions(spark, path).count() == 1
