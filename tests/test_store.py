"""Sketches, reordering, ingestion and files chosen by range."""

import glob
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.sources import ranged, sinks
from tidemark.streaming import ingest, reorder


def test_sketches_merge_like_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("a", 1_700_000_000 + 600 * k, float(x), int(u)) for k, (x, u) in enumerate(zip(rng.lognormal(0, 2, 6000), rng.integers(0, 900, 6000), strict=True))]
    rows += [("b", 1_700_000_000, None, 1), ("b", 1_700_000_001, float("nan"), None), (None, 1_700_000_000, 5.0, 1)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double, user long").withColumn("ts", F.timestamp_seconds("t"))
    path = str(tmp_path / "s")
    for k in range(3):
        sketches.store(sketches.summarised(df.where(F.pmod("t", F.lit(1800)) == (1_700_000_000 + 600 * k) % 1800), ["series_id"], "user"), path, str(k))
    rest = df.where("series_id = 'b' and t = 1700000001")
    for _ in range(2):  # a batch that is written again replaces itself
        sketches.store(sketches.summarised(rest, ["series_id"], "user"), path, "rest")
    got = sketches.estimates(sketches.merged(sketches.stored(spark, path), ["series_id"], "year"), {"p50": 0.5, "p99": 0.99}).collect()
    by = {r.series_id: r for r in got if r.series_id != "a" or r.start.year == 2023}
    own = sorted(v for s, t, v, _ in rows if s == "a" and t < 1704067200)
    assert by["a"].n == len(own) and by["a"].lo == own[0] and by["a"].hi == own[-1]
    for q, name in ((0.5, "p50"), (0.99, "p99")):
        assert abs(np.searchsorted(own, by["a"][name]) / len(own) - q) < 0.01
    ids = len({u for s, t, _, u in rows if s == "a" and t < 1704067200})
    assert abs(by["a"].ids - ids) < 0.06 * ids
    assert by["b"].n == 2 and by["b"].p50 is None and by["b"].ids == 1 and by[None].p99 == 5.0
    assert sketches.merged(sketches.stored(spark, path).limit(0), ["series_id"], "week").count() == 0


def test_reorder_buffer_across_a_restart(spark, tmp_path):
    r = random.Random(3)
    chunks = [("a", 10 * k, 10 * k + 10, f"a{k}") for k in range(40)] + [("b", 10 * k, 10 * k + 10, f"b{k}") for k in range(20)]
    late = [c for c in chunks if c[:2] == ("b", 50)]
    sent = [c for c in chunks if c not in late]
    r.shuffle(sent)
    schema = "series_id string, start_s long, end_s long, body string"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = reorder.ordered(stream, origin=0, patience=1000, late="1000 seconds").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        out = {}
        for x in spark.read.parquet(target).orderBy("place").collect():
            out.setdefault(x.series_id, []).append((x.place, x.start_s, x.body, x.gap_s))
        return out

    deliver(sent[:20] + sent[:3])
    deliver([*sent[20:40], (None, 0, 10, "x"), ("a", None, 10, "x"), ("a", 5, 5, "x")])
    run()
    deliver(sent[40:] + sent[10:15])  # after a restart; some chunks again
    got = run()
    assert [x[2] for x in got["a"]] == [f"a{k}" for k in range(40)] and [x[0] for x in got["a"]] == list(range(40))
    assert [x[2] for x in got["b"]] == [f"b{k}" for k in range(5)]
    deliver([("a", 5000, 5010, "end")])  # event time passes the patience: b goes on without its missing chunk
    deliver([("c", 0, 10, "c0")])
    got = run()
    assert [x[2] for x in got["b"]] == [f"b{k}" for k in range(20) if k != 5] and got["b"][5][3] == 10 and got["b"][6][3] == 0
    deliver(late)
    assert len(run()["b"]) == 19


DAY = 19723  # 2024-01-01


def samples(spark, days):
    rows = [("m_total", {"k": k}, 86400 * d + 3600 * h, float(d * 100 + h)) for d in days for h in range(0, 24, 6) for k in "xy"]
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, t long, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_ingestion_is_idempotent(spark, tmp_path):
    source, target, state, out = (str(tmp_path / x) for x in ("in", "held", "state", "out"))
    sinks.write_text(samples(spark, range(DAY, DAY + 3)), source)
    assert ingest.ingest(spark, source, target, state, timeout=120) == 1
    first = ingest.ingested(spark, target).count()
    assert ingest.ingest(spark, source, target, state, timeout=120) == 0 and ingest.ingested(spark, target).count() == first == 24
    batch = ingest.ingested(spark, target).drop("batch").cache()
    batch.count()
    ingest.write_batch(batch, target, 0)  # a batch that is replayed
    assert ingest.ingested(spark, target).count() == first
    sinks.write_text(samples(spark, range(DAY + 2, DAY + 5)).withColumn("value", F.col("value") + 0.5), source)  # day 2 again, mended
    assert ingest.ingest(spark, source, target, state, timeout=120) >= 1
    got = {(r.labels["k"], r.ts.timestamp()): r.value for r in ingest.compact(spark, target, out).collect()}
    assert len(got) == 5 * 8 and all(v % 1 == (0.5 if t >= (DAY + 2) * 86400 else 0) for (_, t), v in got.items())
    ask = spark.createDataFrame([("m_total", DAY * 86400, (DAY + 6) * 86400)], "metric string, start long, end long")
    held = ingest.compact(spark, target, out + "2").groupBy("metric").agg(F.unix_seconds(F.min("ts")).alias("start"), (F.unix_seconds(F.max("ts")) + 6 * 3600).alias("end"))
    assert [tuple(r) for r in ingest.missing(ask, held, ["metric"]).collect()] == [("m_total", (DAY + 5) * 86400, (DAY + 6) * 86400)]


def test_files_outside_of_the_range_are_not_opened(spark, tmp_path):
    for d in range(4):
        name = f"2024-01-0{d + 1}_00-00-00_2024-01-0{d + 1}_23-59-59"
        lines = sinks.text_lines(samples(spark, [DAY + d])).select("line")
        lines.coalesce(1).write.text(str(tmp_path / "files" / name))
    folder = str(tmp_path / "files")
    day = 86400 * DAY
    for f in glob.glob(f"{folder}/2024-01-04*/part-*"):  # opened, it would break the job
        with open(f, "r+b") as x:
            x.write(b"\xff" * 8)
    assert len(ranged.listed(spark, folder)) == 4
    got = ranged.read_range(spark, folder, day + 86400, day + 2 * 86400 + 3600)
    opened = got.inputFiles()
    assert len(opened) == 2 and all("2024-01-02" in f or "2024-01-03" in f for f in opened)
    assert got.count() == 10 and got.where("newest").count() == 0
    far = ranged.read_range(spark, folder, 0, 1)
    assert len(far.inputFiles()) == 1 and "2024-01-04" in far.inputFiles()[0] and far.where("not newest").count() == 0
    assert ranged.range_of("x/2024-13-01_00-00-00_2024-01-01_00-00-00") == ranged.range_of("x/2024-01-02_00-00-00_2024-01-01_00-00-00") == (None, None)
    (tmp_path / "none").mkdir()
    assert ranged.read_range(spark, str(tmp_path / "none"), 0, 1).count() == 0
