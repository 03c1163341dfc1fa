"""Documents of mixed shapes, and sessions behind an index with versions."""

import json
import threading

from pyspark.sql import functions as F

from tidemark.operators import numbering
from tidemark.sources import documents, results, sessions


def test_documents_of_every_shape(spark, tmp_path):
    texts = {
        "lower.json": json.dumps([{"timestamp": 10, "value": 1.5}, {"timestamp": 20.25, "value": None}, {"value": 3}]),
        "upper.json": json.dumps([{"Timestamp": 10, "Value": 2}, {"timestamp": "30", "value": "4.5"}]),
        "response.json": json.dumps({"data": {"result": [{"metric": {}}, {"values": [[5, "1e3"], [6, "x"], [7], ["y", "1"]]}, {"values": [[8, 9]]}]}}),
        "both.csv": "id,ts,value\n3,100,1.0\n7,200,2.0\n7,300,\n",
        "both.json": json.dumps([{"timestamp": 1, "value": 1}]),
        "broken.json": '[{"timestamp": 1',
        "text.json": '"text"',
        "empty.json": "",
        "none.json": "[]",
        "notes.txt": "not a document",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = documents.read_documents(spark, str(tmp_path))
    rows = sorted((r.document, r.series, r.t, r.value) for r in got.select("document", "series", F.unix_millis("ts").alias("t"), "value").collect())
    assert rows == [
        ("both", 3, 100_000, 1.0), ("both", 7, 200_000, 2.0), ("both", 7, 300_000, 0.0),
        ("lower", 0, 10_000, 1.5), ("lower", 0, 20_250, 0.0),
        ("response", 1, 5_000, 1000.0), ("response", 1, 6_000, 0.0), ("response", 1, 7_000, 0.0), ("response", 2, 8_000, 9.0),
        ("upper", 0, 10_000, 2.0), ("upper", 0, 30_000, 4.5),
    ]
    first = documents.first_series(got).groupBy("document").count().collect()
    assert {r.document: r["count"] for r in first} == {"both": 1, "lower": 2, "response": 3, "upper": 2}
    (tmp_path / "nothing").mkdir()
    assert documents.read_documents(spark, str(tmp_path / "nothing")).count() == 0


def test_documents_round_trip(spark, tmp_path):
    points = spark.range(120).select(F.concat(F.lit("m"), F.col("id") % 4).alias("document"), F.lit(0).cast("long").alias("series"), F.timestamp_millis(1_700_000_000_000 + 250 * F.col("id")).alias("ts"), (F.col("id") / 7).alias("value"))
    for k, style in enumerate(documents.STYLES):
        documents.write_documents(points.where(F.col("document") == f"m{k}"), str(tmp_path), style)
    documents.write_documents(points.where("document = 'm0'").withColumn("value", F.lit(-1.0)), str(tmp_path), "lower")  # beside its CSV
    got = documents.read_documents(spark, str(tmp_path))
    assert got.exceptAll(points).count() == 0 and points.exceptAll(got).count() == 0
    said = documents.json_results(spark.createDataFrame([(1, None, "x")], "k long, a long, b string"), ["k"]).first()
    assert said.k == 1 and json.loads(said.json) == {"a": None, "b": "x"}


def test_sessions_are_whole_or_absent(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    make = lambda n, ts, c="c": spark.range(n).select("id", F.lit(c).alias("cluster_id"), F.lit(ts).cast("long").alias("session_ts"))
    assert sessions.clusters(spark, root) == [] and sessions.load(spark, root, "c") is None
    sessions.save(make(3, 10).union(make(4, 20)).union(make(2, 5, "d")).union(make(9, None)), root)
    assert sessions.load(spark, root, "c").count() == 4 and sessions.load(spark, root, "c", 10).count() == 3
    before = sessions.load(spark, root, "c", 10)  # a reader that began before the session was replaced
    sessions.save(make(30, 10), root)
    assert before.count() == 3 and sessions.load(spark, root, "c", 10).count() == 30
    assert sessions.delete(spark, root, "c", 20) and not sessions.delete(spark, root, "c", 20)
    assert sorted(map(tuple, sessions.sessions(spark, root).collect())) == [("c", 10, True), ("d", 5, True)]
    assert sessions.delete(spark, root, "d", 5) and sessions.clusters(spark, root) == ["c"]
    assert sessions.swept(spark, root) == 3 and sessions.load(spark, root, "c").count() == 30


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    row = lambda ts: spark.range(2).select("id", F.lit("c").alias("cluster_id"), F.lit(ts).cast("long").alias("session_ts"))
    sessions.save(row(0).union(row(1)).union(row(2)), root)
    errors, seen = [], []

    def work(k):
        try:
            if k < 3:
                assert sessions.delete(spark, root, "c", k)
            elif k < 9:
                sessions.save(row(k), root)
            else:
                for _ in range(10):
                    for ts in list(sessions.index(spark, root, "c")[1]):
                        rows = sessions.load(spark, root, "c", ts)
                        seen.append(rows is None or rows.count())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    version, own = sessions.index(spark, root, "c")
    assert not errors and sorted(own) == [3, 4, 5, 6, 7, 8] and version == 10
    assert seen and set(seen) <= {True, 2}
    # of two writers on one base only one makes the version
    assert sessions._publish(spark, root, "c", 11, own) and not sessions._publish(spark, root, "c", 11, {})


def test_results_are_read_again_until_inputs_change(spark, tmp_path):
    root, source = f"{tmp_path}/cache", f"{tmp_path}/source"
    spark.range(10).write.parquet(source)
    ask = lambda now, part="a": results.cached(spark.read.parquet(source).selectExpr("sum(id) AS s"), root, "total", part, ttl=100, now=now)
    first = ask(1000.0)
    assert first.first().s == 45
    again = ask(1050.0)
    assert sorted(again.inputFiles()) == sorted(first.inputFiles()) and all("/cache/" in f for f in again.inputFiles())
    assert ask(1050.0, "b").inputFiles() != first.inputFiles()  # other parameters
    late = ask(1100.0)
    assert late.inputFiles() != first.inputFiles()  # expired
    spark.range(5).write.mode("append").parquet(source)
    assert ask(1101.0).first().s == 55
    assert results.expired(spark, root, ttl=100, now=1160.0) == 2  # the first of both parameters
    assert ask(1102.0).first().s == 55
    (tmp_path / "cache" / "torn").mkdir()
    assert results.expired(spark, f"{tmp_path}/nowhere") == 0


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 50 > 0, (F.col("id") * 37) % 101).alias("k"), "id")
    got = numbering.numbered(df, ["k", "id"], parts=7).collect()
    want = sorted(((k is not None, k or 0, i) for k, i in map(tuple, df.collect())))
    assert [(r.k or 0, r.id) for r in sorted(got, key=lambda r: r.rank)] == [(k, i) for _, k, i in want]
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 1001))
    assert numbering.numbered(df.limit(0), ["k"], parts=3).count() == 0
