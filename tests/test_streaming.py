"""Streams over files, to their end."""

from pyspark.sql import functions as F

from tidemark.streaming import ops


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, folder):
    rows = [("a", 1_700_000_000 + 60 * k, 10.0 if k != 40 else 99.0) for k in range(60)] + [("a", 1_700_000_000, 10.0)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), (F.col("value") + F.col("t") % 7 / 10).alias("value"))
    df.coalesce(1).write.parquet(folder)
    return lambda: spark.readStream.schema(df.schema).parquet(folder)


def test_streams(spark, tmp_path):
    read = source(spark, str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "state"))
    assert drained(spark, ops.deduplicated(read()), "dedup").count() == 60
    flagged = drained(spark, ops.ema_states(read()), "ema", "append").where("flagged").collect()
    assert any(r.value > 99 for r in flagged)
    assert drained(spark, ops.with_cooldown(read()), "cool").count() == 2
    assert drained(spark, ops.windowed(read(), "30 minutes"), "win", "update").count() >= 2
    assert drained(spark, ops.sessions(read(), "5 minutes"), "sess", "complete").count() == 1
    spark.conf.unset("spark.sql.streaming.checkpointLocation")
