"""Registered queries of what is stored and grows: sketches, reordered and ingested streams, files chosen by range.

Every one of them first turns the whole of ``events`` into the files or chunks it works on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import randomcut, sampling, sketches
from tidemark.plans import model as m
from tidemark.session import discard, expiring, shared_folder, staged, table
from tidemark.sources import documents, ranged, results, sessions, sinks
from tidemark.streaming import forest, ingest, reorder

#: Epoch seconds of 2024-01-10, of 2024-01-12 less one, and of a time that no file holds.
FIRST, LAST, NEVER = 1704844800, 1705017599, 2000000000
HOURLY = """
    SELECT CASE WHEN event_type = 'error' THEN 'e' ELSE event_type END AS kind, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value
    FROM events GROUP BY ALL
"""


def _folder(spark: SparkSession, name: str) -> str:
    return expiring(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def sketch_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks of stored hourly sketches, and whether what they say is near the exact values.

    The events come in two batches, the second late for every hour.
    """
    path = _folder(spark, "sketches")
    rows = table(spark, folder, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")
    for batch in (0, 1):
        part = rows.where(F.pmod("event_id", F.lit(2)) == batch)
        sketches.store(sketches.summarised(part, ["event_type"], "user_id"), path, f"b{batch}")
    weeks = sketches.merged(sketches.stored(spark, path), ["event_type"], "week")
    weeks = staged(sketches.estimates(weeks, {"p50": 0.5, "p99": 0.99}), "weeks")
    exact = rows.withColumn("start", F.date_trunc("week", "ts")).join(weeks.select("event_type", "start", "p50", "p99"), ["event_type", "start"])
    share = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    exact = exact.groupBy("event_type", "start").agg(share("p50").alias("below50"), share("p99").alias("below99"), F.count_distinct("user_id").alias("users"))
    got = weeks.join(exact, ["event_type", "start"])
    return got.select(
        "event_type", F.unix_seconds("start").alias("week"), "n", "hours", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"),
        (F.abs(F.col("below50") - 0.5) <= 0.02).alias("p50_near"), (F.abs(F.col("below99") - 0.99) <= 0.02).alias("p99_near"),
        (F.abs(F.col("ids") - F.col("users")) <= 0.06 * F.col("users") + 1).alias("ids_near"),
    )


def reordered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly chunks of each event type, dealt to files at random and read as a stream: in order again, each once."""
    hours = m.events(spark, folder).groupBy(F.col("event_type").alias("series_id"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("start_s")).agg(F.count(F.lit(1)).alias("n"))
    own = hours.groupBy("series_id").agg(F.array_sort(F.collect_set("start_s")).alias("starts"))  # hours of one type
    ends = own.select("series_id", F.explode(F.arrays_zip("starts", F.slice("starts", 2, F.size("starts")).alias("next"))).alias("x"))
    ends = ends.select("series_id", F.col("x.starts").alias("start_s"), F.coalesce(F.col("x.next"), F.col("x.starts") + 3600).alias("end_s"))
    first = hours.groupBy("series_id").agg(F.min("start_s").alias("start_s"), F.lit(True).alias("first"))
    chunks = hours.join(ends, ["series_id", "start_s"]).join(first, ["series_id", "start_s"], "left").withColumn("body", F.col("n").cast("string"))
    part = F.when(F.col("first"), 0).otherwise(F.pmod(F.xxhash64("series_id", "start_s"), F.lit(6)) + 1)
    again = F.explode(F.when(F.col("n") % 5 == 0, F.array(part, F.lit(7).cast("long"))).otherwise(F.array(part.cast("long"))))  # some come twice
    source, target = _folder(spark, "chunks"), _folder(spark, "ordered")
    dealt = staged(chunks.withColumn("part", again).select("series_id", "start_s", "end_s", "body", "part"), "chunks")
    for k in range(8):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("series_id string, start_s long, end_s long, body string").option("maxFilesPerTrigger", 2).parquet(source)
    ready = reorder.ordered(stream, patience=10**9, late="400 days")
    query = ready.writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    discard(dealt, source)
    return spark.read.parquet(target).select("series_id", "place", "start_s", "end_s", F.col("body").cast("long").alias("n"))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "e").otherwise(F.col("event_type"))
    rows = m.events(spark, folder).groupBy(kind.alias("kind"), F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.select(F.lit("requests_total").alias("metric"), F.create_map(F.lit("kind"), F.col("kind")).alias("labels"), "ts", "value")


def ingested_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample files taken in twice, the second time with new and with repeated files, then compacted."""
    rows = staged(_samples(spark, folder), "samples")
    source, target, state, out = (_folder(spark, x) for x in ("files", "ingested", "checkpoint", "compact"))
    late = F.dayofmonth("ts") % 3 == 0
    old = rows.where(late).withColumn("value", -F.col("value"))  # wrong values, mended by the second delivery
    sinks.write_text(rows.where(~late).unionByName(old), source)
    ingest.ingest(spark, source, target, state)
    sinks.write_text(rows.where(late), source)
    sinks.write_text(rows.where(F.dayofmonth("ts") % 2 == 0), source)
    ingest.ingest(spark, source, target, state)
    ingest.ingest(spark, source, target, state)  # nothing new
    got = ingest.compact(spark, target, out)
    discard(rows, source, target)
    return got.select("metric", F.col("labels")["kind"].alias("kind"), F.unix_seconds("ts").alias("ts"), "value")


def ranged_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sample files, read for two days, and for a time that has none: then the newest file."""
    path = _folder(spark, "days")
    rows = _samples(spark, folder).withColumn("start", F.date_trunc("day", "ts"))
    rows = rows.withColumn("range", ranged.range_name("start", F.expr("start + interval 86399 seconds")))
    rows = rows.select("metric", "labels", "ts", "value", "range")
    lines = sinks.text_lines(rows.withColumn("metric", F.concat("range", F.lit("|"), "metric")))  # the range rides along with the name
    split = lines.select(F.split_part("metric", F.lit("|"), F.lit(1)).alias("range"), F.expr("substr(line, instr(line, '|') + 1)").alias("value"))
    split.repartition("range").write.partitionBy("range").text(path)
    parts = [ranged.read_range(spark, path, a, b).withColumn("asked", F.lit(a).cast("long")) for a, b in ((FIRST, LAST), (NEVER, NEVER + 1))]
    both = parts[0].unionByName(parts[1])
    return both.select("asked", "newest", F.col("labels")["kind"].alias("kind"), F.unix_seconds("ts").alias("ts"), "value")


def streamed_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly values scored by a forest in a stream's state, and whether each score is the one of the whole table."""
    own = m.events(spark, folder).groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
    hours = staged(own.agg(F.sum("value").alias("value")), "hours")
    source, target = _folder(spark, "hours"), _folder(spark, "scores")
    hours.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    files = sorted(ranged.listed(spark, source), key=lambda f: f.path)  # parts follow the order of time
    stream_at = _folder(spark, "arrived")
    for one in files:  # a file arrives when the one before it has been taken
        spark.read.schema(hours.schema).parquet(one.path).coalesce(1).write.mode("append").parquet(stream_at)
        stream = spark.readStream.schema(hours.schema).parquet(stream_at)
        scored = forest.forest_stream(stream, late="400 days", idle=400 * 86400)
        query = scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
    expiring(spark, target + "-state")
    table_ = randomcut.forest_scores(hours).withColumnRenamed("score", "whole")
    got = spark.read.parquet(target).join(table_.drop("value"), ["series_id", "ts"], "full")
    return got.select("series_id", F.unix_seconds("ts").alias("ts"), F.round("value", 6).alias("value"), F.coalesce(F.col("score") == F.col("whole"), F.lit(False)).alias("same"))


def sampled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty orders of every status and priority, each equally likely."""
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return sampling.sampled(rows, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 20, 42)


def weighted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty orders of every status, drawn in proportion to their prices."""
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return sampling.weighted(rows, ["o_orderstatus"], ["o_orderkey"], "o_totalprice", 50, 42).drop("o_totalprice")


def thinned_events(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the events by draw."""
    return sampling.thinned(table(spark, folder, "events").select("event_id", "user_id"), ["event_id"], 0.1, "thin")


def mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly values of every event type, each type stored in another shape, read back in one scan."""
    path = _folder(spark, "documents")
    own = m.events(spark, folder).groupBy(F.col("event_type").alias("document"), F.lit(0).cast("long").alias("series"), F.date_trunc("hour", "ts").alias("ts"))
    rows = staged(own.agg(F.round(F.sum("value"), 3).alias("value")), "points")
    for k, style in enumerate(documents.STYLES):
        documents.write_documents(rows.where(F.pmod(F.ascii("document"), F.lit(len(documents.STYLES))) == k), path, style)
    stale = rows.where(F.pmod(F.ascii("document"), F.lit(len(documents.STYLES))) == 0).withColumn("value", F.lit(-1.0))
    documents.write_documents(stale, path, "lower")  # beside a CSV, which is preferred
    discard(rows)
    got = documents.first_series(documents.read_documents(spark, path))
    return got.select("document", F.unix_seconds("ts").alias("ts"), "value")


def json_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON results, and back from them."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    said = documents.json_results(rows, ["event_id"]).select("event_id", F.try_parse_json("json").alias("v"))
    get = lambda path, type_: F.try_variant_get("v", path, type_)
    return said.select("event_id", get("$.user_id", "long").alias("user_id"), get("$.event_type", "string").alias("event_type"), get("$.value", "double").alias("value"))


def session_index(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks of every event type as sessions: saved, each first one saved again and each second one deleted; what is left."""
    root = _folder(spark, "sessions")
    week = F.unix_seconds(F.date_trunc("week", "ts"))
    rows = staged(m.events(spark, folder).select(F.col("event_type").alias("cluster_id"), week.alias("session_ts"), "value"), "rows")
    sessions.save(rows, root)
    first = sessions.sessions(spark, root).groupBy("cluster_id").agg(F.min("session_ts").alias("session_ts"))
    sessions.save(rows.join(F.broadcast(first), ["cluster_id", "session_ts"], "left_semi"), root)  # a row a cluster
    for cluster in sessions.clusters(spark, root):
        known = sorted(sessions.index(spark, root, cluster)[1])
        for second in known[1:2]:
            sessions.delete(spark, root, cluster, second)
    listed = sessions.sessions(spark, root)
    parts = [sessions.load(spark, root, r.cluster_id, r.session_ts) for r in listed.toLocalIterator()]  # a line a session
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sums = sums.groupBy("cluster_id", "session_ts").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return listed.join(sums, ["cluster_id", "session_ts"])


def cached_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of event types from a stored result, and whether asking again reads that result alone."""
    root = _folder(spark, "results")
    hours = m.events(spark, folder).groupBy("event_type", F.unix_seconds(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    first, again = (results.cached(hours, root, "hours") for _ in range(2))
    hit = sorted(first.inputFiles()) == sorted(again.inputFiles()) and all(root.split(":")[-1].lstrip("/") in x for x in again.inputFiles())
    return again.withColumn("hit", F.lit(hit))


QUERIES = {
    "mixed_documents": mixed_documents, "json_events": json_events, "session_index": session_index, "cached_hours": cached_hours,
    "streamed_forest": streamed_forest, "sampled_orders": sampled_orders, "weighted_orders": weighted_orders, "thinned_events": thinned_events,
    "sketch_weeks": sketch_weeks, "reordered_chunks": reordered_chunks, "ingested_samples": ingested_samples, "ranged_samples": ranged_samples,
}

SQL = {
    "mixed_documents": """
        SELECT event_type AS document, epoch(date_trunc('hour', ts))::BIGINT AS ts, round(sum(value), 3) AS value
        FROM events GROUP BY event_type, date_trunc('hour', ts)
    """,
    "json_events": "SELECT event_id, user_id, event_type, value FROM events",
    "session_index": """
        WITH w AS (
            SELECT event_type AS cluster_id, epoch(date_trunc('week', ts))::BIGINT AS session_ts, count(*) AS n, round(sum(value), 3) AS total
            FROM events GROUP BY event_type, date_trunc('week', ts)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY session_ts) AS k FROM w)
        SELECT cluster_id, session_ts, session_ts = max(session_ts) OVER (PARTITION BY cluster_id) AS latest, n, total FROM r WHERE k <> 2
    """,
    "cached_hours": """
        SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, true AS hit
        FROM events GROUP BY event_type, date_trunc('hour', ts)
    """,
    "streamed_forest": """
        SELECT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS ts, round(sum(value), 6) AS value, true AS same
        FROM events GROUP BY event_type, date_trunc('hour', ts)
    """,
    "sampled_orders": """
        SELECT * FROM (
            SELECT o_orderstatus, o_orderpriority, o_orderkey,
                   row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('42:=' || o_orderkey), o_orderkey) AS rank
            FROM orders
        ) WHERE rank <= 20
    """,
    "weighted_orders": """
        SELECT o_orderstatus, o_orderkey, rank FROM (
            SELECT *, row_number() OVER (
                PARTITION BY o_orderstatus ORDER BY -ln((('0x' || md5('42:=' || o_orderkey)[1:13])::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52)::DOUBLE) / o_totalprice
            ) AS rank
            FROM orders WHERE o_totalprice > 0
        ) WHERE rank <= 50
    """,
    "thinned_events": """
        SELECT event_id, user_id FROM events
        WHERE (('0x' || md5('thin:=' || event_id)[1:13])::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52)::DOUBLE < 0.1::DOUBLE
    """,
    "sketch_weeks": """
        SELECT event_type, epoch(date_trunc('week', ts))::BIGINT AS week, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours,
               round(min(value), 6) AS lo, round(max(value), 6) AS hi, true AS p50_near, true AS p99_near, true AS ids_near
        FROM events GROUP BY event_type, date_trunc('week', ts)
    """,
    "reordered_chunks": """
        WITH h AS (SELECT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS start_s, count(*) AS n FROM events GROUP BY ALL)
        SELECT series_id, row_number() OVER w - 1 AS place, start_s, coalesce(lead(start_s) OVER w, start_s + 3600)::BIGINT AS end_s, n
        FROM h WINDOW w AS (PARTITION BY series_id ORDER BY start_s)
    """,
    "ingested_samples": f"SELECT 'requests_total' AS metric, kind, epoch(ts)::BIGINT AS ts, value FROM ({HOURLY})",
    "ranged_samples": f"""
        WITH h AS ({HOURLY}), d AS (SELECT date_trunc('day', max(ts)) AS newest FROM events)
        SELECT {FIRST}::BIGINT AS asked, false AS newest, kind, epoch(ts)::BIGINT AS ts, value FROM h WHERE epoch(ts) BETWEEN {FIRST} AND {LAST}
        UNION ALL SELECT {NEVER}::BIGINT, true, kind, epoch(ts)::BIGINT, value FROM h, d WHERE ts >= d.newest
    """,
}
