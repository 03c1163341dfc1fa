"""Incremental ingestion of sample files: only what is missing, exactly once, compacted afterwards.

A file stream with a checkpoint hands every new file to one micro-batch. A batch is written to a partition of its own
number, which a replay of the batch overwrites, so a crash between the write and the commit changes nothing. The same
samples in another file are dropped by compaction, which keeps for each metric, series and time the last written
value. ``missing`` says what to fetch at all.

Defined results: broken lines are left out; an empty folder gives an empty table; a file that grows after its batch is
not read again (write files under another name first and move them in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import interval_gaps
from tidemark.sources.prom import parse_lines, series_key

ROWS = "metric string, labels map<string,string>, ts timestamp, value double, file string"


def missing(requested: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Parts (start, end) of the requested ranges (start, end) that the held ones leave open."""
    return interval_gaps(requested, held, keys)


def write_batch(rows: DataFrame, target: str, number: int) -> None:
    """A batch's samples in its own partition; again with the same number: the same table."""
    out = rows.withColumn("batch", F.lit(number).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_a_batch: int = 1000, timeout: int | None = None) -> int:
    """Take in the files below ``source`` that are not yet in ``target``; the number of batches that held any."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).text(source)
    rows = parse_lines(lines.select("value", F.col("_metadata.file_path").alias("file")))
    query = rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, target, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.exception() is not None:
        raise query.exception()
    return sum(p.numInputRows > 0 for p in query.recentProgress)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{ROWS}, batch long").parquet(target)


def compact(spark: SparkSession, target: str, out: str) -> DataFrame:
    """One value per metric, series and time, that of the last batch (of a batch, the last file); written by metric and day."""
    rows = ingested(spark, target).withColumn("key", series_key(F.col("labels")))
    last = F.max_by(F.struct("value", "labels"), F.struct("batch", "file", "value")).alias("x")
    one = rows.groupBy("metric", "key", "ts").agg(last).select("metric", "x.labels", "ts", "x.value", F.to_date("ts").alias("date"))
    one.repartition("metric", "date").sortWithinPartitions("metric", "ts").write.mode("overwrite").partitionBy("metric", "date").parquet(out)
    return spark.read.parquet(out)
