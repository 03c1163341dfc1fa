"""Writers: text samples, CSV with sidecars, sessions, compaction. Spark's committers make each write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import staged
from tidemark.sources.prom import last_written, series_key


def text_lines(rows: DataFrame) -> DataFrame:
    """(metric, line) in the text format, stamps in ms, values with all their digits; quotes and backslashes in labels
    are escaped."""
    key = series_key(F.col("labels"))
    said = series_key(F.transform_values("labels", lambda _, v: F.regexp_replace(v, r'(["\\])', r"\\$1")))
    line = F.format_string("%s{%s} %s %d", "metric", said, F.col("value").cast("string"), F.unix_millis("ts"))
    return rows.select("metric", key.alias("key"), "ts", line.alias("line"))


def write_text(rows: DataFrame, path: str) -> None:
    """One folder per metric; lines sorted by series and time within each file."""
    lines = text_lines(rows).repartition("metric", "key").sortWithinPartitions("metric", "key", "ts")
    lines.select("metric", "line").write.mode("append").partitionBy("metric").text(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """The main store: Parquet by cluster, metric and day."""
    rows.withColumn("date", F.to_date("ts")).repartition("cluster_id", "metric", "date").write.mode("append").partitionBy("cluster_id", "metric", "date").parquet(path)


def write_csv(rows: DataFrame, data: str, labels: str, bucket: bool = False) -> None:
    """Samples by a dense series id, and the labels of each id beside them. Series are numbered in the order of their
    labels, which takes one task over one row a series."""
    keyed = rows.withColumn("labels", series_key(F.col("labels")))
    ids = staged(keyed.select("labels").distinct().withColumn("id", F.row_number().over(Window.orderBy("labels")).cast("long")), "series")
    kept = ["id", *(["le"] if bucket else []), F.unix_seconds("ts").alias("ts"), "value"]
    keyed.join(ids, "labels").select(*kept).write.mode("overwrite").option("header", True).csv(data)
    ids.select("id", "labels").write.mode("overwrite").option("header", True).option("escape", '"').csv(labels)


def with_default_bound(rows: DataFrame) -> DataFrame:
    """Old bucket tables lack the bound of the total."""
    return rows.withColumn("le", F.coalesce("le", F.lit("+Inf")))


def compacted(rows: DataFrame) -> DataFrame:
    """One value per metric, series and time, the last written."""
    return last_written(rows.withColumn("key", series_key(F.col("labels"))), ["metric", "key", "ts"])


def save_session(df: DataFrame, path: str, cluster_id: str, session_ts: int) -> None:
    """A session's rows in its own partition; saving again replaces it."""
    out = df.withColumn("cluster_id", F.lit(cluster_id)).withColumn("session_ts", F.lit(session_ts))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster_id", "session_ts").parquet(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Known (cluster_id, session_ts)."""
    return spark.read.parquet(path).select("cluster_id", "session_ts").distinct()


def latest_session(spark: SparkSession, path: str, cluster_id: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("cluster_id") == cluster_id)
    last = rows.agg(F.max("session_ts").alias("session_ts"))
    return rows.join(F.broadcast(last), "session_ts")  # one row


def delete_session(spark: SparkSession, path: str, cluster_id: str, session_ts: int) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/cluster_id={cluster_id}/session_ts={session_ts}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def query_key(*parts: str):
    """Key of a cached result."""
    return F.md5(F.concat_ws("|", *[F.lit(p) for p in parts]))


MERGE_BYTES, MERGE_GAP = 500_000_000, 300


def merge_groups(files: list[tuple[str, int, int, int]], most: int = MERGE_BYTES, gap: int = MERGE_GAP) -> list[list[str]]:
    """Files (path, first second, last second, bytes) of one metric in groups of neighbours that fit together."""
    groups: list[list[str]] = []
    last = size = 0
    for path, lo, hi, n in sorted(files, key=lambda f: (f[1], f[0])):
        if groups and lo - last <= gap and size + n <= most:
            groups[-1].append(path)
            last, size = max(last, hi), size + n
        else:
            groups.append([path])
            last, size = hi, n
    return groups


def compact_files(spark: SparkSession, folder: str, out: str, most: int = MERGE_BYTES, gap: int = MERGE_GAP) -> DataFrame:
    """Rewrite a metric's Parquet samples so that small neighbouring files become one; (files, groups).

    Only file names, ranges and sizes meet on the driver: one row a file.
    """
    rows = spark.read.parquet(folder)
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__size"))
    found = at.groupBy("__file").agg(F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi"), F.max("__size").alias("n"))
    groups = merge_groups([tuple(r) for r in found.toLocalIterator()], most, gap)
    names = spark.createDataFrame([(p, k) for k, own in enumerate(groups) for p in own], "__file string, part int")
    whole = last_written(at.join(names, "__file").withColumn("key", series_key(F.col("labels"))), ["key", "ts"], "__file").drop("__file", "__size", "key")
    whole.repartition("part").sortWithinPartitions("part", "ts").write.mode("overwrite").partitionBy("part").parquet(out)
    return spark.createDataFrame([(sum(map(len, groups)), len(groups))], "files long, groups long")
