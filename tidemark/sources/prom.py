"""Readers of metric files: text samples, range-query responses, CSV with sidecars, dimension lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_RANGE = r"(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)_(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)"
RESPONSE = "data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"


def parse_labels(text: Column) -> Column:
    """``k="v",...`` as a map; quotes may hold commas."""
    pairs = F.regexp_extract_all(text, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([^=]+)=", 1).alias("key"), F.regexp_replace(F.regexp_extract(p, r'="(.*)"$', 1), r"\\(.)", "$1").alias("value"))
    return F.map_from_entries(F.array_sort(F.array_distinct(F.transform(pairs, entry))))


def series_key(labels: Column) -> Column:
    """Labels as sorted ``k="v"`` text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")


def read_text(spark: SparkSession, path: str | list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """METRIC rows (metric, labels, ts, value, file) of the text files at ``path``, see ``parse_lines``."""
    return parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")), start, end)


def parse_lines(rows: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """METRIC rows (metric, labels, ts, value, file) of ``name{labels} value ts`` lines (value, file); stamps above 1e12 are ms.

    Lines of the query counter with a result other than OK are left out.
    """
    lines = rows.select(F.trim("value").alias("line"), "file").where("line <> '' and not startswith(line, '#')")
    got = lines.select(
        "file", F.regexp_extract("line", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1).alias("metric"), parse_labels(F.regexp_extract("line", r"^[^{ ]*\{(.*)\}", 1)).alias("labels"),
        F.expr("try_cast(regexp_extract(line, '([^ ]+) +[^ ]+$', 1) as double)").alias("value"), F.expr("try_cast(regexp_extract(line, '([^ ]+)$', 1) as double)").alias("t"),
    )
    t = F.when(F.col("t") > 1e12, F.col("t") / 1000).otherwise(F.col("t"))
    got = got.where("value is not null and t is not null").withColumn("t", t)
    got = got.where(~(F.col("metric").endswith("query_total") & (F.coalesce(F.try_element_at("labels", F.lit("result")), F.lit("OK")) != "OK")))
    if start is not None:
        got = got.where(F.col("t") >= start)
    if end is not None:
        got = got.where(F.col("t") <= end)
    return got.select("metric", "labels", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "value", "file")


def sum_labels(rows: DataFrame) -> DataFrame:
    """One series per metric: the sum of its label sets at each time."""
    return rows.groupBy("metric", "ts").agg(F.sum("value").alias("value"))


def histogram_rows(rows: DataFrame) -> DataFrame:
    """(metric, ts, le, cum); rows without ``le`` go."""
    le = F.try_element_at("labels", F.lit("le"))
    bound = F.when(le.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(le.try_cast("double"))
    return rows.where(le.isNotNull()).groupBy("metric", "ts", bound.alias("le")).agg(F.sum("value").alias("cum"))


def read_response(spark: SparkSession, path: str) -> DataFrame:
    """(metric, labels, ts, value) of range-query responses; numbers may be text, broken ones count 0."""
    rows = spark.read.schema(RESPONSE).option("multiLine", True).json(path).select(F.explode("data.result").alias("r"))
    rows = rows.select(F.col("r.metric").alias("m"), F.explode("r.values").alias("p"))
    value = F.coalesce(F.get("p", F.lit(1)).try_cast("double"), F.lit(0.0))
    return rows.select(F.coalesce(F.try_element_at("m", F.lit("__name__")), F.lit("")).alias("metric"), F.map_filter("m", lambda k, _: k != "__name__").alias("labels"), F.timestamp_micros((F.get("p", F.lit(0)).try_cast("double") * 1e6).cast("long")).alias("ts"), value.alias("value")).where("ts is not null")


def read_csv(spark: SparkSession, data: str, labels: str, bucket: bool = False) -> DataFrame:
    """Samples of a data CSV (id[, le], ts, value) with the labels of its sidecar (id, labels)."""
    rows = spark.read.schema("id long, le string, ts double, value double" if bucket else "id long, ts double, value double").option("header", True).csv(data)
    side = spark.read.schema("id long, labels string").option("header", True).option("escape", '"').csv(labels)
    side = side.select("id", parse_labels(F.col("labels")).alias("labels"))
    rows = rows.join(side, "id", "left").withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    if bucket:
        rows = rows.withColumn("le", F.when(F.coalesce("le", F.lit("+Inf")) == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double")))
    return rows


def file_ranges(names: DataFrame, column: str = "file") -> DataFrame:
    """(file, start_ts, end_ts) of files named by their range."""
    at = lambda k: F.try_to_timestamp(F.regexp_extract(column, NAME_RANGE, k), F.lit("yyyy-MM-dd_HH-mm-ss"))
    return names.select(column, at(1).alias("start_ts"), at(2).alias("end_ts")).where("start_ts is not null and end_ts is not null")


def latest_range(ranges: DataFrame) -> DataFrame:
    return ranges.orderBy(F.col("end_ts").desc(), "start_ts").limit(1)


def last_written(rows: DataFrame, keys: list[str], order: str = "file") -> DataFrame:
    """One row per key, that of the last file: a partial aggregate, no sort of the table."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return got.select(*keys, "__r.*")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, provider, region) of lines ``id (provider/region)``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return lines.select(F.regexp_extract("line", r"^(\S+)", 1).alias("cluster_id"), F.regexp_extract("line", r"\(([^/)]*)", 1).alias("provider"), F.regexp_extract("line", r"/([^)]*)\)", 1).alias("region"))


def active(clusters: DataFrame, inactive: DataFrame) -> DataFrame:
    return clusters.join(inactive, "cluster_id", "left_anti")


def read_session_json(spark: SparkSession, path: str) -> DataFrame:
    """(ts, value) of stored points whose keys may be upper or lower case."""
    rows = spark.read.text(path, wholetext=True)
    parsed = rows.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    pick = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    return parsed.select(F.timestamp_seconds(pick("timestamp", "Timestamp").cast("long")).alias("ts"), pick("value", "Value").cast("double").alias("value"))
