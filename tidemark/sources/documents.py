"""Stored metrics in whatever shape they were written: CSV where there is one, else a JSON document of either kind.

A document is a folder ``document=<name>/kind=<csv|json>`` as ``write_documents`` makes it, or a file
``<name>.csv`` or ``<name>.json``. JSON is read as ``VARIANT``, so one scan takes lists of points with keys in lower or
upper case, range-query responses with numbers as numbers or texts, and mixtures of them. Names are letters, digits and
``._-``. Only names come to the driver.

Defined results: where a document has both kinds, its JSON is not opened; a document that is no JSON, or has no points,
gives no rows; a point without a time goes; a value that is missing or no number is 0; a CSV's head is a line without a
time; ``series`` is the id in a CSV and the place in a response, 0 for a list of points. A JSON document is one value
and so one row of the scan: a metric of one session, which its sampling bounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.ranged import listed

POINTS = "document string, series long, ts timestamp, value double"
NAME = r"document=([\w.-]+)/|([\w.-]+)\.(?:csv|json)$"
STYLES = ("csv", "lower", "upper", "response")


def kind_of(path: str) -> str | None:
    found = re.search(r"/kind=(csv|json)/|\.(csv|json)$", path)
    return (found[1] or found[2]) if found else None


def name_of(path: str) -> str | None:
    found = re.search(NAME, path)
    return (found[1] or found[2]) if found else None


def chosen(paths: list[str]) -> tuple[list[str], list[str]]:
    """CSV files, and JSON files of documents that have no CSV."""
    known = [(name_of(p), kind_of(p), p) for p in sorted(paths)]
    csv = {name for name, kind, _ in known if kind == "csv"}
    return [p for name, kind, p in known if name and kind == "csv"], [p for name, kind, p in known if name and kind == "json" and name not in csv]


def _name() -> Column:
    path = F.col("_metadata.file_path")
    return F.coalesce(*[F.nullif(F.regexp_extract(path, NAME, k), F.lit("")) for k in (1, 2)])


def _either(point: Column, paths: tuple[str, ...], type_: str) -> Column:
    return F.coalesce(*[F.try_variant_get(point, path, type_) for path in paths])


def _at(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


def parsed(rows: DataFrame) -> DataFrame:
    """(document, series, ts, value) of ``document`` and a JSON ``text``."""
    rows = rows.select("document", F.try_parse_json("text").alias("v"))
    response = F.transform(F.try_variant_get("v", "$.data.result", "array<variant>"), lambda s: F.try_variant_get(s, "$.values", "array<variant>"))
    plain = F.try_variant_get("v", "$", "array<variant>")
    rows = rows.select("document", F.posexplode(F.coalesce(response, F.when(plain.isNotNull(), F.array(plain)))).alias("series", "points"))
    rows = rows.select("document", F.col("series").cast("long").alias("series"), F.explode("points").alias("p"))
    at = _either(F.col("p"), ("$.timestamp", "$.Timestamp", "$[0]"), "double")
    value = _either(F.col("p"), ("$.value", "$.Value", "$[1]"), "double")
    return rows.select("document", "series", _at(at).alias("ts"), F.coalesce(value, F.lit(0.0)).alias("value")).where("ts is not null")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document, series, ts, value) of all documents below a folder."""
    csv, json = chosen([f.path for f in listed(spark, folder)])
    out = spark.createDataFrame([], POINTS)
    if csv:
        lines = spark.read.schema("id long, at double, value double").csv(csv)
        lines = lines.select(_name().alias("document"), F.col("id").alias("series"), _at(F.col("at")).alias("ts"), F.coalesce("value", F.lit(0.0)).alias("value"))
        out = out.unionByName(lines.where("ts is not null"))
    if json:
        whole = spark.read.text(json, wholetext=True).select(_name().alias("document"), F.col("value").alias("text"))
        out = out.unionByName(parsed(whole))
    return out


def first_series(points: DataFrame) -> DataFrame:
    """The points of each document's first series that has any."""
    first = points.groupBy("document").agg(F.min("series").alias("series"))
    return points.join(first, ["document", "series"], "left_semi")


def json_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json) of any table: each row's other columns as one JSON object, nulls kept."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("json"))


def document_texts(points: DataFrame, style: str) -> DataFrame:
    """(document, kind, text) of (document, series, ts, value): lines of a CSV, or one JSON text a document."""
    at = F.unix_micros("ts") / 1e6
    if style == "csv":
        return points.select("document", F.lit("csv").alias("kind"), F.concat_ws(",", F.col("series").cast("string"), at.cast("string"), F.col("value").cast("string")).alias("text"))
    if style == "response":
        pair = F.struct(at.alias("t"), F.col("value").cast("string").alias("v"))
        own = points.groupBy("document", "series").agg(F.array_sort(F.collect_list(pair)).alias("p"))
        text = F.concat(F.lit('{"values":['), F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["t"].cast("string"), F.lit(',"'), x["v"], F.lit('"]'))), ","), F.lit("]}"))
        own = own.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("series", text.alias("text")))).alias("s"))
        text = F.concat(F.lit('{"data":{"result":['), F.array_join(F.col("s.text"), ","), F.lit("]}}"))
        return own.select("document", F.lit("json").alias("kind"), text.alias("text"))
    t, v = ("timestamp", "value") if style == "lower" else ("Timestamp", "Value")
    own = points.groupBy("document").agg(F.array_sort(F.collect_list(F.struct(at.alias(t), F.col("value").alias(v)))).alias("p"))
    return own.select("document", F.lit("json").alias("kind"), F.to_json("p").alias("text"))


def write_documents(points: DataFrame, folder: str, style: str) -> None:
    """Add documents in one of ``STYLES``; a list of points holds one series."""
    rows = document_texts(points, style)
    rows = rows if style == "csv" else rows.repartition("document")
    rows.write.mode("append").partitionBy("document", "kind").text(folder)
