"""Sample files chosen by the time range in their names, before any of them is opened.

A file or its folder is named ``<start>_<end>`` (``2024-01-01_00-00-00_2024-01-02_00-00-00``). Names are listed through
Hadoop's file system, so any store that Spark reads will do, and only names come to the driver. Files whose range
meets the wanted one become the scan's input; where none does, those of the newest range do. Samples outside of the
wanted range go in the scan's filter.

Defined results: names without a range are always read, as nothing is known of them; a range whose end lies before its
start is read as no range; without files: no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.prom import NAME_RANGE, read_text


@dataclass(frozen=True)
class Ranged:
    path: str
    start: int | None
    end: int | None


def range_of(path: str) -> tuple[int, int] | tuple[None, None]:
    """Epoch seconds of the last range in a path."""
    found = re.findall(NAME_RANGE, path)
    if not found:
        return None, None
    try:
        start, end = (int(datetime.strptime(x, "%Y-%m-%d_%H-%M-%S").replace(tzinfo=UTC).timestamp()) for x in found[-1])
    except ValueError:
        return None, None
    return (start, end) if start <= end else (None, None)


def range_name(start: str, end: str):
    """The name of a range between two timestamp columns."""
    said = lambda c: F.date_format(c, "yyyy-MM-dd_HH-mm-ss")
    return F.concat(said(start), F.lit("_"), said(end))


def listed(spark: SparkSession, folder: str) -> list[Ranged]:
    """Files below a folder with the ranges in their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        one = files.next()
        if one.getLen() and not one.getPath().getName().startswith(("_", ".")):
            name = one.getPath().toString()
            out.append(Ranged(name, *range_of(name)))
    return out


def chosen(files: list[Ranged], start: int, end: int) -> tuple[list[Ranged], bool]:
    """The files to open, and whether they are those of the newest range because none meets the wanted one."""
    known = [f for f in files if f.start is not None]
    unknown = [f for f in files if f.start is None]
    meet = [f for f in known if f.start <= end and f.end >= start]
    if meet or unknown or not known:
        return meet + unknown, False
    newest = max((f.end, f.start) for f in known)
    return [f for f in known if (f.end, f.start) == newest], True


def read_range(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """METRIC rows between ``start`` and ``end``, or all of the newest range, with ``newest`` to tell."""
    files, newest = chosen(listed(spark, folder), start, end)
    if not files:
        return spark.createDataFrame([], "metric string, labels map<string,string>, ts timestamp, value double, file string, newest boolean")
    rows = read_text(spark, [f.path for f in files], *((None, None) if newest else (start, end)))
    return rows.withColumn("newest", F.lit(newest))
