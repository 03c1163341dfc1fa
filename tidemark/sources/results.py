"""Results kept by key: a table that was computed once is read again until its inputs change or it expires.

The key is a digest of what the caller names the computation by (a name and its parameters), the result's schema, and
path, size and time of change of every file that the result reads. The caller names the computation because a plan's
text doesn't tell it: it leaves out rows made in memory and the code of functions. A result is a folder of its own
below its key, made by Spark's committer; one without its mark of success doesn't exist for readers. Two writers of one
key make two folders of the same rows, and the newer counts.

Defined results: an input whose files change makes another key; a result at least ``ttl`` seconds old is made again; a
computation that reads no file depends on its name alone; an empty result is a result.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def inputs(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, bytes and time of change of the files that a table reads; names and numbers only."""
    out = []
    for path in sorted(df.inputFiles()):
        fs, at = _hadoop(df.sparkSession, path)
        status = fs.getFileStatus(at)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def key_of(df: DataFrame, *parts: object) -> str:
    said = json.dumps([[str(p) for p in parts], df.schema.jsonValue(), inputs(df)])
    return hashlib.md5(said.encode()).hexdigest()


def _made(spark: SparkSession, folder: str) -> list[tuple[float, str]]:
    """Whole results of a key with the times at which they were made, the oldest first."""
    fs, at = _hadoop(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((float(n.split("-")[0]), n) for n in names if fs.exists(_hadoop(spark, f"{folder}/{n}/_SUCCESS")[1]))


def cached(df: DataFrame, root: str, *parts: object, ttl: float = 86400.0, now: float | None = None) -> DataFrame:
    """``df`` as it was stored under this name, parameters and inputs, or stored now."""
    spark, now = df.sparkSession, time.time() if now is None else now
    folder = f"{root}/{key_of(df, *parts)}"
    fresh = [n for at, n in _made(spark, folder) if now - ttl < at <= now]
    if not fresh:
        fresh = [f"{now:.3f}-{uuid.uuid4().hex}"]
        df.write.parquet(f"{folder}/{fresh[0]}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{fresh[-1]}")


def expired(spark: SparkSession, root: str, ttl: float = 86400.0, now: float | None = None) -> int:
    """Delete results that are ``ttl`` seconds old, those of inputs that changed among them; how many went."""
    now, gone = time.time() if now is None else now, 0
    fs, at = _hadoop(spark, root)
    for key in [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []:
        for made, name in _made(spark, f"{root}/{key}"):
            if made <= now - ttl:
                gone += fs.delete(_hadoop(spark, f"{root}/{key}/{name}")[1], True)
    return gone
