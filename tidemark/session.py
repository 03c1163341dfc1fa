"""Session helpers shared by the batch and streaming parts of the library."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (local mode, tests) a
    temporary folder of this machine is taken.
    """
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _fallback


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone: nothing can be deleted any more
        pass


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that read its shuffle files, never
    the steps before the table. The table goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def expiring(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the session's process ends."""
    atexit.register(_delete, spark, path)
    return path


def discard(*made: DataFrame | str) -> None:
    """Delete tables that ``staged`` made, and folders, once all that was made of them is a table itself."""
    for x in made:
        if path := x if isinstance(x, str) else getattr(x, "staged_at", None):
            _delete(SparkSession.active(), path)


#: Small tables that are made at the same time.
AT_ONCE = 8


def staged_all(parts: Sequence[Callable[[], DataFrame] | DataFrame], name: str) -> list[DataFrame]:
    """``staged`` for several tables at once: jobs of small tables seldom fill a cluster, and a plan of all of them
    together can outgrow the driver. A part is a table or a function that makes it."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda part: staged(part() if callable(part) else part, name), parts))


#: Bytes of an Arrow batch that goes to Python.
BATCH = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of some ``BATCH`` bytes from now on, unless the session has a limit of its own.

    Spark's limit of 10,000 rows alone lets a batch of long texts grow to hundreds of MB; an executor holds one for each
    task, and once more in the worker. Which rows share a batch changes no result here.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
