"""Fixed virtual slots: records hash into thousands of slots, slots map to shards.

A record's slot never changes; only the small slot-to-shard map does. The map is a versioned table
of ``n_slots`` rows, built from the bytes each slot holds and edited (never rebuilt) when shards are
added or grow uneven, so a rebalance moves as few slots as it can.

Defined results: a null key hashes like any value (all columns of ``keys`` count, so rows with a null
id still spread by their other keys); a null text counts one byte; an empty table gives an empty
result; rows equal in every key share a slot; extra columns pass through.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import expiring, shared_folder

N_SLOTS = 4096
#: Copies of a row that one task makes at a time.
BLOCK = 10_000
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("vslot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("slot_rows", T.LongType(), False),
        T.StructField("slot_bytes", T.LongType(), False),
        T.StructField("first_place", T.LongType(), False),
    ]
)


def slot_of(keys: Sequence[Column], n_slots: int = N_SLOTS) -> Column:
    """The fixed virtual slot of a record."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_stats(slotted: DataFrame, size: str, slot: str = "vslot") -> pd.DataFrame:
    """Rows and bytes per slot. At most ``n_slots`` rows reach the driver, whatever the input."""
    got = slotted.groupBy(slot).agg(F.count(F.lit(1)).alias("slot_rows"), F.sum(size).cast("long").alias("slot_bytes")).toPandas()
    return got.rename(columns={slot: "vslot"}).sort_values("vslot").reset_index(drop=True)


def build_map(stats: pd.DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> pd.DataFrame:
    """Version 1 of the map: the heaviest slot goes to the lightest shard, again and again."""
    full = pd.DataFrame({"vslot": range(n_slots)}).merge(stats, on="vslot", how="left").fillna(0).astype("int64")
    heap, shard = [(0, 0, s) for s in range(n_shards)], {}
    for slot, rows, size in full.sort_values(["slot_bytes", "vslot"], ascending=[False, True])[["vslot", "slot_rows", "slot_bytes"]].itertuples(index=False):
        held, n, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (held + size, n + rows, s))
    return _placed(full.assign(shard=full.vslot.map(shard), version=1))


def rebalance(old: pd.DataFrame, stats: pd.DataFrame, n_shards: int) -> pd.DataFrame:
    """The next version: slots move from shards above the mean to shards below it, largest fitting slot first.

    Slots of shards that no longer exist move too. A slot moves only if that lowers the distance to the mean.
    """
    now = old[["vslot", "shard"]].merge(stats, on="vslot", how="left").fillna(0).astype("int64")
    held = [0] * n_shards
    for s, size in now[["shard", "slot_bytes"]].itertuples(index=False):
        if s < n_shards:
            held[s] += size
    mean = now.slot_bytes.sum() / n_shards
    shard = dict(zip(now.vslot, now.shard, strict=True))
    for slot, s, size in now.sort_values(["slot_bytes", "vslot"], ascending=[False, True])[["vslot", "shard", "slot_bytes"]].itertuples(index=False):
        to = min(range(n_shards), key=held.__getitem__)
        gone = s >= n_shards
        if gone or (size and held[s] - size >= mean and held[to] + size <= mean + size / 2):
            shard[slot] = to
            held[to] += size
            if not gone:
                held[s] -= size
    return _placed(now.assign(shard=now.vslot.map(shard), version=int(old.version.max()) + 1))


def _placed(full: pd.DataFrame) -> pd.DataFrame:
    """Add the first place of each slot within its shard (slots of a shard in ascending order)."""
    full = full.sort_values(["shard", "vslot"])
    full["first_place"] = full.groupby("shard").slot_rows.cumsum() - full.slot_rows
    return full[MAP_SCHEMA.names]


def new_path(spark: SparkSession) -> str:
    """A place for a map that goes when the session's process ends."""
    return expiring(spark, f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map table at ``path``, none if there is no table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(folder) if x.getPath().getName().startswith("version="))


def store_map(spark: SparkSession, slot_map: pd.DataFrame, path: str) -> int:
    """Add the map to the map table as its next version, which is returned.

    A version is a folder written once: a second writer of the same version fails and none is stored twice.
    """
    version = max(versions(spark, path), default=0) + 1
    made = spark.createDataFrame(slot_map.assign(version=version).astype({"version": "int32", "vslot": "int32", "shard": "int32"})[MAP_SCHEMA.names], MAP_SCHEMA)
    made.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest unless one is named."""
    version = max(versions(spark, path)) if version is None else version
    return spark.read.schema(T.StructType(MAP_SCHEMA.fields[1:])).parquet(f"{path}/version={version}").withColumn("version", F.lit(version)).select(*MAP_SCHEMA.names)


def place(slotted: DataFrame, slot_map: DataFrame, order: Sequence[str], slot: str = "vslot") -> DataFrame:
    """Add ``shard`` and the record's gapless ``slot`` number within it.

    Rows equal in all columns are counted before they move, so that a row that a third of the table repeats is one
    row of its slot: distinct rows are numbered there by a running sum of the counts (a small share of the rows,
    sorted with spill), shifted by the slot's first place, and become rows again in blocks of ``BLOCK`` that are
    dealt to all tasks. The map has one row per virtual slot, which bounds the broadcast.
    """
    grouped = not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in slotted.schema.fields)  # these have no equality
    n = F.count(F.lit(1)).alias("__tm_n")
    rows = slotted.groupBy(*slotted.columns).agg(n) if grouped else slotted.withColumn("__tm_n", F.lit(1).cast("long"))
    window = Window.partitionBy(slot).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__tm_nth", F.coalesce(F.sum("__tm_n").over(window), F.lit(0)))
    m = slot_map.select(F.col("vslot").alias("__tm_vslot"), F.col("shard"), F.col("first_place").alias("__tm_first"))
    rows = rows.join(F.broadcast(m), F.col(slot) == F.col("__tm_vslot")).withColumn("__tm_nth", F.col("__tm_nth") + F.col("__tm_first"))
    rows = rows.withColumn("__tm_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tm_n") - 1, F.lit(BLOCK).cast("long"))))
    rows = rows.repartition("shard", "__tm_nth", "__tm_block")
    last = F.least(F.col("__tm_block") + BLOCK, F.col("__tm_n")) - 1
    rows = rows.withColumn("__tm_copy", F.explode(F.sequence("__tm_block", last)))
    return rows.withColumn("slot", F.col("__tm_nth") + F.col("__tm_copy")).select(*slotted.columns, "shard", "slot")


def shard_records(df: DataFrame, n_shards: int, keys: Sequence[str], size: Column, n_slots: int = N_SLOTS, keep: Sequence[str] = (), map_path: str | None = None) -> DataFrame:
    """Assign every row to a shard by bytes, with the map that is stored at ``map_path``.

    Without a map there the first version is built; otherwise the latest one is edited for the rows' present sizes
    and stored as the next. Rows are placed by what is read back. Of equal rows any may have any of their places.
    """
    spark = df.sparkSession
    slotted = df.select(*dict.fromkeys([*keep, *keys]), size.cast("long").alias("size"), slot_of([F.col(k) for k in keys], n_slots).alias("vslot"))
    stats = slot_stats(slotted, "size")
    path = map_path or new_path(spark)
    known = versions(spark, path)
    slot_map = rebalance(load_map(spark, path).toPandas(), stats, n_shards) if known else build_map(stats, n_shards, n_slots)
    return place(slotted, load_map(spark, path, store_map(spark, slot_map, path)), [*keys, "size"])


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder per shard; every shard may have several files, none is held in memory."""
    placed.repartition("shard", "vslot").write.partitionBy("shard").parquet(path)
