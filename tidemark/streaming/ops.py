"""Structured Streaming counterparts: windows with late data, sessions, last value wins, stateful detectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, length: str = "30 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean, max and count per series and event-time window; rows later than ``late`` are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = stream.withWatermark("ts", late).groupBy("series_id", w.alias("w")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    return got.select("series_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "mean", "max", "n")


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Findings within ``gap`` of one another as one event."""
    got = stream.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("k"), F.max("value").alias("value"))
    return got.select("series_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "k", "value")


def deduplicated(stream: DataFrame, keys: tuple[str, ...] = ("series_id", "ts"), late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


EMA_OUT = "series_id string, ts timestamp, value double, baseline double, z_score double, flagged boolean"


def _kept(state: GroupState, values: tuple, last: float, idle: int) -> None:
    """Keep a state until ``idle`` seconds of event time have passed since its last row."""
    state.update(values)
    state.setTimeoutTimestamp(int(max(1000 * last, state.getCurrentWatermarkMs()) + 1000 * idle))


def ema_states(stream: DataFrame, alpha: float = 0.2, limit: float = 3.0, warm: int = 10, late: str = "1 hour", idle: int = 7 * 86400) -> DataFrame:
    """Exponential mean and deviation per series, kept as state; rows of a batch are taken in order of time.

    A row not later than the state's last one can't change it any more and is left out. A series that is silent
    for ``idle`` seconds loses its state and starts anew.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mean, dev, n, last = state.get if state.exists else (None, 0.0, 0, float("-inf"))
        rows = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples():
            if r.ts.timestamp() <= last:
                continue
            last = r.ts.timestamp()
            if mean is None:
                mean = r.value
            z = abs(r.value - mean) / dev if dev > 0 else 0.0
            rows.append((key[0], r.ts, r.value, mean, z, bool(n >= warm and z > limit)))
            dev = float(np.sqrt(alpha * (r.value - mean) ** 2 + (1 - alpha) * dev**2))
            mean = float(alpha * r.value + (1 - alpha) * mean)
            n += 1
        if mean is not None:
            _kept(state, (mean, dev, n, last), last, idle)
        yield pd.DataFrame(rows, columns=["series_id", "ts", "value", "baseline", "z_score", "flagged"])

    return stream.withWatermark("ts", late).groupBy("series_id").applyInPandasWithState(work, EMA_OUT, "mean double, dev double, n long, last double", "append", GroupStateTimeout.EventTimeTimeout)


def with_cooldown(stream: DataFrame, seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """The first finding of a series, and none again until ``seconds`` have passed; then its state goes."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (-(1 << 60),)
        rows = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples():
            t = int(r.ts.timestamp())
            if t - last >= seconds:
                rows.append((key[0], r.ts, r.value))
                last = t
        _kept(state, (last,), last, seconds)
        yield pd.DataFrame(rows, columns=["series_id", "ts", "value"])

    rows = stream.select("series_id", "ts", "value").withWatermark("ts", late)
    return rows.groupBy("series_id").applyInPandasWithState(work, "series_id string, ts timestamp, value double", "last long", "append", GroupStateTimeout.EventTimeTimeout)
