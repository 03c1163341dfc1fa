"""A reorder buffer: chunks that arrive in any order leave it in order, each once.

State per series: the start of the chunk that is due, and a map of the chunks that came too early. A chunk that ends a
gap takes all that follow it along. What starts before the due time has been passed on already (or lies inside of
what has) and is left out, so repeated chunks change nothing, also across a restart from the checkpoint. If a
gap outlasts ``patience`` of event time, a timer passes the waiting chunks on in order and counts the gap.

The map holds what is out of order and nothing else, in RocksDB and not in the task's memory. A chunk without start or
series is left out; of chunks with one start the longest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDERED = "series_id string, place long, start_s long, end_s long, body string, gap_s long"
COLUMNS = [c.split()[0] for c in ORDERED.split(", ")]


class ReorderBuffer(StatefulProcessor):
    """``origin``: start of every series' first chunk; None: the least of its first batch."""

    def __init__(self, origin: int | None, patience: int) -> None:
        self.origin, self.patience = origin, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "start_s long, place long")
        self.waiting = handle.getMapState("waiting", "start_s long", "end_s long, body string")

    def _passed(self, key: tuple, due: int, place: int) -> tuple[list[tuple], int, int]:
        """Chunks that follow the due time without a gap."""
        out = []
        while self.waiting.containsKey((due,)):
            end, body = self.waiting.getValue((due,))
            self.waiting.removeKey((due,))
            out.append((key[0], place, due, end, body, 0))
            due, place = max(end, due + 1), place + 1
        return out, due, place

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, place = self.due.get() if self.due.exists() else (self.origin, 0)
        first = None
        for part in rows:
            for start, end, body in zip(part["start_s"], part["end_s"], part["body"], strict=True):
                start, end = int(start), int(end)
                if end <= start or due is not None and start < due:
                    continue
                first = start if first is None else min(first, start)
                if not self.waiting.containsKey((start,)) or self.waiting.getValue((start,))[0] < end:
                    self.waiting.updateValue((start,), (end, body))
        due = first if due is None else due
        out: list[tuple] = []
        if due is not None:
            out, due, place = self._passed(key, due, place)
            self.due.update((due, place))
            self._wait(due)
        yield pd.DataFrame(out, columns=COLUMNS)

    def _wait(self, due: int) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if any(True for _ in self.waiting.keys()):  # noqa: SIM118
            self.handle.registerTimer(1000 * (due + self.patience))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, place = self.due.get()
        out: list[tuple] = []
        starts = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118  numbers only; the chunks stay in the store
        for start in starts:
            if not self.waiting.containsKey((start,)):
                continue
            if start < due:
                self.waiting.removeKey((start,))
                continue
            more, end, after = self._passed(key, start, place)
            gap = start - due
            out.append((*more[0][:5], gap))
            out += more[1:]
            due, place = end, after
        self.due.update((due, place))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, origin: int | None = None, patience: int = 3600, late: str = "0 seconds") -> DataFrame:
    """Chunks (series_id, start_s, end_s, body) in order, each once, with its place and the gap before it.

    Event time is the end of a chunk, so the watermark tells how far the stream has come.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.where("series_id is not null and start_s is not null and end_s is not null").select("series_id", "start_s", "end_s", "body", F.timestamp_seconds("end_s").alias("ts"))
    keyed = rows.withWatermark("ts", late).groupBy("series_id")
    return keyed.transformWithStateInPandas(ReorderBuffer(origin, patience), ORDERED, "append", "EventTime")
