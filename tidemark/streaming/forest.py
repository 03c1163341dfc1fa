"""The random-cut forest carried along a stream: its trees are the state of a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.randomcut import SCORES, RandomCutForest
from tidemark.streaming.ops import _kept


def forest_stream(stream: DataFrame, shingle: int = 4, trees: int = 20, most: int = 256, late: str = "1 hour", idle: int = 7 * 86400) -> DataFrame:
    """(series_id, ts, value, score) as ``forest_scores`` gives them, batch by batch.

    Rows of a batch are taken in order of time; a row not later than the state's last one is left out, as the trees
    have moved on. Values that are null or not finite don't count. A series that is silent for ``idle`` seconds loses
    its state and starts anew. The state of a series is about 2 MB with 20 trees of 256 points of four values.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        forest, last = RandomCutForest(shingle, trees, most), float("-inf")
        if state.exists:
            kept, last = state.get
            forest = RandomCutForest.restored(bytes(kept))
        rows = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples():
            if r.ts.timestamp() > last:
                last = r.ts.timestamp()
                rows.append((key[0], r.ts, r.value, forest.push(r.value)))
        if rows:
            _kept(state, (forest.stored(), last), last, idle)
        yield pd.DataFrame(rows, columns=["series_id", "ts", "value", "score"])

    rows = stream.select("series_id", "ts", F.col("value").cast("double").alias("value")).where("ts is not null and abs(value) < double('infinity')")
    return rows.withWatermark("ts", late).groupBy("series_id").applyInPandasWithState(work, SCORES, "forest binary, last double", "append", GroupStateTimeout.EventTimeTimeout)
