"""Trailing order statistics: median and median absolute deviation of the rows before each row.

The window is kept sorted while rows come and go, so a row costs two searches in it and one for the deviation, not two
sorts. Rows are numbered along (keys, order) and worked on in blocks of that order, each with the rows before it that
its first windows reach back to: a task's share is the same whether it holds part of one series or many small ones.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.numbering import numbered

#: Rows of one block.
BLOCK = 1 << 14


class SortedWindow:
    """The last ``size`` values in order of coming and in order of size; a null or NaN takes a place but has no value."""

    def __init__(self, size: int):
        self.size, self.came, self.sorted = size, deque(), []

    def add(self, value: float | None) -> None:
        value = None if value is None or value != value else value
        self.came.append(value)
        if value is not None:
            insort(self.sorted, value)
        if len(self.came) > self.size:
            gone = self.came.popleft()
            if gone is not None:
                del self.sorted[bisect_left(self.sorted, gone)]

    def median(self) -> float | None:
        """The lower median."""
        return self.sorted[(len(self.sorted) - 1) // 2] if self.sorted else None

    def deviation(self) -> float | None:
        """The lower median of the distances to the median.

        The k + 1 nearest values are neighbours in the window, so it is the least reach of any k + 1 neighbours. From
        left to right their reach below the median falls and that above rises: the least is where they cross.
        """
        s = self.sorted
        if not s:
            return None
        k, middle = (len(s) - 1) // 2, self.median()
        low, high = 0, len(s) - 1 - k
        while low < high:
            at = (low + high) // 2
            if middle - s[at] > s[at + k] - middle:
                low = at + 1
            else:
                high = at
        reach = lambda at: max(middle - s[at], s[at + k] - middle)
        return min(reach(at) for at in (low - 1, low) if at >= 0)


def _trailing(keys: Sequence[str], value: str, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, rows = None, None, SortedWindow(window)
        for b in batches:
            made = []
            columns = [b.column(k).to_pylist() for k in ("__tm_block", *keys)]
            for key, v in zip(zip(*columns, strict=True), b.column(value).to_pylist(), strict=True):
                if key != now:
                    now, rows = key, SortedWindow(window)
                made.append((len(rows.came), rows.median(), rows.deviation()))
                rows.add(v)
            out = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            got = pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "before", "med", "dev"])
            yield got.filter(got.column("__tm_own"))

    return work


def trailing(df: DataFrame, keys: Sequence[str], window: int, order: Sequence[str] = ("ts", "value"), value: str = "value", block: int = BLOCK) -> DataFrame:
    """``df`` with the number of rows ``before`` each (``window`` at most), their lower median ``med`` and the lower median
    ``dev`` of their distances to it.

    Nulls and NaN take a place in the window but have no value; without values both are null. Rows that tie in the whole
    order come in any order; null keys are a key of their own; an empty table gives no rows.
    """
    block = max(block, window)
    rows = numbered(df.withColumn(value, F.col(value).cast("double")), [*keys, *order], "__tm_place").withColumn("__tm_place", F.col("__tm_place") - 1)
    home = F.floor(F.col("__tm_place") / block)
    reaches = F.when(F.col("__tm_place") % block >= block - window, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("__tm_block", F.explode(reaches)).withColumn("__tm_own", F.col("__tm_block") == home)
    rows = rows.repartition("__tm_block").sortWithinPartitions("__tm_block", "__tm_place")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (("before", T.IntegerType()), ("med", T.DoubleType()), ("dev", T.DoubleType())))])
    return rows.mapInArrow(_trailing(keys, value, window), schema).drop("__tm_place", "__tm_block", "__tm_own")
