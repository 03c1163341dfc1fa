"""Percentiles of raw values: exact however many rows a group has."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.plans import model as m


def nearest_rank(values, hundredths=99):
    v = sorted(values)
    return v[max(1, -(-hundredths * len(v) // 100)) - 1]


@pytest.mark.parametrize("by", [None, "key", "instance"])
def test_latency_of_large_groups_is_exact(spark, tmp_path, by):
    r = np.random.default_rng(7)
    n = 240_000
    value = r.random(n) * 1000
    at = 1_704_067_200 + np.arange(n) % 2 * 3600 + r.integers(0, 3600, n)
    user = r.integers(0, 3, n)
    kind = np.where(r.random(n) < 0.5, "view", "click")
    rows = pa.table({"event_id": np.arange(n), "ts": pa.array(at * 1_000_000, pa.timestamp("us")), "user_id": user, "event_type": kind, "value": value})
    (tmp_path / "events.parquet").mkdir()
    for k in range(8):  # summaries of several tasks meet
        pq.write_table(rows.slice(k * n // 8, n // 8), tmp_path / "events.parquet" / f"{k}.parquet")
    groups = {}
    for k in range(n):
        t = int(at[k]) // (86_400 if by == "instance" else 3600)
        own = () if by is None else (m.KINDS[str(kind[k])],) if by == "key" else (f"sql-{user[k]}",)
        groups.setdefault((t, *own), []).append(value[k])
    size = 86_400 if by == "instance" else 3600
    got = m.latency(spark, str(tmp_path), by).withColumn("t", (F.unix_seconds("ts") / size).cast("long")).collect()
    assert {(x.t, *([x[by]] if by else [])): x.value for x in got} == {g: nearest_rank(v) / 1000 for g, v in groups.items()}


def test_few_rows_nulls_and_null_groups(spark):
    from tidemark.operators.numbering import discrete_percentile

    data = [("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, 5.0), (None, 4.0), ("c", float("nan")), ("c", 1.0), *[("d", float(k)) for k in range(1, 101)], *[("e", 7.0)] * 300]
    got = {x.k: x.v for x in discrete_percentile(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "0.99").collect()}
    assert got.pop("c") != 1.0 and got == {"a": 2.0, "b": None, None: 5.0, "d": 99.0, "e": 7.0}
