"""Reproducible samples against a plain version and their probabilities."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import sampling


def digest(x, seed):
    return hashlib.md5(f"{seed}:{'0' if x is None else f'={x}'}".encode()).hexdigest()


def test_samples_do_not_depend_on_partitions(spark):
    rows = [("hot" if k % 3 else f"s{k % 7}", k, float(k % 11)) for k in range(3000)] + [(None, 9000, 1.0), ("hot", None, 2.0), ("s1", 1, None)]
    df = spark.createDataFrame(rows, "s string, id long, w double")
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((digest(i, 7), i, w is not None, w or 0.0) for t, i, w in rows if t == s)
        want[s] = [i for _, i, _, _ in own[:25]]
    for parts in (1, 9):
        got = sampling.sampled(df.repartition(parts), ["s"], ["id"], 25, 7).orderBy("rank").collect()
        assert {s: [r.id for r in got if r.s == s] for s in want} == want
    order = lambda i, w: -math.log((int(digest(i, 7)[:13], 16) + 0.5) / 2**52) / w
    for s in want:
        own = sorted((order(i, w), i is not None, i or 0) for t, i, w in rows if t == s and w)
        got = sampling.weighted(df.where(F.col("s").eqNullSafe(F.lit(s))), [], ["id"], "w", 25, 7).orderBy("rank").collect()
        assert [r.id or 0 for r in got] == [i for _, _, i in own[:25]]
    assert [r.id for r in sampling.shuffled(df, ["id"], 3).collect()] == [i for _, i in sorted((digest(r[1], 3), r[1]) for r in rows)]
    few, more = ({r.id for r in sampling.thinned(df, ["id"], x, 3).collect()} for x in (0.1, 0.3))
    assert few < more and 0.25 < len(more) / 3000 < 0.35
    assert sampling.sampled(df.limit(0), ["s"], ["id"], 3).count() == 0


def test_weights_are_probabilities(spark):
    pdf = pd.DataFrame([(t, k, float(k)) for t in range(4000) for k in (1, 2, 5)], columns=["t", "k", "w"])
    got = sampling.weighted(spark.createDataFrame(pdf), ["t"], ["t", "k"], "w", 1).groupBy("k").count().collect()
    assert np.allclose([r["count"] / 4000 for r in sorted(got)], [1 / 8, 2 / 8, 5 / 8], atol=0.025)


def test_maps_and_odd_names_ride_along(spark):
    df = spark.sql("SELECT id, map('a', id) AS m, id AS `x.y` FROM range(40)")
    assert sampling.sampled(df, [], ["id"], 3).columns == ["id", "m", "x.y", "rank"]
    assert sampling.sampled(df, [], ["id"], 3).count() == 3
