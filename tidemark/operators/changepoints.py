"""Change points and forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import label, ratio
from tidemark.operators.detectors import by_time, whole
from tidemark.operators.grouped import per_series, seasonal_period

CHANGEPOINT = "series_id string, idx int, ts timestamp, mean_before double, mean_after double, std_before double, std_after double, confidence double, method string"


def _points(pdf: pd.DataFrame, got: list[tuple[int, float]], method: str, reach: int = 10) -> pd.DataFrame:
    v, rows = pdf.value.to_numpy(), []
    for k, confidence in got:
        a, b = v[max(0, k - reach) : k], v[k : k + reach]
        rows.append((pdf.series_id[0], k, pdf.ts[k], a.mean() if len(a) else np.nan, b.mean(), a.std() if len(a) else np.nan, b.std(), confidence, method))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGEPOINT.split(", ")])


def cusum(df: DataFrame) -> DataFrame:
    """Two-sided CUSUM with slack sigma / 2 and limit 2 sigma; ten points apart."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, got = pdf.value.to_numpy(), []
        m, s = (v.mean(), v.std()) if len(v) >= 20 else (0.0, 0.0)
        if s > 0:
            up = down = 0.0
            last = -10
            for k, x in enumerate(v):
                up, down = max(0.0, up + x - m - s / 2), max(0.0, down + m - x - s / 2)
                if (up > 2 * s or down > 2 * s) and k - last >= 10 and k > 0:
                    got.append((k, float(abs(v[k : k + 10].mean() - v[max(0, k - 10) : k].mean()) / s)))
                    last, up, down = k, 0.0, 0.0
        return _points(pdf, got, "cusum")

    return per_series(df, work, CHANGEPOINT)


def pelt_cuts(v: np.ndarray, penalty: float, least: int = 10, longest: int | None = None) -> list[int]:
    """Optimal segmentation by squared error with a penalty per segment, pruned."""
    n = len(v)
    s1, s2 = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    best, back, starts = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for e in range(least, n + 1):
        usable = starts[(e - starts >= least) & ((e - starts <= longest) if longest else True)]
        if len(usable):
            cost = best[usable] + (s2[e] - s2[usable]) - (s1[e] - s1[usable]) ** 2 / (e - usable) + penalty
            k = int(np.argmin(cost))
            best[e], back[e] = cost[k], usable[k]
            drop = usable[cost - penalty > best[e]]
            starts = np.setdiff1d(starts, drop) if longest is None else starts
        starts = np.append(starts, e)
    cuts, e = [], n
    while e > 0 and back[e] > 0:
        e = back[e]
        cuts.append(int(e))
    return cuts[::-1]


def pelt(df: DataFrame, max_segment: int | None = None) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        cuts = pelt_cuts(v, 3 * v.var() * np.log(len(v)), longest=max_segment) if len(v) >= 20 and v.var() > 0 else []
        s = v.std() if len(v) else 1.0
        return _points(pdf, [(k, float(abs(v[k : k + 10].mean() - v[k - 10 : k].mean()) / s)) for k in cuts], "pelt")

    return per_series(df, work, CHANGEPOINT)


def window_t(df: DataFrame, size: int = 10) -> DataFrame:
    """(series_id, ts, idx, t) of the two windows that meet at each point: plain windows, no Python."""
    left, right = by_time().rowsBetween(-size, -1), by_time().rowsBetween(0, size - 1)
    rows = df.withColumn("idx", F.row_number().over(by_time()) - 1).withColumn("n", F.count(F.lit(1)).over(whole()))
    pooled = F.sqrt((F.var_pop("value").over(left) + F.var_pop("value").over(right)) / 2)
    t = F.abs(F.avg("value").over(right) - F.avg("value").over(left)) / F.when(pooled > 0, pooled) / (2 / size) ** 0.5
    return rows.withColumn("t", t).where(f"idx >= {size} and idx <= n - {size} and n >= {3 * size}").select("series_id", "ts", "idx", "value", "t")


def sliding_window(df: DataFrame, limit: float = 2.0, skip: int = 5) -> DataFrame:
    """Greedy: after a hit the next ``skip`` points are passed over."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, got, k = pdf.value.to_numpy(), [], 10
        while len(v) >= 30 and k <= len(v) - 10:
            a, b = v[k - 10 : k], v[k : k + 10]
            pooled = np.sqrt((a.var() + b.var()) / 2)
            t = abs(b.mean() - a.mean()) / pooled / np.sqrt(0.2) if pooled > 0 else 0.0
            if t > limit:
                got.append((k, float(t / 2)))
                k += skip
            k += 1
        return _points(pdf, got, "window")

    return per_series(df, work, CHANGEPOINT)


def e_divisive(df: DataFrame, most: int = 10, scaled: bool = True) -> DataFrame:
    """Recursive best splits by squared between-group distance."""

    def best(v: np.ndarray) -> tuple[int, float]:
        n = len(v)
        s1, s2 = np.cumsum(v), np.cumsum(v * v)
        k = np.arange(5, n - 4)
        a1, a2, b1, b2 = s1[k - 1], s2[k - 1], s1[-1] - s1[k - 1], s2[-1] - s2[k - 1]
        n1, n2 = k, n - k
        stat = (n2 * a2 + n1 * b2 - 2 * a1 * b1) / n
        stat = stat - (a2 - a1**2 / n1 + b2 - b1**2 / n2) if scaled else stat
        j = int(np.argmax(stat))
        return int(k[j]), float(stat[j])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, got, todo = pdf.value.to_numpy(), [], [(0, len(pdf))]
        var = v.var() if len(v) else 0.0
        while todo and len(got) < most:
            a, b = todo.pop(0)
            if b - a < 20 or var == 0:
                continue
            k, stat = best(v[a:b])
            limit = 1.645 * np.sqrt(b - a) * 0.5 * (var if scaled else 1.0)
            if stat > limit:
                got.append((a + k, stat / limit))
                todo += [(a, a + k), (a + k, b)]
        return _points(pdf, sorted(got), "e_divisive")

    return per_series(df, work, CHANGEPOINT)


def all_change_points(df: DataFrame, most: int = 10) -> DataFrame:
    """The best of every ten places, ``most`` of them per series."""
    union = cusum(df).unionByName(pelt(df)).unionByName(sliding_window(df)).unionByName(e_divisive(df))
    bucket = Window.partitionBy("series_id", F.floor(F.col("idx") / 10)).orderBy(F.col("confidence").desc(), "method")
    union = union.withColumn("k", F.row_number().over(bucket)).where("k = 1")
    top = Window.partitionBy("series_id").orderBy(F.col("confidence").desc(), "idx")
    return union.withColumn("k", F.row_number().over(top)).where(F.col("k") <= most).drop("k")


# forecasts --------------------------------------------------------------------------------------------------

def _steps(df: DataFrame, horizon: int, method: str, prediction: Column, half: Column) -> DataFrame:
    rows = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = rows.withColumn("prediction", prediction).withColumn("half", half)
    return out.select("series_id", F.lit(method).alias("method"), "step", "prediction", (F.col("prediction") - F.col("half")).alias("lower"), (F.col("prediction") + F.col("half")).alias("upper"), *[F.col(c) for c in ("mae", "rmse", "mape")])


def _errors(actual: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE and MAPE in percent against one prediction; zero values don't count in the last."""
    e = F.abs(actual - predicted)
    return [F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.coalesce(F.avg(F.when(actual != 0, e / F.abs(F.when(actual != 0, actual)))), F.lit(0.0)) * 100).alias("mape")]


def moving_average(df: DataFrame, window: int = 5, horizon: int = 24, z: float = 1.96) -> DataFrame:
    rows = df.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ts").desc())))
    rows = rows.withColumn("p", F.avg(F.when(F.col("back") <= window, F.col("value"))).over(whole()))
    got = rows.groupBy("series_id").agg(F.max("p").alias("p"), F.stddev_pop("value").alias("s"), *_errors(F.col("value"), F.col("p")))
    return _steps(got, horizon, "sma", F.col("p"), z * F.col("s") * F.sqrt(1 + (F.col("step") - 1) / window))


def linear(df: DataFrame, horizon: int = 24, z: float = 1.96) -> DataFrame:
    rows = df.withColumn("x", (F.row_number().over(by_time()) - 1).cast("double"))
    fit = rows.groupBy("series_id").agg(F.regr_slope("value", "x").alias("b"), F.regr_intercept("value", "x").alias("a"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.regr_sxx("value", "x").alias("sxx"))
    rows = rows.join(fit, "series_id").where("n >= 3").withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    got = rows.groupBy("series_id", "a", "b", "n", "mx", "sxx").agg(F.sqrt(F.sum((F.col("value") - F.col("p")) ** 2) / (F.max("n") - 2)).alias("se"), *_errors(F.col("value"), F.col("p")))
    x = F.col("n") + F.col("step") - 1
    return _steps(got, horizon, "linear", F.col("a") + F.col("b") * x, z * F.col("se") * F.sqrt(1 + 1 / F.col("n") + (x - F.col("mx")) ** 2 / F.col("sxx")))


def seasonal_naive(df: DataFrame, period: int = 24, horizon: int = 24, z: float = 1.96) -> DataFrame:
    rows = df.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ts").desc())))
    last = rows.where(F.col("back") <= period)
    got = last.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct((period - F.col("back")).alias("k"), "value"))).alias("season"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == period)
    got = got.withColumn("p", F.get(F.col("season"), F.lit(min(horizon, period) - 1))["value"])
    errors = rows.join(got.select("series_id", "p"), "series_id").groupBy("series_id").agg(*_errors(F.col("value"), F.col("p")))
    got = got.join(errors, "series_id")
    return _steps(got, horizon, "seasonal_naive", F.get(F.col("season"), (F.col("step") - 1) % period)["value"], z * F.col("s"))


def exponential(df: DataFrame, alpha: float = 0.2, beta: float | None = None, horizon: int = 24, z: float = 1.96) -> DataFrame:
    """Simple exponential smoothing, or Holt's with ``beta``: folds over the ordered array, no Python."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"].cast("double"))
    got = df.groupBy("series_id").agg(values.alias("v")).where(F.size("v") >= 2)
    zero = F.lit(0.0)
    first = F.struct(F.get("v", F.lit(0)).alias("l"), (F.get("v", F.lit(1)) - F.get("v", F.lit(0)) if beta is not None else zero).alias("t"), zero.alias("s1"), zero.alias("s2"), zero.alias("ab"), zero.alias("pc"), zero.alias("nz"))

    def step(a: Column, x: Column) -> Column:
        e = x - (a["l"] + a["t"])
        level = alpha * x + (1 - alpha) * (a["l"] + a["t"])
        trend = beta * (level - a["l"]) + (1 - beta) * a["t"] if beta is not None else F.lit(0.0)
        share = F.when(x != 0, F.abs(e) / F.abs(F.when(x != 0, x))).otherwise(0.0)
        return F.struct(level.alias("l"), trend.alias("t"), (a["s1"] + e).alias("s1"), (a["s2"] + e * e).alias("s2"), (a["ab"] + F.abs(e)).alias("ab"), (a["pc"] + share).alias("pc"), (a["nz"] + (x != 0).cast("double")).alias("nz"))

    got = got.withColumn("f", F.aggregate(F.slice("v", 2, F.size("v") - 1), first, step)).withColumn("n", (F.size("v") - 1).cast("double"))
    f, n = F.col("f"), F.col("n")
    got = got.select("series_id", f["l"].alias("l"), f["t"].alias("t"), F.sqrt(F.greatest(zero, f["s2"] / n - (f["s1"] / n) ** 2)).alias("s"), (f["ab"] / n).alias("mae"), F.sqrt(f["s2"] / n).alias("rmse"), (ratio(f["pc"], f["nz"]) * 100).alias("mape"))
    k = F.col("step")
    half = z * F.col("s") * (F.sqrt(1 + 0.1 * k) if beta is not None else F.sqrt(1 + k * alpha * alpha))
    return _steps(got, horizon, "holt" if beta is not None else "ses", F.col("l") + k * F.col("t"), half)


def auto(df: DataFrame, horizon: int = 24) -> DataFrame:
    """Per series the method its variation, season and trend call for."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series_id": [pdf.series_id[0]], "period": [seasonal_period(pdf.value.to_numpy(), 6, 0, 0.3)]})

    periods = per_series(df, work, "series_id string, period int")
    third = F.ntile(3).over(by_time())
    stats = df.withColumn("third", third).groupBy("series_id").agg(ratio(F.stddev_pop("value"), F.avg("value")).alias("cv"), F.avg(F.when(F.col("third") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("third") == 3, F.col("value"))).alias("b"))
    chosen = stats.join(periods, "series_id").select("series_id", label((F.col("cv") < 0.1, "sma"), (F.col("cv") < 0.3, "ses"), (F.col("period") > 0, "seasonal_naive"), (F.abs(ratio(F.col("b") - F.col("a"), "a")) > 0.5, "linear"), otherwise="holt").alias("method"))
    every = moving_average(df, 5, horizon).unionByName(exponential(df, horizon=horizon)).unionByName(seasonal_naive(df, 24, horizon)).unionByName(linear(df, horizon)).unionByName(exponential(df, beta=0.1, horizon=horizon))
    return every.join(chosen, ["series_id", "method"])
