"""Path-dependent detectors: grouped maps over one series at a time.

A group is one whole series: a state that runs along the series, or a statistic of all of it, decides here. A
series is bounded by its sampling (a year at two minutes is 262,800 points, 6 MB); a task holds one at a time. Only
finite values count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.randomcut import RandomCutForest, RandomCutTree  # noqa: F401

SCHEMA = "series_id string, type string, severity string, ts timestamp, end_ts timestamp, duration_sec int, value double, baseline double, z_score double, confidence double, detected_by array<string>, instance string, detail string"


def per_series(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to every series, sorted by time."""
    rows = df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).where("abs(value) < double('infinity')")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return work(pdf.sort_values("ts").reset_index(drop=True))

    return rows.groupBy("series_id").applyInPandas(run, schema)


def found(pdf: pd.DataFrame, at, detector: str, z, baseline, severity, kind=None) -> pd.DataFrame:
    at = np.asarray(at, int)
    v = pdf.value.to_numpy()[at]
    severity = severity if isinstance(severity, str) else np.asarray(severity, object)  # an empty list would be a column of floats
    base = np.broadcast_to(np.asarray(baseline, float), len(at)) if np.ndim(baseline) == 0 else np.asarray(baseline)[at]
    return pd.DataFrame(
        {
            "series_id": pdf.series_id.to_numpy()[at], "type": kind or np.where(v >= base, "QPS_SPIKE", "QPS_DROP"), "severity": severity, "ts": pdf.ts.to_numpy()[at], "end_ts": pd.Series([pd.NaT] * len(at), dtype="datetime64[ns]"),
            "duration_sec": 0, "value": v, "baseline": base, "z_score": z, "confidence": None, "detected_by": pd.Series([[detector]] * len(at), dtype=object), "instance": None, "detail": detector,
        }
    )


def grade(x: np.ndarray, high: float, critical: float | None = None) -> np.ndarray:
    out = np.where(x > high, "HIGH", "MEDIUM").astype(object)
    if critical is not None:
        out[x > critical] = "CRITICAL"
    return out


def grubbs(n: int, t2: float) -> float:
    """Critical value for a bounded t quantile."""
    return (n - 1) / np.sqrt(n) * np.sqrt(t2 / (n - 2 + t2)) if n > 2 else np.inf


def esd_rounds(x: np.ndarray, most: int, t2: float, robust: bool, direction: str = "both") -> list[tuple[int, float, float]]:
    """(index, statistic, critical value) of the extremes removed one by one while they stay significant."""
    left, out = np.arange(len(x)), []
    for _ in range(most):
        if len(left) < 10:
            break
        v = x[left]
        centre = np.median(v) if robust else v.mean()
        spread = 1.4826 * np.median(np.abs(v - centre)) if robust else v.std()
        if spread == 0:
            break
        d = (v - centre) / spread
        d = np.abs(d) if direction == "both" else d if direction == "pos" else -d
        k = int(np.argmax(d))
        limit = grubbs(len(v), t2)
        if d[k] <= limit:
            break
        out.append((int(left[k]), float(d[k]), float(limit)))
        left = np.delete(left, k)
    return out


def esd(df: DataFrame, share: float = 0.02) -> DataFrame:
    """Generalised ESD on the raw values."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.value.to_numpy()
        got = esd_rounds(x, max(1, int(share * len(x))), 100.0, False) if len(x) >= 10 else []
        at = [k for k, _, _ in got]
        return found(pdf, at, "ESD", [d for _, d, _ in got], float(x.mean()), ["HIGH" if d > 1.5 * c else "MEDIUM" for _, d, c in got])

    return per_series(df, work, SCHEMA)


def gaussian_smooth(x: np.ndarray, half: int) -> np.ndarray:
    d = np.arange(-half, half + 1)
    w = np.exp(-(d**2) / max(half, 1) ** 2)
    return np.convolve(x, w, "same") / np.convolve(np.ones(len(x)), w, "same")


def phase_means(x: np.ndarray, period: int) -> np.ndarray:
    means = np.array([x[k::period].mean() if len(x[k::period]) else 0.0 for k in range(period)])
    return (means - means.mean())[np.arange(len(x)) % period]


def shesd(df: DataFrame, period: int = 24, share: float = 0.02, direction: str = "both") -> DataFrame:
    """Seasonal hybrid ESD, in pieces where the series is long; one finding per half hour."""

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.value.to_numpy()
        trend = gaussian_smooth(x, period // 2)
        seasonal = phase_means(x - trend, period)
        got = esd_rounds(x - trend - seasonal, max(1, int(share * len(x))), 25.0, True, direction)
        at = [k for k, _, _ in got]
        sev = ["CRITICAL" if d > 2 * c else "HIGH" if d > 1.5 * c else "MEDIUM" for _, d, c in got]
        return found(pdf, at, "SHESD", [d for _, d, _ in got], trend + seasonal, sev)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n < 48:
            return found(pdf, [], "SHESD", [], 0.0, [])
        size = max(n // 10, 48) if n > 240 else n
        parts = [piece(pdf.iloc[k : k + size].reset_index(drop=True)) for k in range(0, n, size) if n - k >= 48]
        out = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(len(p) for p in parts) else parts[0]
        bucket = out.ts.astype("int64") // (1800 * 10**9)
        return out.sort_values("ts").loc[lambda o: ~bucket.loc[o.index].duplicated()]

    return per_series(df, work, SCHEMA)


def ema_detector(df: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Distance from an exponential mean against an exponential deviation, both updated on the way."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.value.to_numpy()
        at, zs, bases = [], [], np.zeros(len(x))
        if len(x):
            mean, dev = x[0], x.std()
            for k in range(1, len(x)):
                dev = np.sqrt(alpha * (x[k] - mean) ** 2 + (1 - alpha) * dev**2)
                mean = alpha * x[k] + (1 - alpha) * mean
                bases[k] = mean
                if k >= 10 and dev > 0 and abs(x[k] - mean) / dev > 0.9:
                    at.append(k)
                    zs.append(abs(x[k] - mean) / dev)
        return found(pdf, at, "EMA", zs, bases, grade(np.array(zs), 1.5, 2.1))

    return per_series(df, work, SCHEMA)


def _path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> np.ndarray:
    """2^(-mean path / expected path), all points at once down every tree."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    most = int(np.ceil(np.log2(max(size, 2))))
    total = np.zeros(n)
    for _ in range(trees):
        stack = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while stack:
            own, all_, depth = stack.pop()
            if depth >= most or len(own) <= 1:
                total[all_] += depth + _path_constant(len(own))
                continue
            f = rng.integers(x.shape[1])
            lo, hi = x[own, f].min(), x[own, f].max()
            if lo == hi:
                total[all_] += depth + _path_constant(len(own))
                continue
            cut = rng.uniform(lo, hi)
            a, b = x[own, f] < cut, x[all_, f] < cut
            stack += [(own[a], all_[b], depth + 1), (own[~a], all_[~b], depth + 1)]
    return 2 ** (-total / trees / _path_constant(size))


def isolation_forest(df: DataFrame, least: float = 0.6) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        if len(v) < 128:
            return found(pdf, [], "IsolationForest", [], 0.0, [])
        s = isolation_scores(np.column_stack([np.arange(len(v)) % 24, v, pdf.ts.dt.hour]).astype(float))
        at = np.flatnonzero(s > least)
        return found(pdf, at, "IsolationForest", s[at], float(np.median(v)), grade(s[at], 0.75, 0.85))

    return per_series(df, work, SCHEMA)


def ensemble(df: DataFrame, least: int = 2, least_points: int = 24) -> DataFrame:
    """Points found by ``least`` or more of MAD, ESD, isolation forest and S-H-ESD, by exact time.

    The first method in that order gives the finding; three votes make it HIGH, four CRITICAL; z is the largest.
    """
    from tidemark.operators.detectors import KEY, mad_anomalies

    enough = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_points).select(*KEY)
    df = df.join(enough, KEY, "left_semi")
    methods = [mad_anomalies, esd, isolation_forest, shesd]
    parts = [detect(df).withColumn("__k", F.lit(k)) for k, detect in enumerate(methods)]
    found_ = reduce(DataFrame.unionByName, parts)
    columns = [c for c in found_.columns if c != "__k"]
    z = F.coalesce("z_score", F.lit(0.0))
    first = F.min_by(F.struct(*columns), F.struct("__k", -z)).alias("f")
    votes = found_.groupBy("series_id", "ts").agg(first, F.count_distinct("__k").alias("votes"), F.max("z_score").alias("z"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("detected_by")))).alias("by"))
    votes = votes.where(F.col("votes") >= least)
    made = {c: F.col(f"f.{c}") for c in columns} | {
        "severity": F.when(F.col("votes") >= 4, "CRITICAL").when(F.col("votes") >= 3, "HIGH").otherwise(F.col("f.severity")),
        "z_score": F.col("z"),
        "detected_by": F.col("by"),
        "detail": F.concat(F.col("f.detail"), F.lit(" (agreement: "), F.col("votes").cast("string"), F.lit(f"/{len(methods)} methods)")),
    }
    return votes.select(*[v.alias(k) for k, v in made.items()])


def random_cut_forest(df: DataFrame, shingle: int = 4, trees: int = 20, quantile: float = 0.99) -> DataFrame:
    """Online random-cut forest on shingles; findings lie above a quantile of the scores so far."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        if len(v) < 64:
            return found(pdf, [], "RCF", [], 0.0, [])
        forest = RandomCutForest(shingle, trees)
        scores = np.array([forest.push(x) for x in v])
        limit = pd.Series(scores).expanding(32).quantile(quantile).shift(1).to_numpy()
        at = np.flatnonzero((np.arange(len(v)) >= 48) & (scores > limit) & (scores > 1))
        return found(pdf, at, "RCF", scores[at], float(np.median(v)), grade(scores[at] / np.maximum(limit[at], 1e-9), 1.5, 2.5))

    return per_series(df, work, SCHEMA)


def spectral_saliency(x: np.ndarray) -> np.ndarray:
    """Spectral residual: what is left of the log amplitude after a three-tap mean, with the phase as it was."""
    n = 1 << int(np.ceil(np.log2(len(x))))
    f = np.fft.fft(np.pad(x, (0, n - len(x))))
    amplitude = np.log(np.abs(f) + 1e-10)
    smooth = np.convolve(np.pad(amplitude, 1, "edge"), np.ones(3) / 3, "valid")
    return np.fft.ifft(np.exp(amplitude - smooth) * np.exp(1j * np.angle(f))).real[: len(x)]


def _rolling(x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    r = pd.Series(x).rolling(2 * half + 1, center=True, min_periods=1)
    return r.mean().to_numpy(), r.std(ddof=0).to_numpy()


def spectral_residual(df: DataFrame) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        n = len(v)
        if n < 128:
            return found(pdf, [], "SpectralResidual", [], 0.0, [])
        s = np.abs(spectral_saliency(v))
        mean, dev = _rolling(s, 10)
        z = np.where(dev > 0, (s - mean) / np.where(dev > 0, dev, 1), 0.0)
        limit = np.full(n, 3.0)
        for k in range(n):
            near = np.sort(z[max(0, k - 3) : k + 4])
            near = near[near > 0]
            if len(near):
                limit[k] = near[int(0.75 * len(near))] * 3
        at = np.array([k for k in range(21, n - 21) if z[k] > limit[k]], int)
        return found(pdf, at, "SpectralResidual", z[at], float(np.median(v)), grade(z[at] / limit[at], 2, 3))

    return per_series(df, work, SCHEMA)


def dbscan_labels(x: np.ndarray, eps: float = 2.0, least: int = 5, reach: int = 24) -> np.ndarray:
    """Cluster labels, -1 for noise; neighbours lie within ``eps`` and ``reach`` places, not counting the point."""
    n = len(x)
    near = [[j for j in range(max(0, k - reach), min(n, k + reach + 1)) if j != k and abs(x[j] - x[k]) <= eps] for k in range(n)]
    labels, cluster = np.full(n, -2), 0
    for k in range(n):
        if labels[k] != -2:
            continue
        if len(near[k]) < least:
            labels[k] = -1
            continue
        labels[k], queue = cluster, list(near[k])
        while queue:
            j = queue.pop()
            if labels[j] == -1:
                labels[j] = cluster
            if labels[j] == -2:
                labels[j] = cluster
                if len(near[j]) >= least:
                    queue += near[j]
        cluster += 1
    return labels


def dbscan(df: DataFrame) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        if len(v) < 20:
            return found(pdf, [], "DBSCAN", [], 0.0, [])
        m = np.median(v)
        spread = 1.4826 * np.median(np.abs(v - m)) or v.std() or 1.0
        z = (v - m) / spread
        at = np.flatnonzero(dbscan_labels(z) == -1)
        return found(pdf, at, "DBSCAN", z[at], float(m), grade(np.abs(z[at]), 3, 4))

    return per_series(df, work, SCHEMA)


def holt_winters_fit(x: np.ndarray, season: int = 24, a: float = 0.3, b: float = 0.1, g: float = 0.1) -> np.ndarray:
    """One-step forecasts; the first season is its own forecast."""
    out = x.astype(float).copy()
    level, trend = x[:season].mean(), (x[season : 2 * season].mean() - x[:season].mean()) / season if len(x) >= 2 * season else 0.0
    seasonal = list(x[:season] - level)
    for k in range(season, len(x)):
        s = seasonal[k % season]
        out[k] = level + trend + s
        was = level
        level = a * (x[k] - s) + (1 - a) * (level + trend)
        trend = b * (level - was) + (1 - b) * trend
        seasonal[k % season] = g * (x[k] - level) + (1 - g) * s
    return out


def holt_winters(df: DataFrame, season: int = 24, least: float = 3.0) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        if len(v) < 2 * season:
            return found(pdf, [], "HoltWinters", [], 0.0, [])
        fit = holt_winters_fit(v, season)
        r = v - fit
        z = np.abs(r - r.mean()) / r.std() if r.std() > 0 else np.zeros(len(v))
        at = np.flatnonzero((np.arange(len(v)) >= 2 * season) & (z > least))
        return found(pdf, at, "HoltWinters", z[at], fit, grade(z[at], 1.5 * least, 2 * least))

    return per_series(df, work, SCHEMA)


def peaks_of(x: np.ndarray, distance: int = 5) -> list[tuple[int, float, int, int, int]]:
    """(index, prominence, width, left base, right base) of strict maxima, thinned by distance."""
    got = []
    for k in np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1:
        bases = []
        for step in (-1, 1):
            j = low = k
            while 0 <= j + step < len(x):
                j += step
                low = j if x[j] < x[low] else low
                if x[j] > x[k]:
                    break
            bases.append(int(low))
        prominence = float(x[k] - max(x[bases[0]], x[bases[1]]))
        width, half = 1, x[k] - prominence / 2
        for step in (-1, 1):
            j = k
            while 0 <= j + step < len(x):
                j += step
                width += 1
                if x[j] < half:
                    break
        got.append((int(k), prominence, width, *bases))
    kept, taken = [], np.zeros(len(x) + distance, bool)
    for p in sorted(got, key=lambda p: (-p[1], p[0])):
        if not taken[p[0]]:
            kept.append(p)
            taken[max(0, p[0] - distance + 1) : p[0] + distance] = True
    return sorted(kept)


def peaks(df: DataFrame, distance: int = 5) -> DataFrame:
    """One row per peak."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        got = peaks_of(v, distance) if len(v) > 2 else []
        return pd.DataFrame([(pdf.series_id[k], k, pdf.ts[k], v[k], p, w, a, b) for k, p, w, a, b in got], columns=["series_id", "idx", "ts", "value", "prominence", "width", "left_base", "right_base"])

    return per_series(df, work, "series_id string, idx int, ts timestamp, value double, prominence double, width int, left_base int, right_base int")


def peak_anomalies(df: DataFrame) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        s = v.std()
        got = peaks_of(v) if len(v) > 2 and s > 0 else []
        at, p = [x[0] for x in got], np.array([x[1] for x in got])
        return found(pdf, at, "Peaks", (v[at] - v.mean()) / s if len(at) else [], float(v.mean()), grade(p, 3 * s, 5 * s), "QPS_SPIKE")

    return per_series(df, work, SCHEMA)


def robust_stl(df: DataFrame, period: int = 24, window: int = 7) -> DataFrame:
    """Two inner passes: cycle-subseries smoothing, a low-pass filter, then the trend; local lines with Gaussian weights."""

    def loess(x: np.ndarray) -> np.ndarray:
        half, n, out = window // 2, len(x), np.empty(len(x))
        for k in range(n):
            j = np.arange(max(0, k - half), min(n, k + half + 1))
            d = (j - k).astype(float)
            w = np.exp(-(d**2) / max(half, 1) ** 2)
            sw, sx, sxx, sy, sxy = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * x[j]).sum(), (w * d * x[j]).sum()
            den = sw * sxx - sx * sx
            out[k] = (sxx * sy - sx * sxy) / den if abs(den) > 1e-12 else sy / sw
        return out

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        trend, seasonal = np.zeros(len(v)), np.zeros(len(v))
        if len(v) >= 2 * period:
            for _ in range(2):
                cycle = np.empty(len(v))
                for p in range(period):
                    cycle[p::period] = loess((v - trend)[p::period])
                seasonal = cycle - pd.Series(cycle).rolling(window, center=True, min_periods=1).mean().to_numpy()
                trend = loess(v - seasonal)
        return pd.DataFrame({"series_id": pdf.series_id, "ts": pdf.ts, "value": v, "trend": trend, "seasonal": seasonal, "residual": v - trend - seasonal})

    return per_series(df, work, "series_id string, ts timestamp, value double, trend double, seasonal double, residual double")


def acf(x: np.ndarray, lags: range) -> np.ndarray:
    d = x - x.mean()
    den = (d * d).sum()
    return np.array([(d[k:] * d[:-k]).sum() / den if den > 0 and k < len(x) else 0.0 for k in lags])


def seasonal_period(x: np.ndarray, first: int = 4, otherwise: int = 24, least: float = 0.0) -> int:
    if len(x) < 48:
        return otherwise
    lags = range(first, min(len(x) // 2, 168))
    a = acf(x, lags)
    return int(lags[int(np.argmax(a))]) if len(a) and a.max() > least else otherwise


def seasonal_periods(df: DataFrame) -> DataFrame:
    """(series_id, period): the lag with the greatest autocorrelation, 24 where none is positive."""
    return per_series(df, lambda pdf: pd.DataFrame({"series_id": [pdf.series_id[0]], "period": [seasonal_period(pdf.value.to_numpy())]}), "series_id string, period int")


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "esd": esd, "shesd": shesd, "ema": ema_detector, "isolation_forest": isolation_forest, "random_cut_forest": random_cut_forest, "spectral_residual": spectral_residual,
    "dbscan": dbscan, "holt_winters": holt_winters, "peaks": peak_anomalies,
}
