"""The anomaly pipeline: detectors, merge, stitching, evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detectors as d
from tidemark.operators import events as e
from tidemark.operators import grouped as g
from tidemark.session import staged, staged_all

#: Detectors on a load series. Users register more under their own names.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Core": d.core_all, "MAD": d.mad_anomalies, "STL": d.decomposition_anomalies, "HourlyBaseline": d.hourly_baseline, "Contextual": d.contextual, "DynamicThreshold": d.dynamic_threshold, "Volatility": d.volatility,
    "MultiScale": d.multi_scale, "EMA": g.ema_detector, "ESD": g.esd, "SHESD": g.shesd, "IsolationForest": g.isolation_forest, "SpectralResidual": g.spectral_residual, "DBSCAN": g.dbscan, "HoltWinters": g.holt_winters, "Peaks": g.peak_anomalies,
    "Ensemble": g.ensemble,
}


def register(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    DETECTORS[name] = detector


def findings(qps: DataFrame, latency: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """All detectors' findings, each tagged with its detector.

    Findings are staged by detector, several at a time: one plan of all detectors outgrows the driver, and the jobs of
    one detector seldom fill a cluster.
    """

    def tagged(name: str) -> Callable[[], DataFrame]:
        return lambda: DETECTORS[name](qps).withColumn("detected_by", F.array(F.lit(name)))

    parts = [tagged(n) for n in names or DETECTORS] + [lambda: d.raw_rolling(qps, detector="raw_qps")]
    if latency is not None:
        parts += [lambda: d.latency_anomalies(latency), lambda: d.raw_rolling(latency, "LATENCY_SPIKE", "raw_latency", latency=True), lambda: d.sustained_latency(latency)]
    return reduce(DataFrame.unionByName, staged_all(parts, "findings"))


def abnormal(qps: DataFrame, latency: DataFrame | None = None, backend: DataFrame | None = None, statements: DataFrame | None = None, storage: DataFrame | None = None, step: int = 120, names: list[str] | None = None, least_points: int = 80) -> DataFrame:
    """Validated events of every series with enough points."""
    qps = qps.withColumn("__n", F.count(F.lit(1)).over(d.whole())).where(F.col("__n") >= least_points).drop("__n")
    given = {k: v for k, v in {"qps": qps, "latency": latency, "backend": backend, "statements": statements, "storage": storage}.items() if v is not None}
    qps, latency, backend, statements, storage = map(dict(zip(given, staged_all(list(given.values()), "series"), strict=True)).get, ("qps", "latency", "backend", "statements", "storage"))
    found = findings(qps, latency, names)
    merged = e.confident(e.session_merge(found))
    single = found.where(F.exists("detected_by", lambda x: x.startswith("raw_") | (x == "sustained_latency")))
    joined = staged(e.stitched(merged.unionByName(single), step), "events")
    return e.validated(joined, qps, latency, backend, statements, storage, step)
