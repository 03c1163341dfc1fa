"""Statement mix, operations, fingerprints, instances, tails, volatility: rows keyed by (series_id, key)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.stats import clamp, cv, label, ratio
from tidemark.operators.detectors import by_time, whole
from tidemark.operators.grouped import per_series

READS = ("Select", "SelectStmt")
WRITES = ("Insert", "Update", "Delete", "Replace", "InsertStmt", "UpdateStmt", "DeleteStmt", "ReplaceStmt")
#: Fixed weights of statement kinds in the complexity score.
COMPLEXITY = {"Join": 0.3, "Subquery": 0.25, "Union": 0.2, "Select": 0.1, "Insert": 0.05, "Update": 0.1, "Delete": 0.15}


def keyed_by_time() -> WindowSpec:
    return Window.partitionBy("series_id", "key").orderBy("ts")


def sql_class(kind: Column) -> Column:
    k = F.lower(kind)
    return label((k.rlike("create|alter|drop|truncate|rename"), "DDL"), (k.rlike("insert|update|delete|replace|load"), "DML"), (k.rlike("select|show|explain|desc|union|join"), "DQL"), (k.rlike("begin|commit|rollback|savepoint"), "TCL"), otherwise="Other")


def sql_pattern(kind: Column) -> Column:
    k = F.lower(kind)
    return label((k.rlike("begin|commit|rollback|insert|update|delete|replace"), "transactional"), (k.rlike("join|union|group|subquery|aggregate"), "analytical"), (k.rlike("batch|load|import"), "batch"), otherwise="interactive")


def op_class(op: Column) -> Column:
    o = F.lower(op)
    return label((o.rlike("prewrite|commit|rollback|resolve|check_txn|heart_beat"), "transaction"), (o.rlike("cop"), "coprocessor"), (o.rlike("put|delete|write|import"), "write"), (o.rlike("get|scan|read"), "read"), otherwise="other")


def mix(df: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Per key: total, mean, percent; with latency its mean and P99 in ms; zero totals go."""
    got = df.groupBy("series_id", "key").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), cv("value").alias("cv"), F.count(F.lit(1)).alias("n")).where("total > 0")
    got = got.withColumn("percent", 100 * F.col("total") / F.sum("total").over(whole()))
    if latency is not None:
        lat = latency.groupBy("series_id", "key").agg((F.avg("value") * 1000).alias("latency_mean"), (F.percentile("value", F.lit(0.99)) * 1000).alias("latency_p99"))
        got = got.join(lat, ["series_id", "key"], "left")
    return got


def read_write(df: DataFrame) -> DataFrame:
    part = lambda names: F.sum(F.when(F.col("key").isin(*names), F.col("value")).otherwise(0.0))
    got = df.groupBy("series_id").agg(part(READS).alias("r"), part(WRITES).alias("w"))
    r, w = ratio("r", F.col("r") + F.col("w")), ratio("w", F.col("r") + F.col("w"))
    return got.select("series_id", r.alias("read_ratio"), w.alias("write_ratio"), (r > 0.6).alias("read_heavy"), ((w > 0.3) | ((w > 2 * r) & (r < 0.2))).alias("write_heavy"))


def complexity(df: DataFrame) -> DataFrame:
    weight = F.coalesce(*[F.when(F.col("key").contains(k), F.lit(w)) for k, w in COMPLEXITY.items()], F.lit(0.0))
    return df.groupBy("series_id").agg(F.least(F.lit(1.0), 2 * ratio(F.sum(weight * F.col("value")), F.sum("value"))).alias("complexity"))


def balance(df: DataFrame) -> DataFrame:
    got = mix(df).groupBy("series_id").agg(F.sum((F.col("percent") / 100) ** 2).alias("h"), F.count(F.lit(1)).alias("k"))
    return got.select("series_id", F.when(F.col("k") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("h") * F.col("k"))).alias("balance"))


def write_amplification(ops: DataFrame, sql: DataFrame) -> DataFrame:
    a = ops.groupBy("series_id").agg(F.sum(F.when(F.col("key") == "kv_prewrite", F.col("value")).otherwise(0.0)).alias("p"))
    b = sql.groupBy("series_id").agg(F.sum(F.when(F.col("key").isin(*WRITES), F.col("value")).otherwise(0.0)).alias("w"))
    return a.join(b, "series_id").select("series_id", ratio("p", "w", 1.0).alias("write_amplification"))


def workload_profile(sql: DataFrame, ops: DataFrame) -> DataFrame:
    """One row per series with its transaction pattern, hotspot risk and category."""
    classes = mix(sql).withColumn("class", sql_class(F.col("key"))).groupBy("series_id").pivot("class", ["DDL", "DML", "DQL", "TCL", "Other"]).agg(F.sum("percent") / 100).fillna(0.0)
    top = mix(ops).groupBy("series_id").agg(F.max_by("key", "percent").alias("top_op"), F.max("percent").alias("top_percent"))
    out = read_write(sql).join(complexity(sql), "series_id").join(balance(sql), "series_id").join(write_amplification(ops, sql), "series_id", "left").join(classes, "series_id").join(top, "series_id", "left")
    wa, w = F.coalesce("write_amplification", F.lit(1.0)), F.col("write_ratio")
    pattern = label((w > 0.5, "write_intensive"), (F.col("read_ratio") > 0.7, "read_intensive"), (wa > 3, "high_write_amplification"), (F.col("complexity") > 0.5, "complex_queries"), (F.col("balance") > 0.7, "balanced"), otherwise="mixed")
    risk = label((F.col("top_op").isNull(), "unknown"), ((F.col("top_percent") > 80) & F.col("top_op").rlike("prewrite|commit"), "high"), (wa > 5, "high"), ((wa > 3) | (w > 0.4), "medium"), otherwise="low")
    category = label((F.col("DDL") > 0.1, "schema_intensive"), (F.col("DML") > 0.5, "write_intensive"), (F.col("DQL") > 0.7, "read_intensive"), (F.col("TCL") > 0.3, "transactional"), (F.col("complexity") > 0.3, "analytical"), otherwise="mixed")
    return out.withColumn("pattern", pattern).withColumn("hotspot_risk", risk).withColumn("category", category)


def counter_totals(df: DataFrame) -> DataFrame:
    """Per key of a counter: last minus first (negative: 0), percent, per second and per hour."""
    got = df.groupBy("series_id", "key").agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("c"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("span"))
    got = got.withColumn("count", F.greatest(F.lit(0.0), F.col("c").cast("double"))).drop("c")
    return got.withColumn("percent", 100 * ratio("count", F.sum("count").over(whole()))).withColumn("per_second", ratio("count", "span")).withColumn("per_hour", 3600 * ratio("count", "span"))


def resource_score(kind: Column, count: Column, latency_ms: Column) -> Column:
    cost = F.when(sql_class(kind) == "DDL", 5.0).when(sql_class(kind) == "DML", 2.0).when(sql_class(kind) == "DQL", 1.5).when(sql_class(kind) == "TCL", 0.5).otherwise(1.0)
    return cost * F.when(latency_ms > 100, 1.5).when(latency_ms > 50, 1.2).otherwise(1.0) * count / 1000


def fingerprints(counters: DataFrame, latency: DataFrame) -> DataFrame:
    """Statement kinds with totals, latency, flags, scores and three independent ranks."""
    lat = latency.groupBy("series_id", "key").agg((F.avg("value") * 1000).alias("latency_mean"), (F.percentile("value", F.lit(0.99)) * 1000).alias("latency_p99"))
    k = F.lower("key")
    got = counter_totals(counters).join(lat, ["series_id", "key"], "left").fillna(0.0, ["latency_mean", "latency_p99"])
    got = got.withColumn("class", sql_class(F.col("key"))).withColumn("pattern", sql_pattern(F.col("key"))).withColumn("has_join", k.contains("join")).withColumn("has_subquery", k.contains("subquery")).withColumn("has_group", k.contains("group"))
    got = got.withColumn("resource", F.least(F.lit(1.0), 0.3 * F.col("percent") / 100 + 0.4 * F.least(F.lit(1.0), F.col("latency_mean") / 1000) + 0.3 * F.least(F.lit(1.0), F.col("latency_p99") / 5000)))
    got = got.withColumn("complexity", F.least(F.lit(1.0), 0.3 * F.col("has_join").cast("int") + 0.3 * F.col("has_subquery").cast("int") + 0.2 * F.col("has_group").cast("int") + F.when(F.col("class") == "DDL", 0.4).otherwise(0.1)))
    for name, order in (("rank_count", "count"), ("rank_resource", "resource"), ("rank_p99", "latency_p99")):
        got = got.withColumn(name, F.row_number().over(Window.partitionBy("series_id").orderBy(F.col(order).desc(), "key")))
    return got


def operations(counters: DataFrame, latency: DataFrame) -> DataFrame:
    """Storage operations with category, intensity, bottleneck and the trend of their increase."""
    half = F.ntile(2).over(keyed_by_time())
    d = F.col("value") - F.lag("value").over(keyed_by_time())
    moves = counters.withColumn("d", d).withColumn("half", half).groupBy("series_id", "key").agg(F.avg(F.when(F.col("half") == 1, F.col("d"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("d"))).alias("b"))
    change = ratio(F.col("b") - F.col("a"), "a")
    moves = moves.select("series_id", "key", label((change > 0.2, "increasing"), (change < -0.2, "decreasing"), otherwise="stable").alias("trend"))
    lat = latency.groupBy("series_id", "key").agg((F.avg("value") * 1000).alias("latency_mean"), (F.percentile("value", F.lit(0.99)) * 1000).alias("latency_p99"), cv("value").alias("latency_cv"))
    got = counter_totals(counters).join(lat, ["series_id", "key"], "left").join(moves, ["series_id", "key"], "left").withColumn("category", op_class(F.col("key")))
    got = got.withColumn("intensity", F.least(F.lit(1.0), 0.5 * F.col("percent") / 100 + 0.5 * F.least(F.lit(1.0), F.coalesce("latency_mean", F.lit(0.0)) / 500)))
    return got.withColumn("bottleneck", label((F.col("latency_p99") > 1000, "latency"), (F.col("percent") > 50, "volume"), (F.col("latency_cv") > 1, "jitter"), otherwise="none")).withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy((F.col("percent") + 10 * F.coalesce("latency_cv", F.lit(0.0))).desc(), "key")))


def category_summary(ops: DataFrame) -> DataFrame:
    return ops.groupBy("series_id", "category").agg(F.sum("count").alias("count"), F.sum("percent").alias("percent"), F.avg("latency_mean").alias("latency_mean"), F.max("latency_p99").alias("latency_p99"))


def volume(counters: DataFrame) -> DataFrame:
    """Per category: mean and P99 of positive per-second increases, and the trend of the halves."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    r = counters.withColumn("v", F.col("value") - F.lag("value").over(keyed_by_time())).withColumn("dt", t - F.lag(t).over(keyed_by_time())).where("v > 0 and dt > 0").withColumn("rate", F.col("v") / F.col("dt")).withColumn("category", op_class(F.col("key")))
    r = r.withColumn("half", F.ntile(2).over(Window.partitionBy("series_id", "category").orderBy("ts", "key")))
    got = r.groupBy("series_id", "category").agg(F.avg("rate").alias("mean"), F.percentile("rate", F.lit(0.99)).alias("peak"), F.avg(F.when(F.col("half") == 1, F.col("rate"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("rate"))).alias("b"))
    change = ratio(F.col("b") - F.col("a"), "a")
    return got.withColumn("trend", label((change > 0.1, "increasing"), (change < -0.1, "decreasing"), otherwise="stable")).withColumn("saturation", label((F.col("peak") > 100_000, "high"), (F.col("peak") > 50_000, "medium"), otherwise="low")).drop("a", "b")


def instances(qps: DataFrame, latency: DataFrame) -> DataFrame:
    """Per instance: load, latency, share, rank, temperature, utilisation, health and trend."""
    w = Window.partitionBy("series_id", "instance").orderBy("ts")
    r = qps.withColumn("half", F.ntile(2).over(w)).groupBy("series_id", "instance").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum("value").alias("total"), cv("value").alias("cv"), F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("b"))
    lm = latency.withColumn("m", F.avg("value").over(Window.partitionBy("series_id", "instance")))
    lat = lm.groupBy("series_id", "instance").agg((F.avg("value") * 1000).alias("latency_mean"), (F.percentile("value", F.lit(0.99)) * 1000).alias("latency_p99"), F.sum((F.col("value") > 2 * F.col("m")).cast("int")).alias("latency_spikes"))
    got = r.join(lat, ["series_id", "instance"], "left").withColumn("all", F.avg("mean").over(whole()))
    change = ratio(F.col("b") - F.col("a"), "a")
    got = got.withColumn("share", ratio("total", F.sum("total").over(whole()))).withColumn("temperature", ratio("mean", "all")).withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("mean").desc(), "instance"))).withColumn("relative", ratio("mean", F.max("mean").over(whole())))
    got = got.withColumn("heat", label((F.col("temperature") > 1.5, "hot"), (F.col("temperature") < 0.5, "cold"), otherwise="normal")).withColumn("trend", label((change > 0.15, "increasing"), (change < -0.15, "decreasing"), otherwise="stable"))
    got = got.withColumn("utilisation", clamp(0.6 * F.least(F.lit(1.0), F.col("relative")) + 0.4 * F.least(F.lit(1.0), F.coalesce("latency_p99", F.lit(0.0)) / 1000), 0.0, 1.0))
    return got.withColumn("health", label((F.col("latency_p99") > 1000, "unhealthy"), ((F.col("latency_p99") > 500) | (F.col("cv") > 1), "degraded"), otherwise="healthy")).drop("a", "b", "all", "total")


def cluster_health(inst: DataFrame) -> DataFrame:
    share = lambda s: F.avg((F.col("health") == s).cast("double"))
    return inst.groupBy("series_id").agg(F.count(F.lit(1)).alias("instances"), share("healthy").alias("healthy"), share("degraded").alias("degraded"), clamp(100 * share("healthy") + 50 * share("degraded") - 20 * cv("mean"), 0.0, 100.0).alias("score"), F.sum((F.col("heat") == "hot").cast("int")).alias("hot"), F.sum((F.col("heat") == "cold").cast("int")).alias("cold"))


# tails, volatility, spectra ----------------------------------------------------------------------------------

def tail(df: DataFrame) -> DataFrame:
    """Tail index of the upper quantiles and a Pareto fit of what exceeds P95."""
    q = df.withColumn("q", F.percentile("value", F.lit([0.95, 0.99, 0.999])).over(whole()))
    x = F.when(F.col("value") > F.col("q")[0], F.col("value") - F.col("q")[0])
    got = q.groupBy("series_id").agg(F.max("q").alias("q"), F.count(x).alias("k"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    up, down = F.col("q")[2] - F.col("q")[1], F.col("q")[1] - F.col("q")[0]
    index = F.when((up > 0) & (down > 0), F.log10(F.when(down > 0, up / F.when(down > 0, down)))).otherwise(0.0)
    shape = F.when((F.col("k") > 10) & (F.col("v") > 0), 0.5 * (F.col("m") ** 2 / F.when(F.col("v") > 0, F.col("v")) - 1))
    return got.select("series_id", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"), F.col("q")[2].alias("p999"), index.alias("tail_index"), label((index > 1, "heavy"), (index > 0.5, "moderate"), otherwise="light").alias("tail"), shape.alias("gpd_shape"), (F.col("m") * (1 - shape)).alias("gpd_scale"))


def volatility(df: DataFrame) -> DataFrame:
    """Realised volatility of returns, its own variation, range-based estimates and the leverage correlation."""
    before = F.lag("value").over(by_time())
    r = df.withColumn("p", before).withColumn("ret", F.when(F.col("p") != 0, F.col("value") / F.when(F.col("p") != 0, F.col("p")) - 1).otherwise(F.when(F.col("p").isNotNull(), 0.0)))
    frame = by_time().rowsBetween(-10, -1)
    hi, lo = F.max("value").over(frame), F.min("value").over(frame)
    r = r.withColumn("i", F.row_number().over(by_time())).withColumn("park", F.when((lo > 0) & (F.col("i") > 10), F.log(hi / F.when(lo > 0, lo)) ** 2 / (4 * 0.6931471805599453))).withColumn("rv", F.stddev_pop("ret").over(frame)).withColumn("next", F.lead("rv").over(by_time()))
    got = r.groupBy("series_id").agg(F.stddev_pop("ret").alias("s"), F.count("ret").alias("n"), F.sqrt(F.avg("park")).alias("parkinson"), F.stddev_pop(F.when(F.col("i") > 11, F.col("rv"))).alias("vol_of_vol"), F.covar_pop("ret", "next").alias("c"), F.stddev_pop("next").alias("sn"))
    return got.select("series_id", (F.col("s") * F.sqrt("n")).alias("realised"), "parkinson", (1.1 * F.col("s") * F.sqrt("n")).alias("garman_klass"), "vol_of_vol", ratio("vol_of_vol", "s").alias("vol_ratio"), ratio("c", F.col("s") * F.col("sn")).alias("leverage"))


def spectrum(df: DataFrame, top: int = 5) -> DataFrame:
    """The strongest periods of each series, their share of the power, and flags for known cycles."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        rows = []
        if len(v) >= 64:
            n = 1 << int(np.ceil(np.log2(len(v))))
            p = np.abs(np.fft.rfft(v - v.mean(), n)) ** 2 / n**2
            p[0], half = 0.0, len(p)
            peaks = [k for k in range(1, half - 1) if p[k] > p[k - 1] and p[k] > p[k + 1]]
            names = {(23, 25): "daily", (167, 169): "weekly", (350, 380): "biweekly", (700, 760): "monthly"}
            for r, k in enumerate(sorted(peaks, key=lambda k: -p[k])[:top]):
                share, period = float(p[k] / p.sum()), n / k
                cycle = next((name for (a, b), name in names.items() if a <= period <= b and share >= 0.1), None)
                rows.append((pdf.series_id[0], r + 1, period, float(p[k]), share, cycle))
        return pd.DataFrame(rows, columns=["series_id", "rank", "period", "power", "share", "cycle"])

    return per_series(df, work, "series_id string, rank int, period double, power double, share double, cycle string")


def modes(df: DataFrame) -> DataFrame:
    """Modes of a Gaussian density estimate with their weights, where a dip walk finds several likely."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf.value.to_numpy())
        rows, n = [], len(v)
        if n >= 24 and v.std() > 0:
            grid = np.linspace(v[0], v[-1], 1000)
            width = 1.06 * v.std() * n**-0.2
            density = np.zeros(1000)
            for k in range(0, n, 4096):
                density += np.exp(-0.5 * ((grid[:, None] - v[None, k : k + 4096]) / width) ** 2).sum(1)
            at = [grid[k] for k in range(1, 999) if density[k] > density[k - 1] and density[k] > density[k + 1]] or [float(np.median(v))]
            dip = float(np.abs(np.arange(1, n + 1) / n - (v - v[0]) / (v[-1] - v[0])).max())
            reach = (v[-1] - v[0]) / 20
            rows = [(pdf.series_id[0], m, float((np.abs(v - m) <= reach).mean()), dip, len(at)) for m in at]
        return pd.DataFrame(rows, columns=["series_id", "mode", "weight", "dip", "n_modes"])

    return per_series(df, work, "series_id string, mode double, weight double, dip double, n_modes int")


def regimes(df: DataFrame) -> DataFrame:
    """Segments between changes of the rolling mean or deviation, with their statistics."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.value.to_numpy()
        cuts, rows = [0], []
        if len(v) >= 30:
            s = pd.Series(v).rolling(10)
            signals = [s.mean().to_numpy(), s.std(ddof=0).to_numpy()]
            k = 14
            while k < len(v) - 5:
                if k - cuts[-1] >= 5:
                    for x in signals:
                        a, b = x[k - 5 : k], x[k : k + 5]
                        pooled = np.sqrt((a.var() + b.var()) / 2 * 2 / 5)
                        if np.isfinite(pooled) and pooled > 0 and abs(b.mean() - a.mean()) / pooled > 2.5:
                            cuts.append(k)
                            k += 5
                            break
                k += 1
        for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(v)], strict=True)):
            if b > a:
                rows.append((pdf.series_id[0], n, pdf.ts[a], pdf.ts[b - 1], float(v[a:b].mean()), float(v[a:b].std()), b - a))
        return pd.DataFrame(rows, columns=["series_id", "regime", "start_ts", "end_ts", "mean", "std", "n"])

    return per_series(df, work, "series_id string, regime int, start_ts timestamp, end_ts timestamp, mean double, std double, n int")


def keyed(df: DataFrame, work) -> DataFrame:
    """Any operator on series, per (series_id, key)."""
    return work(df.withColumn("series_id", F.concat_ws("/", "series_id", "key")).drop("key"))
