"""Metric intervals, throughput, sweeps and cross-dataset reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.tables import ranked


def intervals(log: DataFrame, size: int) -> DataFrame:
    """key, interval, mean, max, min of every size values of a key in order of step; an incomplete last interval is left out."""
    r = ranked(log.select("key", "step", "value"), ["key"], ["step"], "_r").withColumn("interval", F.expr(f"_r div {size}"))
    return r.groupBy("key", "interval").agg(F.count("*").alias("_n"), F.round(F.avg("value"), 8).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min")).where(F.col("_n") == size).drop("_n")


def throughput(done: DataFrame, by: list[str]) -> DataFrame:
    """by, n, seconds, per_second from rows with ts in seconds."""
    g = done.groupBy(*by).agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("seconds"))
    return g.select(*by, "n", F.round("seconds", 6).alias("seconds"), F.round(F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")), 8).alias("per_second"))


def best_of(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, param, rate: the run with the least rate; the first of equals by order."""
    return runs.groupBy(*by).agg(F.min(F.struct("rate", "order", "param")).alias("_b")).select(*by, "_b.param", "_b.rate")


#: The metrics of a validation report and those that default to 0 instead of not a number.
METRICS = ("wer", "errors", "words", "latency_mean", "latency_50", "latency_90", "latency_99", "eos_share", "sil_share")
SHARES = ("eos_share", "sil_share")


def validation_report(rows: DataFrame, datasets: list[str]) -> DataFrame:
    """metric and a column per data set for METRICS, from rows (dataset, metric, value): four decimals; what is absent is not a number, or 0
    for shares. Every metric has a row."""
    every = rows.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    wide = rows.where(F.col("metric").isin(*METRICS)).groupBy("metric").pivot("dataset", datasets).agg(F.round(F.first("value"), 4))
    absent = F.when(F.col("metric").isin(*SHARES), F.lit(0.0)).otherwise(F.lit(float("nan")))
    return F.broadcast(every).join(wide, "metric", "left").select("metric", *[F.coalesce(F.col(f"`{d}`"), absent).alias(d) for d in datasets])


def crosstab(rows: DataFrame, metrics: list[str], datasets: list[str]) -> DataFrame:
    """A row per metric, a column per dataset: rows (dataset, metrics...) unpivoted and pivoted, four decimals."""
    long = rows.unpivot(["dataset"], metrics, "metric", "value")
    return long.groupBy("metric").pivot("dataset", datasets).agg(F.round(F.first("value"), 4))
