"""Event-time windows over responses: sessions, sliding segments, chunks, lateness and latency. Every function takes a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.tables import running, written


def watermarked(df: DataFrame, column: str, late: str) -> DataFrame:
    """df with column as a timestamp (watermarks take no other kind) and, on a stream, a watermark."""
    d = df.withColumn(column, F.col(column).cast("timestamp"))
    return d.withWatermark(column, late) if df.isStreaming else d


def sessions(df: DataFrame, key: str, gap: str, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """key, start, stop (gap included), n: runs of events with no silence of gap or longer; the gap may differ by session kind upstream."""
    g = watermarked(df, column, late).groupBy(key, F.session_window(column, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def sliding(df: DataFrame, length: str, hop: str, column: str = "ts", late: str = "1 hour") -> DataFrame:
    g = watermarked(df, column, late).groupBy(F.window(column, length, hop).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def latency_windows(df: DataFrame, length: str, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """start, n, mean, p90 of a window's values. p90 is exact: the smallest value that is not under nine tenths of them. Over a table all
    come from a histogram of distinct values, summed in ranges, so that no task holds a window; a stream's state holds the histograms of
    its open windows."""
    d = watermarked(df, column, late)
    if df.isStreaming:
        p90 = F.expr("percentile_disc(0.9) within group (order by value)")
        g = d.groupBy(F.window(column, length).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p90.alias("p90"))
        return g.select(F.col("w.start").alias("start"), "n", "mean", "p90")
    seen = written(d.groupBy(F.window(column, length).getField("start").alias("start"), "value").agg(F.count("*").alias("c")), "histogram")
    some = seen.where("value is not null")
    mean = F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 6)
    total = some.groupBy("start").agg(F.sum("c").alias("_some"), mean.alias("mean"))
    upto = running(some, ["start"], ["value"], {"upto": "c"}).withColumn("upto", F.col("upto") + F.col("c")).join(total.select("start", "_some"), "start")
    p90 = upto.where("10 * upto >= 9 * _some").groupBy("start").agg(F.min("value").alias("p90"))
    return seen.groupBy("start").agg(F.sum("c").alias("n")).join(total.drop("_some"), "start", "left").join(p90, "start", "left")


def session_validity(df: DataFrame, key: str, order: str, kinds: tuple[str, ...] = ("partial", "final", "session_start", "session_end")) -> DataFrame:
    """key, n, valid: known kinds only, a start first and an end last."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by("kind", order).alias("_a"), F.max_by("kind", order).alias("_z"), F.bool_and(F.col("kind").isin(*kinds)).alias("_known"))
    return g.select(key, "n", (F.col("_known") & (F.col("_a") == "session_start") & (F.col("_z") == "session_end")).alias("valid"))


def terminations(df: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, kind, final_time: an end mark ends a session; else the first silence above the threshold (s); else nothing does. The earliest wins."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    d = df.withColumn("_next", F.lead("ts").over(w))
    silence = F.min(F.when(F.col("_next") - F.col("ts") > threshold, F.col("ts") + threshold))
    end = F.min(F.when(F.col("kind") == "session_end", F.col("ts")))
    g = d.groupBy(key).agg(silence.alias("_s"), end.alias("_e"))
    by_end = F.col("_e").isNotNull() & (F.col("_s").isNull() | (F.col("_e") <= F.col("_s")))
    kind = F.when(by_end, "EOS").when(F.col("_s").isNotNull(), "Silence").otherwise("Never")
    return g.select(key, kind.alias("kind"), F.round(F.when(by_end, F.col("_e")).otherwise(F.col("_s")), 6).alias("final_time"))


def lateness(df: DataFrame, key: str, every: float) -> DataFrame:
    """key, worst, late: how far events (seq in order, ts in s) fall behind one per every seconds since the key's first."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    d = df.select(key, F.col("ts"), (F.row_number().over(w) - 1).alias("_i"), F.min("ts").over(Window.partitionBy(key)).alias("_t0"))
    behind = F.col("ts") - (F.col("_t0") + F.col("_i") * every)
    return d.groupBy(key).agg(F.round(F.max(behind), 6).alias("worst"), F.count_if(behind > 0).alias("late"))
