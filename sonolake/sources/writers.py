"""Sinks: manifests, timing files, sentences, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The columns of the benchmark table and their names in the file.
BENCHMARK = {
    "run": "Run name", "timestamp": "Timestamp", "total_utts": "Total utts", "processed_utts": "Processed utts", "latency_mean": "Mean Latency", "latency_50": "50th Percentile Latency", "latency_90": "90th Percentile Latency",
    "latency_99": "99th Percentile Latency", "wer": "WER %", "words": "Total words", "errors": "Errors", "provider": "Provider",
}


def write_manifest(df: DataFrame, path: str, arrays: bool = False) -> int:
    """JSON lines; or, for readers of whole files, each part file as one JSON array. Returns the rows written, counted as they pass."""
    written = Observation()
    df = df.observe(written, F.count(F.lit(1)).alias("rows"))
    if arrays:
        json_arrays(df).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)
    return written.get["rows"]


def json_arrays(df: DataFrame) -> DataFrame:
    """value: the lines of one JSON array per partition, an indented object per row. A partition streams through."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                out = [("  " if i or opened else "[\n  ") + x + ("," if i + 1 < len(rows) else "") for i, x in enumerate(rows)]
                out = [",", *out] if opened else out
                opened = True
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if opened:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    return df.select(F.to_json(F.struct(*df.columns)).alias("row")).mapInArrow(lines, "value string")


def ctm_lines(df: DataFrame, scored: bool = False) -> DataFrame:
    """value: a timing line per word, three decimals, two for a score."""
    line = F.format_string("%s 1 %.3f %.3f %s", "file", "start", "duration", "word")
    return df.select((F.concat_ws(" ", line, F.format_string("%.2f", "confidence")) if scored else line).alias("value"))


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("file", F.when(F.col("file").startswith(prefix), F.substring("file", len(prefix) + 1, 1 << 30)).otherwise(F.col("file")))


def write_sentences(df: DataFrame, column: str, path: str) -> None:
    """A line per row: the words of an array column, between spaces."""
    df.select(F.array_join(column, " ").alias("value")).write.mode("overwrite").text(path)


def append_benchmark(df: DataFrame, path: str) -> None:
    """Adds runs (a few rows) to a CSV table with the file's column names; only its first part has a header."""
    spark = df.sparkSession
    try:
        there = bool(spark.read.text(path).take(1))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        there = False
    df.select(*[F.col(c).alias(name) for c, name in BENCHMARK.items()]).coalesce(1).write.mode("append").option("header", not there).csv(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a benchmark table; its header line is left out."""
    d = spark.read.schema(", ".join(f"{c} string" for c in BENCHMARK)).csv(path)
    return d.where(F.col("run") != BENCHMARK["run"])


def write_report(df: DataFrame, path: str) -> None:
    """hyp, ref, wer, fname per file."""
    df.select("hyp", "ref", F.col("rate").alias("wer"), "fname").write.mode("overwrite").json(path)


def latency_report(emission: DataFrame, ends: DataFrame) -> DataFrame:
    """One row: the shares of silence and end marks, and all latencies' histogram as (value, count)."""
    shares = ends.agg(F.avg((F.col("kind") == "Silence").cast("double")).alias("sil_share"), F.avg((F.col("kind") == "EOS").cast("double")).alias("eos_share"))
    seen = emission.groupBy(F.round("latency", 3).alias("value")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("latencies"))
    return shares.join(F.broadcast(seen))
