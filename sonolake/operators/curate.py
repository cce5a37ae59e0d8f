"""Filters, validation, labels, joins and set operations over manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sonolake.tables import indexed, ranked, seeded


def where_counted(df: DataFrame, keep: Column, counts: Observation | None) -> DataFrame:
    """df where keep is true; counts, if given, has the rows read and dropped once an action on the result has run, in the same pass."""
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped"))
    return df.where(keep)


def by_length(df: DataFrame, mode: str, max_duration: float, max_chars: int, min_duration: float = 0.05, counts: Observation | None = None) -> DataFrame:
    """Utterances within limits; the three kinds of source differ in which bounds are included."""
    dur, n = F.col("duration"), F.char_length("transcript")
    rules = {
        "manifest": (dur <= max_duration) & (dur > min_duration) & (n < max_chars),
        "shard": (dur <= max_duration) & (dur >= min_duration) & (n <= max_chars),
        "hub": (dur < max_duration) & (dur > min_duration) & (n < max_chars),
    }
    return where_counted(df, rules[mode], counts)


def _lacking(df: DataFrame) -> str:
    """SQL: whether a column of a row is null, or a field of the first struct of an array of structs."""
    parts = []
    for f in df.schema.fields:
        parts.append(f"`{f.name}` is null")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            parts += [f"get(`{f.name}`, 0).`{x.name}` is null" for x in f.dataType.elementType.fields]
    return " or ".join(parts)


def complete(df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Rows without nulls, those inside the first of their files included."""
    return where_counted(df, F.expr(f"not ({_lacking(df)})"), counts)


def incomplete(df: DataFrame) -> DataFrame:
    return df.where(_lacking(df))


def with_text(df: DataFrame, work: Callable[[DataFrame], DataFrame], column: str = "transcript") -> DataFrame:
    """df with work done on the rows that have a transcript; those with white space or nothing pass by."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    done = work(df.where(~blank))
    return done.unionByName(df.where(blank), allowMissingColumns=True)


def paired(left: DataFrame, right: DataFrame, key: str, counts: Observation | None = None) -> DataFrame:
    """Rows of left and right with equal keys. counts, if given, has the rows matched and those of either side without a partner (null keys
    among them) once an action on the result has run: all come from the pass that does the join. Without counts it is an inner join, which
    Spark may broadcast; sides may share no column but the key."""
    if clash := (set(left.columns) & set(right.columns)) - {key}:
        raise ValueError(f"both sides have {sorted(clash)}")
    if counts is None:
        return left.join(right, key)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    matched, alone = F.col("_l") & F.col("_r"), lambda a, b: F.count_if(F.col(a) & F.col(b).isNull())
    both = both.observe(counts, F.count_if(matched).alias("matched"), alone("_l", "_r").alias("left_only"), alone("_r", "_l").alias("right_only"))
    return both.where(F.coalesce(matched, F.lit(False))).drop("_l", "_r")


def merged(manifests: list[DataFrame], key: str = "fname") -> DataFrame:
    """The union of manifests, in which a file may stand once: rows of repeated files are an error."""
    every = manifests[0]
    for more in manifests[1:]:
        every = every.unionByName(more)
    times = F.count("*").over(Window.partitionBy(key))
    checked = F.when(times > 1, F.raise_error(F.concat(F.lit("a file comes twice: "), F.col(key)))).otherwise(F.col(key))
    return every.withColumn("_k", checked).withColumn(key, F.col("_k")).drop("_k")


def file_names(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """labels (label, ...) with the file name of each; a label that the manifest (label, fname) lacks has none."""
    return labels.join(manifest.select("label", "fname"), "label", "left")


def coverage(expected: DataFrame, processed: DataFrame, key: str, words: str) -> DataFrame:
    """total_utts, processed_utts, processed_words; an error where nothing was processed. processed: key, words (array)."""
    done = processed.groupBy(key).agg(F.first(F.size(words)).alias("_n"))
    g = expected.select(key).distinct().join(done, key, "left").agg(F.count("*").alias("total_utts"), F.count("_n").alias("processed_utts"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("processed_words"))
    some = F.when(F.col("processed_utts") == 0, F.raise_error(F.lit("nothing was processed"))).otherwise(F.col("processed_utts"))
    return g.select("total_utts", some.cast("long").alias("processed_utts"), "processed_words")


def pending(work: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """work without what is done, the first limit by key if there is a limit."""
    left = work.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def repeated_like(values: Column, parts: Column) -> Column:
    """Each value as often as the part (an array) beside it has elements, in one array."""
    return F.flatten(F.zip_with(values, parts, lambda v, p: F.array_repeat(v, F.size(p))))


def validated(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest with reason: what is wrong with a row first, or null. files: fname, duration, num_samples as measured."""
    measured = files.select("fname", F.col("duration").alias("_d"), F.col("num_samples").alias("_n"), F.lit(True).alias("_there"))
    twice = F.count("*").over(Window.partitionBy("fname")) > 1
    reason = (
        F.when(F.col("_there").isNull(), "missing file")
        .when(F.trim("transcript") == "", "empty transcript")
        .when(F.col("duration") != F.col("_d"), "duration differs")
        .when(F.col("num_samples") != F.col("_n"), "samples differ")
        .when(twice, "duplicate file")
    )
    return manifest.join(measured, "fname", "left").withColumn("reason", reason).drop("_d", "_n", "_there")


def duplicates(df: DataFrame, key: str = "fname") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def labelled(df: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive labels from 0 in the given total order."""
    return indexed(df, order, "label")


def subset(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """From each manifest int(n * share) utterances, those with the least seeded keys."""
    keyed = df.withColumn("_key", seeded(seed, "fname"))
    size = df.groupBy("manifest").agg(F.floor(F.count("*") * share).alias("_target"))
    return ranked(keyed, ["manifest"], ["_key", "fname"], "_rank").join(size, "manifest").where("_rank < _target").drop("_key", "_rank", "_target")


def later_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in order. Maxima combine before the shuffle, so a key of many rows is no single task's list."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return last.select(key, "_r.*").select(*df.columns)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of the keys that one side has only."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def batch_guard(df: DataFrame, batch_size: int, limit: float = 1.5e5) -> DataFrame:
    """longest, product, fits: whether a batch of the longest utterances stays within the memory guard."""
    m = df.agg(F.max("duration").alias("longest"))
    return m.select("longest", (F.col("longest") * batch_size).alias("product"), (F.col("longest") * batch_size <= limit).alias("fits"))
