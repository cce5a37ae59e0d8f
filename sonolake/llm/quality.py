"""Quality rules with cross-document line frequency (native).

Base rules look at one text. The method looks across documents: lines are normalised (lower case, single spaces) and hashed,
distinct documents are counted per host (the source column), lines above the host's limit are removed, and a document that is
depleted by that is rejected. Documents with equal texts count once, so that a group of copies does not make its own lines look
like boilerplate. Lines of any length count: only their hashes are dealt out. With carrier, the host's first document that has a
line keeps it.

Nulls: a null text has no words and fails the base rules; a null source is a host of its own; null doc_ids never carry a line.
Rows are matched by (doc_id, text hash), null-safe, so repeated rows get equal verdicts. Empty tables give empty results; other
columns are carried on by clean(), whatever their names. Windows of one text are compared by 64-bit hashes inside that text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import SPACE, cut, whole, with_text, words

WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """A line is above its host's limit if more than docs_floor distinct documents of the host have it, and more than share of the
    host's distinct documents or more than docs_most of them. A document that lost lines is depleted if fewer than left_words words, or
    less than left_share of its words, are left. carrier: the host's first document keeps its lines."""

    docs_floor: int = 5
    share: float = 0.02
    docs_most: int = 1000
    left_words: int = 15
    left_share: float = 0.2
    carrier: bool = False


LIMITS = Limits()


def window_hashes(w: str) -> Column:
    """A hash for each window of five words of the array column w."""
    windows = f"transform(slice({w}, 1, greatest(size({w}) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {', '.join(f'{w}[i + {k}]' for k in range(1, WINDOW))}))"
    return F.expr(windows)


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    kept = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"_w": words(F.col("text"))})
    d = d.withColumns({"_g": window_hashes("_w"), "_l": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # places of windows that stand twice: neighbours with equal hashes in the sorted (hash, place) list
    d = d.withColumn("_s", F.expr("sort_array(transform(if(size(array_distinct(_g)) = size(_g), slice(_g, 1, 0), _g), (h, i) -> struct(h, i)))"))
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h or x.h = get(_s, k + 1).h), x -> x.i))"))
    n = F.size("_w").cast("long")
    repeated = F.expr(f"aggregate(transform(_p, (x, k) -> if(k = 0, {WINDOW}, least({WINDOW}, x - _p[k - 1]))), 0L, (a, x) -> a + x)")
    d = d.withColumns(
        {
            "n_words": n,
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeated,
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def based(narrow: DataFrame) -> DataFrame:
    """doc_id, source, key and the base columns, written: a filter pushed below the projections would repeat their array expressions
    inside each other."""
    return cut(base_columns(narrow).withColumn("key", text_key(F.col("text"))).drop("text"), "quality-base")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, host, line (hash), line_words: the lines of each row that have a word, repeats too."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("source").alias("host"), F.explode(F.split("text", "\n", -1)).alias("l"))
    lines = lines.withColumn("w", F.size(words(F.col("l")))).where("w > 0")
    return lines.select("doc_id", "key", "host", F.xxhash64(normalised(F.col("l"))).alias("line"), F.col("w").cast("long").alias("line_words"))


def frequent_lines(lines: DataFrame, docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """host, line, carrier for each line above its host's limit; carrier is the host's first document that has it."""
    seen = lines.groupBy("host", "line", "key").agg(F.min("doc_id").alias("first")).groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("carrier")).where(F.col("n_docs") > limits.docs_floor)
    hosts = docs.groupBy(F.col("source").alias("host"), text_key(F.col("text")).alias("key")).count().groupBy("host").agg(F.count("*").alias("host_docs"))
    above = (F.col("n_docs") > limits.share * F.col("host_docs")) | (F.col("n_docs") > limits.docs_most)
    return seen.join(hosts.withColumnRenamed("host", "_host"), F.expr("host <=> _host")).where(above).select("host", "line", "carrier")


def removals(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, key, removed_words, removed_lines (hashes) of the rows that lose lines."""
    lines = hashed_lines(docs)
    often = frequent_lines(lines, docs, limits).withColumnsRenamed({"host": "_host", "line": "_line"})
    lost = "host <=> _host and line = _line" + (" and not doc_id <=> carrier" if limits.carrier else "")
    hit = lines.join(often, F.expr(lost)).select("doc_id", "key", "host", "line", "line_words")
    # repeated rows bring the same lines again: a line's words per row are its total over the number of such rows
    rows = docs.groupBy(F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"), F.col("source").alias("_host")).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    per = hit.groupBy("doc_id", "key", "host").agg(F.sum("line_words").alias("words"), F.collect_set("line").alias("lines"))
    return per.join(rows, F.expr("doc_id <=> _id and key = _key and host <=> _host"), "left").select("doc_id", "key", "host", (F.col("words") / F.coalesce("n_rows", F.lit(1))).cast("long").alias("removed_words"), F.col("lines").alias("removed_lines"))


def verdicts(base: DataFrame, lost: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """base (doc_id, key, source, n_words, base_failed, ...) with removed_words, removed_lines and kept."""
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("host").alias("_host"), "removed_words", "removed_lines")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < limits.left_words) | (left < limits.left_share * F.col("n_words")))
    joined = base.join(lost, F.expr("doc_id <=> _id and key = _key and source <=> _host"), "left")
    return joined.select(*base.columns, removed.alias("removed_words"), "removed_lines", (~F.col("base_failed") & ~depleted).alias("kept"))


def digest(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    narrow = docs.select("doc_id", "source", "text")
    base = based(narrow)
    return verdicts(base, removals(narrow, limits), limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def clean(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The kept rows with docs' own columns; lines above their host's limit are taken out of the text, n_chars follows."""
    narrow = docs.select("doc_id", "source", "text")
    flags = cut(verdicts(based(narrow), removals(narrow, limits), limits).select("doc_id", "key", F.col("source").alias("host"), "removed_lines", "kept"), "verdicts")
    kept = flags.where("kept").dropDuplicates(["doc_id", "key", "host"]).withColumnsRenamed({"doc_id": "_id", "key": "_key", "host": "_host"})
    d = whole(docs, "doc_id", "source", "text").withColumn("key", text_key(F.col("text"))).join(kept, F.expr("doc_id <=> _id and key = _key and source <=> _host"))
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("removed_lines", F.xxhash64(normalised(x))))
    row = with_text(F.col("row"), F.array_join(left, "\n"), F.col("removed_lines").isNotNull(), dict(docs.dtypes).get("n_chars"))
    return d.select(row.alias("row")).select("row.*")
