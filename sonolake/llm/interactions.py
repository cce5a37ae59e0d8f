"""Interaction audit of five document filters, with duplicates found behind a counting Bloom filter.

Filters: A too few words, B too few distinct words, C too many capitals, D odd symbols, E a text that a smaller doc_id has too. A to D look at one text
each and stay in the JVM. For E, every text adds one to HASHES counters of a counting Bloom filter. Each task sums its own sketch (the partial
aggregate, a row per counter that it touched), the sketches are merged by addition, and of the merged one a bit per counter is kept: counted
twice or more. A text with any counter at one is guaranteed unique; only possible repeats are shuffled, and there the smallest doc_id of
each full text is found exactly. The flags then come together as a mask per document, masks are counted per part, and all figures of all orders
of the filters are sums over at most 32 counts: the audit costs no further pass over documents.

The sketch has COUNTERS_PER_TEXT counters a text and MAX_COUNTERS at most, a proven bound of its broadcast (MAX_COUNTERS / 8 bytes). Beyond
MAX_COUNTERS / COUNTERS_PER_TEXT texts it clears fewer of them, so that more are shuffled; results stay exact. A text that a third of all rows share is one row per
task after the partial aggregate, and its rows meet their smallest id under salts.

A null text is empty, and empty texts are repeats of each other. E compares rows with a doc_id: a row without one is never a repeat, nor the
original of one; rows that share doc_id and text (repeated rows) are no repeats of each other. A null source is the part ''. A document has a
label if any row of labels says so. Very long texts are whole keys and whole word lists, in memory that is linear in them. Extra columns are ignored; an empty table
gives an empty audit.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import SPACE, cut, spread_salts

FILTERS = "ABCDE"
HASHES = 4
COUNTERS_PER_TEXT = 16
#: Counters of a block: HASHES slices of 16 bits of one hash name a text's counters in its block.
BLOCK = 1 << 16
#: 2 to the 28 bits are 32 MB.
MAX_COUNTERS = 1 << 28
SALTS = 64


def text_flags(text: Column) -> Column:
    """The mask of the filters A to D (bits 0 to 3) that a text fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)).cast("long"), F.char_length(text).cast("long")
    capitals = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 50, distinct * 100 < n.cast("long") * 65, capitals * 100 > chars * 5, text.rlike("[#$%&*|]")]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def counter(text: Column, k: int) -> Column:
    """The k-th counter of a text in its block."""
    return F.shiftrightunsigned(F.xxhash64(text, F.lit(1)), 16 * k).bitwiseAND(BLOCK - 1)


def repeat_bits(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, bits (array<long> of BLOCK bits) of the merged sketch of docs, and the number of blocks; a bit is set where the counter has
    two or more. A block that is missing has none."""
    rows = docs.agg(F.count("*")).first()[0]
    blocks = min(MAX_COUNTERS, COUNTERS_PER_TEXT * max(1, rows) + BLOCK - 1) // BLOCK
    own = F.array_distinct(F.array(*[counter(F.col("text"), k) for k in range(HASHES)]))
    touched = docs.select(block_of(F.col("text"), blocks).alias("block"), F.explode(own).alias("c"))
    merged = touched.groupBy("block", "c").agg(F.count("*").alias("n")).where("n > 1")
    words = merged.groupBy("block", F.expr("c div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits"))
    zeros = words.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCK // 64 - 1).cast("long"))).alias("w"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionByName(zeros).groupBy("block", "w").agg(F.bit_or("bits").alias("bits"))
    return dense.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("x")).select("block", F.col("x.bits").alias("bits")), blocks


def block_of(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")


def with_repeats(docs: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """docs with repeat: false where the sketch proves the text unique."""
    seen = [F.getbit(F.get("bits", (counter(F.col("text"), k) / 64).cast("int")), (counter(F.col("text"), k) % 64).cast("int")) == 1 for k in range(HASHES)]
    near = docs.withColumn("block", block_of(F.col("text"), blocks)).join(F.broadcast(bits), "block", "left")
    return near.withColumn("repeat", F.coalesce(seen[0] & seen[1] & seen[2] & seen[3], F.lit(False)) & F.col("doc_id").isNotNull()).drop("block", "bits")


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic. Rows without a doc_id are salted, so that they don't meet in one task."""
    given = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")).where("is_good or is_toxic")
    keyed = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "salt": F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.hash("part", "mask", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0)})
    return keyed.join(given.withColumn("salt", F.lit(0)), ["id", "salt"], "left").withColumns({"good": F.coalesce("is_good", F.lit(False)), "toxic": F.coalesce("is_toxic", F.lit(False))}).drop("id", "salt", "is_good", "is_toxic")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits 0 to 4: A to E), good, toxic, n: the documents that fail exactly the filters of mask."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits, blocks = repeat_bits(own.select("text"))
    bits = cut(bits, "sketch")
    text = F.col("text")
    flagged = with_repeats(own, bits, blocks).select("doc_id", "part", text_flags(text).alias("mask"), F.when(F.col("repeat"), address(text)).alias("address"))
    rows = cut(labelled(flagged, labels), "flags")
    # texts move here only, one row per task and text
    first = with_repeats(own.select("doc_id", "text"), bits, blocks).where("repeat").groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select(address(text).alias("address"), "first", "n"), "originals")
    total = rows.agg(F.count("*").alias("total"))
    hot = first.join(F.broadcast(total), F.col("n") * 1000 > F.col("total")).select("address", F.lit(True).alias("hot"))  # under 1,000 rows
    salted = rows.where("address is not null").join(F.broadcast(hot), "address", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    met = salted.join(spread_salts(first.drop("n"), hot, "address", SALTS), ["address", "salt"], "left")
    late = met.select("part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"), "good", "toxic")
    return rows.where("address is null").select("part", "mask", "good", "toxic").unionByName(late).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from masks(): all figures are sums over the counts of at most 32 masks."""
    sums = {f"{name}": F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & use, F.col("n"))), F.lit(0)) for m in range(32)]) for name, use in (("n", F.lit(True)), ("g", F.col("good")), ("t", F.col("toxic")))}
    steps = [{"filter_order": "".join(o), "step": i + 1, "f": 1 << FILTERS.index(x), "before": sum(1 << FILTERS.index(y) for y in o[:i])} for o in itertools.permutations(FILTERS) for i, x in enumerate(o)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, f: int, before: int>>")
    rows = counts.groupBy("part").agg(*[v.alias(k) for k, v in sums.items()]).select("part", *sums, F.explode(listed).alias("s")).select("part", *sums, "s.*")
    over = lambda cells, which: F.expr(f"aggregate(sequence(0, 31), 0L, (a, m) -> a + if({which}, {cells}[m], 0L))")
    fails, free = "(m & f) <> 0", "(m & before) = 0"
    return rows.select(
        "part", "filter_order", "step", over("n", f"(m & (before | f)) = 0").alias("kept"), over("n", f"{fails} and {free}").alias("removed"), over("n", f"{fails} and not {free}").alias("redundant"),
        F.expr("n[f]").alias("unique_fails"), over("g", f"{fails} and {free}").alias("good_lost"), over("t", f"{fails} and {free}").alias("toxic_lost"),
        # of the orders, one in bit_count(m) has this filter first among those that a document fails
        F.expr(f"aggregate(sequence(1, 31), 0L, (a, m) -> a + if({fails}, n[m] * (120 div bit_count(m)), 0L))").alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs, labels))
