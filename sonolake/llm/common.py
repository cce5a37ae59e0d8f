"""What the training-data operators share: tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.tables import shared_dir

#: Bits a key, bits that name a key, bits of a block and bits at most (32 MB) of a Bloom filter.
BLOOM_BITS, BLOOM_HASHES, BLOOM_BLOCK, BLOOM_MAX = 16, 4, 1 << 16, 1 << 28
#: Java's and SQL's class of the white space that splits words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(docs: DataFrame, *keys: str) -> DataFrame:
    """docs as one struct column named row, and copies of the key columns: what is added beside them cannot clash with docs' own names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)


def with_text(row: Column, text: Column, changed: Column, n_chars: str | None) -> Column:
    """The struct row with another text where changed; its field n_chars follows, if it has one (its type is given)."""
    new = row.withField("text", text)
    new = new.withField("n_chars", F.char_length(text).cast(n_chars)) if n_chars else new
    return F.when(changed, new).otherwise(row)


def hot_keys(rows: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """key, hot (true) of the keys that hold more than one in share of all rows: fewer than share keys, whatever the table, so that they
    can be broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") * share > F.col("total")).select(key, F.lit(True).alias("hot"))


def spread_salts(values: DataFrame, hot: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """values, a row per salt (from 0) for hot keys, for joins with rows whose hot keys have salts at random."""
    each = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return values.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(each)).drop("hot")


def bloom(keys: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """A Bloom filter of a column: block, bits (array<long>), and the number of blocks. It has BLOOM_MAX bits at most, the bound of its
    broadcast; beyond BLOOM_MAX / BLOOM_BITS keys it lets more rows through, so whoever asks it must judge those exactly."""
    blocks = min(BLOOM_MAX, BLOOM_BITS * max(1, keys.count()) + BLOOM_BLOCK - 1) // BLOOM_BLOCK
    touched = keys.select(bloom_block(key, blocks).alias("block"), F.explode(F.array(*[bloom_bit(key, k) for k in range(BLOOM_HASHES)])).alias("c"))
    words = touched.groupBy("block", F.expr("cast(c div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits"))
    zeros = words.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0), F.lit(BLOOM_BLOCK // 64 - 1))).alias("w"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionByName(zeros).groupBy("block", "w").agg(F.bit_or("bits").alias("bits"))
    return cut(dense.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("x")).select("block", F.col("x.bits").alias("bits")), name), blocks


def bloom_block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(blocks)).cast("int")


def bloom_bit(key: str, k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(4)), 16 * k).bitwiseAND(BLOOM_BLOCK - 1)


def maybe_in(rows: DataFrame, key: str, filter_: tuple[DataFrame, int], name: str) -> DataFrame:
    """rows with a boolean column name: false where the Bloom filter proves that the key is not one of its own."""
    bits, blocks = filter_
    near = rows.withColumn("_block", bloom_block(key, blocks)).join(F.broadcast(bits.toDF("_block", "_bits")), "_block", "left")
    seen = [F.getbit(F.get("_bits", (bloom_bit(key, k) / 64).cast("int")), (bloom_bit(key, k) % 64).cast("int")) == 1 for k in range(BLOOM_HASHES)]
    return near.withColumn(name, F.coalesce(seen[0] & seen[1] & seen[2] & seen[3], F.lit(False))).drop("_block", "_bits")


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space, as an array; null text has none."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def sha_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint); root is the smallest node reachable.

    Alternating large-star and small-star steps, with joins and partial aggregates only, so that a hub is never one task's list.
    Each round halves the depth of the trees, roughly; a round's result is written, which keeps plans short.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = cut(stars(now), "stars")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def join_labels(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i[k] and j[k] for all k; parent points to the smallest index of a set."""
    while len(i):
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def lookahead(items: Iterator) -> Iterator[tuple[bool, object]]:
    held, none = None, True
    for x in items:
        if not none:
            yield False, held
        held, none = x, False
    if not none:
        yield True, held
