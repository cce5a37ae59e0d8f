"""SimHash near-dedup by bit-sliced comparison.

A text's fingerprint has a bit set where over half of the XXH64 values (seed 42) of its three-word shingles have it. Distinct
fingerprints within RADIUS bits are linked; a document's class is its fingerprint's connected component.

Candidates: the 64 bits are cut into eight parts; two fingerprints within two bits agree on at least six parts, so each one goes to
28 buckets, one per choice of six parts. A bucket's fingerprints agree on 48 bits and are distinct: no bucket can outgrow 65,536
eight-byte values, whatever the corpus and however it is skewed. Inside a bucket, blocks of 64 fingerprints are stored as vertical
bit planes; one step compares a fingerprint with 64 others, counts differences in carry-save bit counters and abandons a block once
all its members are beyond the radius. A bucket returns its links as stars: at most one row per member, never all pairs.

Nulls and empty texts have no words and fingerprint zero, linked like any other. Rows with a null doc_id get a fingerprint and a
class, but never name one unless the whole class lacks ids (then null). Equal rows stay separate rows. Empty tables give empty
results; other columns are ignored,. Very long texts are hashed in blocks of shingles, so memory does
not grow with them squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import components, cut, join_labels, lookahead

RADIUS = 2
PARTS = 8
SHINGLE = 3
_BLOCK = 64
_TASKS = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    found = (text or b"").lower().split()  # bytes: lower() changes A-Z only, split() parts at ASCII white space only
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    k = min(size, len(found))
    starts = np.concatenate(([0], ends[: len(found) - k])).tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint, the fingerprint's bits) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def masks(parts: int = PARTS, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of the parts that must agree, as signed 64-bit integers."""
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(part, parts - radius))]


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row r, column b has bit b of the 64 values of row r."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, _BLOCK, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view("<u8")[:, :, 0]


def near(query: np.ndarray, block: np.ndarray, sliced: np.ndarray, valid: np.ndarray, free: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tasks (query i against block[i]) with members within the radius, and those members as bits."""
    task = np.arange(len(query))
    alive = valid[block]
    depth = max(1, (radius + 1).bit_length())
    counter = np.zeros((depth, len(query)), np.uint64)
    for step, bit in enumerate(free):
        q = (query[task] >> np.uint64(bit)) & np.uint64(1)
        carry = (sliced[block[task], bit] ^ (np.uint64(0) - q)) & alive
        for d in range(depth):  # add one bit to the vertical counters: half adders, the carry goes up
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        beyond = carry.copy()
        equal = np.full(len(task), ~np.uint64(0))
        for d in range(depth - 1, -1, -1):
            if not radius >> d & 1:
                beyond |= equal & counter[d]
            equal &= counter[d] if radius >> d & 1 else ~counter[d]
        alive = alive & ~beyond  # what is beyond stays beyond
        if step % 4 == 3 and not alive.all():
            keep = alive != 0
            task, alive, counter = task[keep], alive[keep], counter[:, keep]
            if not len(task):
                break
    keep = alive != 0
    return task[keep], alive[keep]


def bucket_stars(values: np.ndarray, run: np.ndarray, mask: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct values of the same run (both sorted by run), as (value, smallest value of its set)."""
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    blocks = -(-sizes // _BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    which = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(run)) - starts[which]
    at = (first_block[which] + inside // _BLOCK) * _BLOCK + inside % _BLOCK  # each value's place in the blocks
    n = int(blocks.sum()) * _BLOCK
    slots, owner = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    slots[at], owner[at] = values, np.arange(len(values))
    valid = np.packbits(owner.reshape(-1, _BLOCK) >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    sliced = np.concatenate([planes(slots[i : i + 4096 * _BLOCK]) for i in range(0, n, 4096 * _BLOCK)])
    free = [b for b in range(64) if not mask >> b & 1]
    parent = np.arange(len(values))
    todo = np.cumsum(blocks[which])  # a value is compared with all blocks of its run
    lo = 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + _TASKS, "right")))
        count = blocks[which[lo:hi]]
        query = np.repeat(np.arange(lo, hi), count)
        block = np.repeat(first_block[which[lo:hi]], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        task, hits = near(values[query], block, sliced, valid, free, radius)
        for i in range(0, len(task), 4096):
            bits = np.unpackbits(hits[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, j = np.nonzero(bits)
            t = task[i : i + 4096][t]
            join_labels(parent, query[t], owner[block[t] * _BLOCK + j])
        lo = hi
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """a, b (bigint): links that keep the classes of distinct fingerprints fp together."""
    choice = masks(parts, radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(choice)])).alias("k")).select("k.c", "k.key", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, part in lookahead(batches):
            part = pd.concat([rest, part]) if rest is not None else part
            c, key, fp = (part[x].to_numpy() for x in ("c", "key", "fp"))
            run = np.concatenate(([0], np.cumsum((c[1:] != c[:-1]) | (key[1:] != key[:-1])))) if len(c) else np.zeros(0, int)
            done = len(c) if last else int(np.searchsorted(run, run[-1])) if len(c) else 0
            rest = part.iloc[done:]
            size = np.bincount(run[:done]) if done else np.zeros(0, int)
            many = np.flatnonzero(size[run[:done]] > 1) if done else np.zeros(0, int)
            for i in np.unique(c[many]):
                own = many[c[many] == i]
                a, b = bucket_stars(fp[own].view(np.uint64), run[own], choice[i] & (1 << 64) - 1, radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.repartition("c", "key").sortWithinPartitions("c", "key").mapInPandas(compare, "a long, b long")


def named(own: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """fp, root (a fingerprint of its class), component_id of the distinct fingerprints of own (doc_id, fp)."""
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), radius, parts)).withColumnRenamed("node", "fp")
    rooted = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    own = cut(fingerprints(docs), "fingerprints")
    return own.join(named(own, radius, parts).drop("root"), "fp")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
