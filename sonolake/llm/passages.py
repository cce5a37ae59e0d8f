"""What substring dedup over words and over bytes share: distinct texts, routed pieces, removal.

A window is a fixed number of consecutive items. Its mark is the least hash among its k-grams of items: equal windows have equal
marks. Consecutive windows of a text with one mark form a run; a run's items are a piece. Marks met in one run only cannot hold a
repeat. The pieces of the other marks go to the shard of their mark, so that equal windows always meet in one shard, and each
shard is indexed on its own. Pieces that are equal are combined before the shuffle, inside batches, and again in the shard.

Texts are collapsed first: one row per distinct text, with its number of copies and its smallest doc_id, in a table bucketed by two
64-bit hashes of the text, so that joins by text move no text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
KEY = ["h1", "h2"]
#: Longer runs are cut: their pieces still meet, for they keep their mark.
RUN = 256


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))))
    return _POWERS[0], _POWERS[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers the first i values."""
    up, _ = powers(len(values))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * up[: len(values)])))


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of each hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    h = prefix(values)
    return spread((h[k:] - h[:-k]) * powers(len(values))[1][: len(values) - k + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


@dataclass(frozen=True)
class Unit:
    """Items of a text. cells: their hashes, starts and ends in the UTF-8 bytes."""

    cells: Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int


def byte_cells(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(text))
    return np.frombuffer(text, np.uint8).astype(np.uint64), at, at + 1


def word_cells(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    black = np.concatenate(([False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]))
    edge = np.flatnonzero(black[1:] != black[:-1])
    start, end = edge[::2], edge[1::2]
    h = prefix(raw.astype(np.uint64))
    return spread((h[end] - h[start]) * powers(len(raw) + 1)[1][start]), start, end


def runs(text: bytes, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mark, first window and number of least grams (in the text, of that mark) of each run; empty for texts below one window."""
    values, *_ = unit.cells(text)
    if len(values) < unit.window:
        none = np.zeros(0, np.int64)
        return none, none, none
    g = grams(values, unit.gram)
    width = unit.window - unit.gram + 1
    least = sliding_least(g, width)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    start = np.flatnonzero(new)
    extra = [np.arange(s + RUN, e, RUN) for s, e in zip(start, np.append(start[1:], len(least)), strict=True) if e - s > RUN]
    if extra:
        start = np.sort(np.concatenate([start, *extra]))
    mark = least[start]
    # a gram is the least of some window if no window that holds it has a lesser one only
    most = ~sliding_least(np.concatenate((np.full(width - 1, ~np.uint64(0)), ~least, np.full(width - 1, ~np.uint64(0)))), width)
    own, count = np.unique(g[g == most], return_counts=True)
    return mark.view(np.int64), start, count[np.searchsorted(own, mark)]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """h1, h2, text, first (smallest doc_id), copies: a bucketed table with one row per distinct text."""
    spark = docs.sparkSession
    rows = keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("compression", "zstd").bucketBy(n, *KEY).sortBy(*KEY).saveAsTable(name)
    return spark.table(name)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), F.col("text"))})


def marked(texts: DataFrame, unit: Unit) -> DataFrame:
    """h1, h2, first, copies, mark, start, stop (windows, stop excluded), grams: a row per run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out, n = [], []
                for x in part.column(4).to_pylist():
                    mark, start, count = runs(x, unit)
                    total = max(0, len(unit.cells(x)[0]) - unit.window + 1) if len(mark) else 0
                    out.append((mark, start, np.append(start[1:], total)[: len(start)], count))
                    n.append(len(mark))
                row = np.repeat(np.arange(part.num_rows), n)
                flat = [np.concatenate([o[i] for o in out]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(4)), *(pa.array(x.astype(np.int64)) for x in flat)], ["h1", "h2", "first", "copies", "mark", "start", "stop", "grams"])

    return texts.select(*KEY, "first", "copies", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "h1 long, h2 long, first long, copies long, mark long, start long, stop long, grams long")


def shared_runs(rows: DataFrame, repeated: str) -> DataFrame:
    """h1, h2, spots: per text, the runs whose mark satisfies the SQL condition over its aggregate."""
    met = rows.groupBy("mark").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.sum(F.col("copies") * F.col("grams")).alias("n")).where(repeated).select("mark")
    return rows.join(met, "mark", "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("mark", "start", "stop")).alias("spots"))


def pieces(texts: DataFrame, spots: DataFrame, unit: Unit, combined: bool) -> DataFrame:
    """combined: mark, p1, p2, piece, first, copies with equal pieces of a batch as one row. Else h1, h2, mark, p1, p2, start, first."""
    joined = texts.join(spots, KEY).select(*KEY, "first", "copies", F.col("text").cast("binary").alias("text"), F.col("spots.mark").alias("marks"), F.col("spots.start").alias("starts"), F.col("spots.stop").alias("stops"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        names = ["mark", "p1", "p2", "piece", "first", "copies"] if combined else ["h1", "h2", "mark", "p1", "p2", "start", "first"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 2 if combined else [pa.int64()] * 7

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        out: list[tuple] = []
        for b in batches:
            for h1, h2, first, copies, text, marks, starts, stops in zip(*(b.column(i) for i in range(8)), strict=True):
                text, first, copies = text.as_py(), first.as_py(), copies.as_py()
                _, begin, end = unit.cells(text)
                for mark, s, e in zip(marks.as_py(), starts.as_py(), stops.as_py(), strict=True):
                    lo, hi = begin[s], end[e - 1 + unit.window - 1]
                    piece = text[lo:hi] if unit.cells is byte_cells else b" ".join(text[lo:hi].split())
                    p1, p2 = signed(xxhash.xxh64_intdigest(piece, 0)), signed(xxhash.xxh64_intdigest(piece, 1))
                    if not combined:
                        out.append((h1.as_py(), h2.as_py(), mark, p1, p2, s, first))
                    elif (key := (mark, p1, p2)) in held:
                        old = held[key]
                        old[1], old[2] = min((x for x in (old[1], first) if x is not None), default=None), old[2] + copies
                    else:
                        held[key] = [piece, first, copies]
                        size += len(piece) + 200
                    if size > 48_000_000:
                        yield batch([(*k, *v) for k, v in held.items()])
                        held, size = {}, 0
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        if held:
            yield batch([(*k, *v) for k, v in held.items()])
        if out:
            yield batch(out)

    kind = "mark long, p1 long, p2 long, piece binary, first long, copies long" if combined else "h1 long, h2 long, mark long, p1 long, p2 long, start long, first long"
    return joined.mapInArrow(extract, kind)


def by_shard(found: DataFrame, judge: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list], kind: str, budget: int, cost: Callable[[bytes], int]) -> DataFrame:
    """mark, p1, p2 and judge's verdict for each distinct piece. A shard is as many whole marks as the budget of cost holds (one at least).

    judge(pieces, mark, first, copies) returns a value per piece; None goes no further."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        text: list[bytes] = []
        firsts: list[int] = []
        copies: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values = judge(text, np.array([k[0] for k in keys], np.int64), np.array(firsts, np.int64), np.array(copies, np.int64))
            kept = [i for i, v in enumerate(values) if v is not None]
            return pa.RecordBatch.from_arrays([*(pa.array([keys[i][c] for i in kept], pa.int64()) for c in range(3)), pa.array([values[i] for i in kept], _arrow(kind))], ["mark", "p1", "p2", "verdict"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                key = row[:3]
                first = row[4] if row[4] is not None else np.iinfo(np.int64).max
                if keys and keys[-1] == key:
                    firsts[-1], copies[-1] = min(firsts[-1], first), copies[-1] + row[5]
                    continue
                if size >= budget and keys[-1][0] != key[0]:
                    yield flush()
                    keys, text, firsts, copies, size = [], [], [], [], 0
                keys.append(key)
                text.append(row[3])
                firsts.append(first)
                copies.append(row[5])
                size += cost(row[3])
        if keys:
            yield flush()

    n = 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "mark").sortWithinPartitions("mark", "p1", "p2").mapInArrow(shards, f"mark long, p1 long, p2 long, verdict {kind}")


def _arrow(kind: str) -> pa.DataType:
    return {"array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[kind]


def cover(n: int, windows: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in a window; windows has pairs (start, stop) of window numbers."""
    delta = np.zeros(n + 1, np.int64)
    if len(windows):
        np.add.at(delta, windows[:, 0], 1)
        np.add.at(delta, np.minimum(windows[:, 1] - 1 + width, n), -1)
    return np.cumsum(delta[:n]) > 0


def flag_runs(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)

