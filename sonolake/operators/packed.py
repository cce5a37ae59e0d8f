"""Kneser-Ney models of large corpora: grams move packed, and an utterance's questions go where the answers lie.

A gram is its words read backwards (r1 the last word). Rows of strings take some forty bytes a gram in a shuffle, and a model has three grams for each four words.
Here a task sorts its grams and packs those of a target partition into one row: their words once, and columns of numbers into them, compressed.
Grams move twice, by r1 for their counts and by r2 for their contexts, so that what a word has as last word or as context is summed in one place. Words
that make over one in 2 * SHARE of the text are hot (2 * SHARE at most): theirs are dealt out by the next word as well, and what belongs to the word alone is added up for
the hot words by the driver. The model is that of lm.kneser_ney, which gives the same rows from plain joins and windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolake.operators.lm import discounts, parts_of_lists
from sonolake.tables import written

#: Words with over one in SHARE of a text's words are hot in any case, those with less than half of that never.
SHARE = 1000
#: Words of a batch that a task combines at a time, and words of the text for a partition at most: what a worker holds follows from them.
PART, PARTITION = 1 << 21, 1_500_000
ROWS_OUT = 100_000
#: A packed row: its partition, how many grams, words and bytes of words it has; the words' lengths and c1, the words in their order, keys, the grams' columns.
BLOB = "b int, n int, m int, size int, heads binary, words binary, keys binary, codes binary"
BLOB_COLUMNS = [x.split()[0] for x in BLOB.split(", ")]
PACKED = pa.schema([(x, pa.int32() if x in ("b", "n", "m", "size") else pa.binary()) for x in BLOB_COLUMNS])


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers below 2**32, the bytes of one weight together."""
    x = np.concatenate(columns).astype("<u4")
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, columns: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * columns * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(columns, n)


def pack_words(words: pa.Array, c1: np.ndarray) -> dict:
    """Words in their order (like ones lie together), their lengths apart from them."""
    _, ends, body = words.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(words) + 1]
    body = b"" if body is None else body.slice(0, int(ends[-1])).to_pybytes()
    return {"m": len(words), "size": len(body), "heads": squeeze([np.diff(ends), c1]), "words": pa.Codec("zstd", compression_level=5).compress(body, asbytes=True)}


def unpack_words(row: dict) -> tuple[pa.Array, np.ndarray]:
    lens, c1 = unsqueeze(row["heads"], 2, row["m"])
    ends = np.append(np.int32(0), np.cumsum(lens, dtype=np.int32))
    body = pa.decompress(row["words"], decompressed_size=row["size"], codec="zstd")
    return pa.StringArray.from_buffers(row["m"], pa.py_buffer(ends), body), c1


def in_order(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in their order, and the number of each row's word, from 1."""
    to = np.asarray(pc.array_sort_indices(coded.dictionary)).astype(np.int64)
    number = np.zeros(len(to), np.int64)
    number[to] = np.arange(1, len(to) + 1)
    return coded.dictionary.take(pa.array(to)), number[np.asarray(coded.indices, np.int64)]


def stored(keys: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays([keys], ["key"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def loaded(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def place(words: pa.Array, hot: pa.Array, partitions: int, one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """The partition of rows by the word one, of a hot word by the word two as well. Numbers of words count from 1, 0 is none."""
    h = np.array([0, *map(xxhash.xxh64_intdigest, words.to_pylist())], np.uint64)
    x = h[one]
    if two is not None:
        x = np.where(hot_words(words, hot)[one], (x * np.uint64(0x9E3779B97F4A7C15)) ^ h[two], x)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(partitions)).astype(np.int64)


def hot_words(words: pa.Array, hot: pa.Array) -> np.ndarray:
    return np.append(False, np.asarray(pc.is_in(words, value_set=hot), bool))


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of numbers below 2**32, two to a key."""
    keys = [columns[i].astype(np.uint64) << np.uint64(32) | columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return np.lexsort(keys[::-1])


def firsts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For 1, 2, ... of the columns, which sorted rows differ in them from the row before."""
    out = [np.zeros(len(columns[0]), bool)]
    out[0][:1] = True
    for x in columns:
        new = out[-1].copy()
        new[1:] |= x[1:] != x[:-1]
        out.append(new)
    return out[1:]


def blobs(partition: np.ndarray, words: pa.Array, coded: list[np.ndarray], numbers: list[np.ndarray], c1: np.ndarray | None = None, keys: pa.Array | None = None) -> list[dict]:
    """Rows by partition as packed rows: numbers of words in coded count from 1 in words, 0 is none. keys are the keys that the first of numbers points to."""
    to = np.argsort(partition, kind="stable")
    begin = np.flatnonzero(np.diff(partition[to], prepend=-1))
    out = []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(to)], strict=False):
        rows = to[lo:hi]
        local = [x[rows] for x in coded]
        if 16 * len(local) * len(rows) < len(words):
            used = np.unique(np.concatenate(local))
            used = used[used > 0]
            local = [np.where(x > 0, np.searchsorted(used, x) + 1, 0) for x in local]
        else:
            seen = np.zeros(len(words) + 1, bool)
            for x in local:
                seen[x] = True
            seen[0] = False
            used, number = np.flatnonzero(seen), np.cumsum(seen)
            local = [np.where(x > 0, number[x], 0) for x in local]
        own = pack_words(words.take(pa.array(used.astype(np.int64) - 1)), np.zeros(len(used), np.int64) if c1 is None else c1[used])
        rest, some = [x[rows] for x in numbers], None
        if keys is not None:
            which, rest[0] = np.unique(rest[0], return_inverse=True)
            some = stored(keys.take(pa.array(which)))
        out.append({"b": int(partition[rows[0]]), "n": len(rows), **own, "keys": some, "codes": squeeze([*local, *rest])})
    return out


def unified(rows: list[dict]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The distinct words of packed rows, each row's numbers of its words in them, and the greatest c1 of each word."""
    parts = [unpack_words(r) for r in rows]
    names, number = in_order(pa.concat_arrays([w for w, _ in parts]).dictionary_encode())
    c1 = np.zeros(len(names) + 1, np.int64)
    maps, lo = [], 0
    for w, c in parts:
        own = number[lo : lo + len(w)]
        maps.append(np.append(0, own).astype(np.uint32))
        c1[own] = np.maximum(c1[own], c)
        lo += len(w)
    return names, maps, c1


def unpacked(rows: list[dict], maps: list[np.ndarray], coded: int, numbers: int) -> list[np.ndarray]:
    if not rows:
        return [np.zeros(0, np.uint32)] * (coded + numbers)
    columns = [unsqueeze(r["codes"], coded + numbers, r["n"]) for r in rows]
    return [np.concatenate([m[x[i]] if i < coded else x[i] for x, m in zip(columns, maps, strict=True)]) for i in range(coded + numbers)]


def backwards(lists: pa.ListArray, order: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The words of lists, for each place the numbers of its word and those before it (0 before a list's start), and the place's list."""
    names, ids = in_order(lists.flatten().dictionary_encode())
    lens = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
    back = [np.where(at >= k, np.concatenate((np.zeros(min(k, len(ids)), np.int64), ids[: max(0, len(ids) - k)])), 0).astype(np.uint32) for k in range(order)]
    return names, back, np.repeat(np.arange(len(lens)), lens)


def hot_list(words: DataFrame, column: str, share: int) -> tuple[list[str], int]:
    """The hot words and the number of all words. A word of one in share has half of its places in parts where it makes one in 2 * share, so parts
    report no others."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in (part for b in batches for part in parts_of_lists(b.column(0), PART)):
            found = lists.flatten().value_counts()
            count = np.asarray(found.field(1), np.int64)
            many = np.flatnonzero(count * 2 * share >= count.sum())
            names = pa.concat_arrays([found.field(0).take(pa.array(many)).cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(count[many], count.sum()))], ["word", "c"])

    seen = words.select(F.col(column).cast("array<string>").alias("w")).mapInArrow(report, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    seen = written(seen, "hot")
    total = (seen.where("word is null").first() or {"c": 0})["c"]
    return sorted(r.word for r in seen.where((F.col("word").isNotNull()) & (F.col("c") * 2 * share >= total)).collect()), total


def gathered(words: DataFrame, order: int, column: str, hot: pa.Array, partitions: int) -> DataFrame:
    """Packed grams of two words or more by their last word, with their counts in a part of a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in (part for b in batches for part in parts_of_lists(b.column(0), PART)):
            names, back, _ = backwards(lists, order)
            own = back[1] > 0
            back = [x[own] for x in back]
            to = ordered(back)
            back = [x[to] for x in back]
            start = np.flatnonzero(firsts(back)[-1])
            count = np.diff(np.append(start, len(to)))
            back = [x[start] for x in back]
            yield from batches_of(blobs(place(names, hot, partitions, back[0], back[1]), names, back, [count]), PACKED)

    return words.select(F.col(column).cast("array<string>").alias("w")).mapInArrow(pack, BLOB)


def batches_of(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, few at a time; what a row lacks is null."""
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[lo : lo + 64], schema)


def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packed rows of each number b in a task: one, as they are dealt by it."""
    found: dict[int, list[dict]] = defaultdict(list)
    for b in batches:
        for r in b.to_pylist():
            found[r["b"]].append(r)
    while found:
        yield found.popitem()


def totals(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)


COUNTED = f"kind string, {BLOB}, word string, hot boolean, sums array<long>"
COUNTED_ROWS = pa.schema([("kind", pa.string()), *PACKED, ("word", pa.string()), ("hot", pa.bool_()), ("sums", pa.list_(pa.int64()))])


def counted(grams: DataFrame, order: int, hot: pa.Array, partitions: int) -> DataFrame:
    """By kind: grams (packed, by their second last word), pairs (packed, those whose first word is hot), words (with c1 in sums, and what pairs that begin with it
    have in all if it is hot) and counts (how many grams of each order have the counts 1 to 4).

    The highest order has its counts; a lower order counts in how many different grams of the next order it comes last."""

    def count(rows: list[dict]) -> Iterator[dict]:
        names, maps, _ = unified(rows)
        *r, c = unpacked(rows, maps, order, 1)
        to = ordered(r)
        r = [x[to] for x in r]
        first = firsts(r)
        start = np.flatnonzero(first[-1])
        c = totals(c[to], start)
        r, first = [x[start] for x in r], [x[start] for x in first]
        new, times = {order: r[-1] > 0}, {order: np.where(r[-1] > 0, c, 0)}
        for n in range(order - 1, 1, -1):
            begin = np.flatnonzero(first[n - 1])
            per = np.repeat(totals(new[n + 1], begin), np.diff(np.append(begin, len(c))))
            new[n], times[n] = first[n - 1] & (r[n - 1] > 0), np.where(r[n - 1] > 0, per, 0)
        yield {"kind": "counts", "sums": [int(np.count_nonzero(new[n] & (times[n] == k))) for n in range(2, order + 1) for k in (1, 2, 3, 4)]}
        begin = np.flatnonzero(first[0])
        c1 = np.zeros(len(names) + 1, np.int64)
        c1[r[0][begin]] = totals(new[2], begin)
        is_hot = hot_words(names, hot)
        pair = new[2] & is_hot[r[1]]
        used = pair & (times[2] > 0)
        c2, r2 = times[2][used], r[1][used]
        of = [np.bincount(r2, x, len(names) + 1).astype(np.int64) for x in (c2, c2 == 1, c2 == 2, c2 > 2)]
        for w in np.flatnonzero(is_hot & ((c1 > 0) | (of[0] > 0))).tolist():
            yield {"kind": "words", "word": names[w - 1].as_py(), "hot": True, "sums": [int(c1[w]), *(int(x[w]) for x in of)]}
        if len(c2):
            yield from ({"kind": "pairs"} | x for x in blobs(np.zeros(len(c2), np.int64), names, [r[0][used], r2], [c2], c1))
        flags = sum(np.where(pair, False, new[n]).astype(np.int64) << (n - 2) if n == 2 else new[n].astype(np.int64) << (n - 2) for n in new)
        rest = np.flatnonzero(~pair) if order == 2 else np.arange(len(c))
        r, flags, times = [x[rest] for x in r], flags[rest], {n: times[n][rest] for n in times}
        to = ordered([*r[1:], r[0]])
        r, flags, times = [x[to] for x in r], flags[to], {n: times[n][to] for n in times}
        yield from ({"kind": "grams"} | x for x in blobs(place(names, hot, partitions, r[1], r[2] if order > 2 else None), names, r, [*(times[n] for n in range(2, order + 1)), flags], c1))
        own = np.flatnonzero((c1 > 0) & ~is_hot)
        yield {"names": names.take(pa.array(own - 1)), "c1": c1[own]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_partition(batches):
            for x in count(rows):
                if "names" not in x:
                    yield from batches_of([x], COUNTED_ROWS)
                    continue
                for lo in range(0, len(x["names"]), ROWS_OUT):
                    words, c = x["names"].slice(lo, ROWS_OUT), x["c1"][lo : lo + ROWS_OUT]
                    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1), pa.int32()), pa.array(c))
                    some = {"kind": pa.array(["words"] * len(c)), "word": words, "hot": pa.array([False] * len(c)), "sums": sums}
                    yield pa.RecordBatch.from_arrays([some[f.name].cast(f.type) if f.name in some else pa.nulls(len(c), f.type) for f in COUNTED_ROWS], schema=COUNTED_ROWS)

    return grams.repartitionById(partitions, F.col("b")).mapInArrow(run, COUNTED)


@dataclass(frozen=True)
class Model:
    """A corpus' counted grams, and what all tasks know: discounts by order, the hot words' sums (c1, t2 and the pairs with counts 1, 2 and more), the sum of all c1."""

    rows: DataFrame
    order: int
    partitions: int
    off: dict[int, tuple[float, float, float]]
    hot: dict[str, list[int]]
    names: list[str]
    total: int

    def discounted(self, n: int, c: np.ndarray) -> np.ndarray:
        d1, d2, d3 = self.off[n]
        return np.where(c == 1, d1, np.where(c == 2, d2, d3))

    def hot_sums(self, names: pa.Array) -> np.ndarray:
        """The sums of each of names (from 1) that is hot, as columns; else -1."""
        out = np.full((5, len(names) + 1), -1, np.int64)
        listed = pa.array(list(self.hot), pa.string())
        at = pc.index_in(names, value_set=listed)
        for w in np.flatnonzero(np.asarray(at.is_valid())).tolist():
            out[:, w + 1] = self.hot[listed[at[w].as_py()].as_py()]
        return out

    def saved(self, n: int, t: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
        """The backoff of contexts: what was discounted, of all; 1 where there is nothing."""
        return np.where(t > 0, sum(d * m for d, m in zip(self.off[n], many, strict=True)) / np.maximum(t, 1), 1.0)


def count_grams(words: DataFrame, order: int = 4, column: str = "words", share: int = SHARE) -> Model:
    """Counts the grams of words (order 2 or more); its rows are a table."""
    listed, total = hot_list(words, column, share)
    partitions = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    hot = pa.array(listed, pa.string())
    rows = written(counted(gathered(words, order, column, hot, partitions), order, hot, partitions), "grams")
    adds = lambda k: [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k)]
    found = rows.where("kind = 'counts'").agg(*adds(4 * (order - 1))).first()
    off = {n: discounts({c: found[4 * (n - 2) + c - 1] or 0 for c in (1, 2, 3, 4)}) for n in range(2, order + 1)}
    sums = {r[0]: [x or 0 for x in r[1:]] for r in rows.where("kind = 'words' and hot").groupBy("word").agg(*adds(5)).collect()}  # 2 * share at most
    every = rows.where("kind = 'words'").agg(*adds(1)).first()[0] or 0
    return Model(rows, order, partitions, off, sums, listed, every)


def single_words(model: Model) -> DataFrame:
    """word, p of single words; they are not discounted."""
    total = float(model.total)
    cold = model.rows.where("kind = 'words' and not hot").select("word", (F.get("sums", F.lit(0)) / F.lit(total)).alias("p"))
    hot = [(w, s[0] / total) for w, s in model.hot.items() if s[0]]
    return cold.unionByName(cold.sparkSession.createDataFrame(hot, "word string, p double"))


def hot_pairs(model: Model) -> DataFrame:
    """word, context, p of pairs whose first word is hot."""
    known = without_rows(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            names, maps, c1 = unified([row])
            r1, r2, c2 = unpacked([row], maps, 2, 1)
            sums = known.hot_sums(names)
            p1 = np.where(sums[0] >= 0, sums[0], c1)[r1] / known.total
            p = (c2 - known.discounted(2, c2)) / sums[1][r2] + known.saved(2, sums[1], list(sums[2:]))[r2] * p1
            for lo in range(0, len(p), ROWS_OUT):
                some = slice(lo, lo + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(r1[some].astype(np.int64) - 1)), names.take(pa.array(r2[some].astype(np.int64) - 1)), pa.array(p[some])], ["word", "context", "p"])

    return model.rows.where("kind = 'pairs'").select(*BLOB_COLUMNS).mapInArrow(run, "word string, context string, p double")


class Contexts:
    """The grams of a partition by their contexts, with rows of an utterance's words among them: probabilities and backoffs of all orders."""

    def __init__(self, model: Model, rows: list[dict]) -> None:
        self.model, order = model, model.order
        self.asked = [x for x in rows if x["keys"] is not None]
        rows = [x for x in rows if x["keys"] is None]
        self.names, maps, c1 = unified([*rows, *self.asked])
        *r, flags = unpacked(rows, maps[: len(rows)], order, order)
        r, times = r[:order], r[order:]
        *q, self.key = unpacked(self.asked, maps[len(rows) :], order, 1)
        self.blob = np.repeat(np.arange(len(self.asked)), [x["n"] for x in self.asked])
        grams, questions = len(flags), len(self.key)
        r = [np.concatenate((a, b)) for a, b in zip(r, q, strict=True)]
        none = np.zeros(questions, np.uint32)
        to = ordered([*r[1:], r[0]])
        self.r = [x[to] for x in r]
        self.c = {n: np.concatenate((times[n - 2], none))[to].astype(np.int64) for n in range(2, order + 1)}
        flags = np.concatenate((flags, none))[to]
        self.question = np.full(len(to), -1)
        self.question[np.flatnonzero(to >= grams)] = to[to >= grams] - grams
        sums = model.hot_sums(self.names)
        self.hot = sums[0] >= 0
        self.p = {1: np.where(self.hot, sums[0], c1)[self.r[0]] / max(model.total, 1)}
        self.use, self.t, self.b, self.begin = {}, {}, {}, {}
        for n, first in enumerate(firsts(self.r[1:]), 2):
            begin = self.begin[n] = np.flatnonzero(first)
            use = self.use[n] = (flags >> (n - 2) & 1 > 0) & (self.c[n] > 0)
            run = np.cumsum(first) - 1
            c = np.where(use, self.c[n], 0)
            t, *many = (totals(x, begin)[run] for x in (c, c == 1, c == 2, c > 2))
            if n == 2:
                r2 = self.r[1]
                t, *many = (np.where(self.hot[r2], s[r2], x) for s, x in zip(sums[1:], (t, *many), strict=True))
            self.t[n], self.b[n] = t, model.saved(n, t, many)
        for n in self.use:
            self.p[n] = self._p(n, self.c[n])

    def _p(self, n: int, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.model.discounted(n, c)) / np.maximum(self.t[n], 1) + self.b[n] * self.p[n - 1], 0.0)

    def text(self, rows: np.ndarray, *which: int) -> pa.Array:
        words = [self.names.take(pa.array(self.r[k][rows].astype(np.int64) - 1)) for k in which]
        return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")

    def found(self) -> Iterator[tuple[int, pa.Array, pa.Array, pa.Array]]:
        """n, context, word, p of grams."""
        for n, use in self.use.items():
            at = np.flatnonzero(use)
            for lo in range(0, len(at), ROWS_OUT):
                some = at[lo : lo + ROWS_OUT]
                yield n, self.text(some, *range(n - 1, 0, -1)), self.text(some, 0), pa.array(self.p[n][some])

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the questions, by their rows here: the probability, or nan where it hangs on a shorter gram that is not here; then what the backoffs
        so far make of that one, and the backoff of its own context. All backoffs that are not known are 1."""
        rows = np.flatnonzero(self.question >= 0)
        p, cost = np.full(len(rows), np.nan), np.ones(len(rows))
        r2 = self.r[1][rows]
        pair_elsewhere = self.hot[r2] & (r2 > 0)
        last = np.where(pair_elsewhere, self.b[2][rows], 1.0)
        lower = self.p[1].copy()
        for n in range(2, self.model.order + 1):
            # a question's count is that of its gram, whose rows have it: they lie together by this context and the word
            by = [*self.r[1:n], self.r[0]]
            to = ordered(by)
            first = firsts([x[to] for x in by])[-1]
            begin, run = np.flatnonzero(first), np.cumsum(first) - 1
            c, low = np.zeros(len(to), np.int64), np.zeros(len(to))
            c[to] = np.maximum.reduceat(self.c[n][to], begin)[run]
            # the rows' own probability of the next shorter gram
            low[to] = np.maximum.reduceat(np.where(self.question[to] < 0, lower[to], 0.0), begin)[run]
            mine = (self.r[n - 1] > 0) & (c > 0)
            value = np.where(mine, (c - self.model.discounted(n, c)) / np.maximum(self.t[n], 1) + self.b[n] * low, 0.0)
            lower = np.where(self.question < 0, self.p[n], value)
            there, asks = mine[rows], self.r[n - 1][rows] > 0
            back = np.where(asks & ~there, self.b[n][rows], 1.0)
            open_ = np.isnan(p)
            if n == 2:
                cost = np.where(pair_elsewhere, cost, cost * back)
            else:
                cost = np.where(open_, cost * back, cost)
                p = np.where(open_, p, p * back)
            p = np.where(there, value[rows], p)
        return rows, p, cost, last


def model_rows(model: Model) -> DataFrame:
    """n, context, word, p of all grams, as lm.kneser_ney gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_partition(batches):
            for n, context, word, p in Contexts(known, rows).found():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, np.int32)), context, word, p], ["n", "context", "word", "p"])

    known = without_rows(model)
    one = single_words(model).select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("context"), "word", "p")
    two = hot_pairs(model).select(F.lit(2).alias("n"), "context", "word", "p")
    return one.unionByName(two).unionByName(grams_of(model).repartitionById(model.partitions, F.col("b")).mapInArrow(run, "n int, context string, word string, p double"))


def grams_of(model: Model) -> DataFrame:
    return model.rows.where("kind = 'grams'").select(*BLOB_COLUMNS)


def without_rows(model: Model) -> Model:
    """What a task gets."""
    return Model(None, model.order, model.partitions, model.off, model.hot, model.names, model.total)


def scored(words: DataFrame, model: Model, key: str, column: str = "words", floor: float = 1e-7) -> DataFrame:
    """key, n, log_prob (natural) as lm.scored gives them: each word goes, with those before it, to the partition of its contexts, and its logarithm comes
    back added up by key. What is left there are words and pairs that no gram of the partition has: they are joined."""
    order, partitions, hot = model.order, model.partitions, pa.array(model.names, pa.string())
    kind = words.select(F.col(key).alias("key")).schema.fields[0]
    known = without_rows(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for lists in parts_of_lists(b.column(1), PART):
                names, back, row = backwards(lists, order)
                at = place(names, hot, partitions, back[1], back[2] if order > 2 else None)
                yield from batches_of(blobs(at, names, back, [row], keys=b.column(0).slice(lo, len(lists))), PACKED)
                lo += len(lists)

    out = T.StructType([kind, T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("word", T.StringType()), T.StructField("context", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("last", T.DoubleType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_partition(batches):
            if all(x["keys"] is None for x in rows):
                continue
            c = Contexts(known, rows)
            at, p, cost, last = c.answers()
            which = c.question[at]
            own, blob = c.key[which], c.blob[which]
            for i, x in enumerate(c.asked):
                keys = loaded(x["keys"])
                here = blob == i
                done, left = np.flatnonzero(here & ~np.isnan(p)), np.flatnonzero(here & np.isnan(p))
                times = np.bincount(own[done], minlength=len(keys))
                some = np.flatnonzero(times)
                sums = np.bincount(own[done], np.log(p[done]), len(keys))[some].astype(np.float64)  # of no rows it makes integers
                nulls = [pa.nulls(len(some), t) for t in (pa.string(), pa.string(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array(times[some]), pa.array(sums), *nulls], out.names)
                for lo in range(0, len(left), ROWS_OUT):
                    part = left[lo : lo + ROWS_OUT]
                    r2 = c.r[1][at[part]]
                    context = pa.array(np.where(c.hot[r2] & (r2 > 0), r2, 0).astype(np.int64) - 1, mask=~(c.hot[r2] & (r2 > 0)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own[part].astype(np.int64))), pa.array(np.ones(len(part), np.int64)), pa.nulls(len(part), pa.float64()), c.text(at[part], 0), c.names.take(context), pa.array(cost[part]), pa.array(last[part])], out.names)

    asked = words.select(F.col(key).alias("key"), F.col(column).cast("array<string>").alias("w")).where(F.size("w") > 0).mapInArrow(ask, BLOB)
    dealt = grams_of(model).unionByName(asked).repartitionById(partitions, F.col("b"))
    told = written(dealt.mapInArrow(answer, out), "answers")
    left = told.where("word is not null").select("key", "n", "word", "context", "cost", "last")
    left = left.join(hot_pairs(model).withColumnRenamed("p", "p2"), ["word", "context"], "left").join(single_words(model).withColumnRenamed("p", "p1"), "word", "left")
    p = F.col("cost") * F.coalesce("p2", F.col("last") * F.coalesce("p1", F.lit(floor)))
    every = told.where("word is null").select("key", "n", "s").unionByName(left.select("key", "n", F.log(p).alias("s")))
    return every.groupBy("key").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 6).alias("log_prob")).withColumnRenamed("key", key)
