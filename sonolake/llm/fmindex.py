"""Substring dedup over words with an FM-index per shard.

In a shard (see passages) the pieces that may be someone's source are indexed: those whose document is not the last one of their
mark. The pieces that may repeat something are streamed through the index: those whose document is not the first one of their mark.
With two documents to a mark, one is indexed and the other one streamed.

The index keeps the Burrows-Wheeler transform in a wavelet matrix of packed bit vectors with block counts, the common prefix of
neighbouring suffixes in a byte each, and the document of each suffix, both under a tree of minima; texts, suffix array and ranks are
dropped once it is built. Streamed pieces are searched backwards, all at once: each step extends a match by one word to the left,
falling back to shorter matches by the prefix tree. The matching statistics of a place are how many words match from there on and
the interval of suffixes that they match; where a window's worth of words matches, the smallest document of the interval decides
whether the window is a repeat. Suffixes are ordered by their first 64 words, which is more than a match may need.

Result of a document: its words covered by windows of WINDOW words that also start in a document with a smaller doc_id.
Documents below WINDOW words lose none. Rows with a null doc_id neither lose nor take words; rows with one doc_id are one document
and take nothing from each other; a null text has no words. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import cut
from sonolake.llm.passages import KEY, Unit, by_shard, cover, distinct_texts, flag_runs, keyed, marked, pieces, shared_runs, word_cells

WINDOW = 50
WORDS = Unit(word_cells, WINDOW, 16)
SHARD_WORDS = 600_000


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector per bit of the symbols, with a count per 64 bits."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels = []
        self.node = np.zeros(symbols, np.int64)  # where each symbol's run starts after the last level
        every = np.arange(symbols)
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            b = (seq >> bit & 1).astype(np.uint8)
            words = np.packbits(np.pad(b, (0, 64 - len(b) % 64)), bitorder="little").view("<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
            zeros = len(b) - int(counts[-1])
            self.levels.append((bit, words, counts, zeros))
            self.node = self._down(self.node, every, self.levels[-1])
            seq = np.concatenate((seq[b == 0], seq[b == 1]))

    @staticmethod
    def _down(at: np.ndarray, symbol: np.ndarray, level: tuple) -> np.ndarray:
        bit, words, counts, zeros = level
        word = at >> 6
        ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(symbol >> bit & 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place at."""
        for level in self.levels:
            at = self._down(at, symbol, level)
        return at - self.node[symbol]


class MinTree:
    """Minima over intervals of an array, in narrow integers: a complete binary tree over it, twice its size."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = 1 << max(1, (len(values) - 1).bit_length() if len(values) else 1)
        top = np.iinfo(values.dtype).max
        level = np.concatenate((values, np.full(self.n - len(values), top, values.dtype)))
        self.tree = np.empty(2 * self.n, values.dtype)
        size = self.n
        while size:
            self.tree[size : 2 * size] = level
            level = np.minimum(level[::2], level[1::2]) if size > 1 else level
            size //= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of each interval [lo, hi), which must not be empty."""
        out = np.full(len(lo), np.iinfo(self.tree.dtype).max, self.tree.dtype)
        a, b, at = lo + self.n, hi + self.n, np.arange(len(lo))
        while len(at):
            odd = (a & 1) == 1
            out[at[odd]] = np.minimum(out[at[odd]], self.tree[a[odd]])
            a = (a + odd) >> 1
            odd = (b & 1) == 1
            b = b - odd
            out[at[odd]] = np.minimum(out[at[odd]], self.tree[b[odd]])
            b = b >> 1
            keep = a < b
            a, b, at = a[keep], b[keep], at[keep]
        return out

    def before(self, at: np.ndarray, under: np.ndarray) -> np.ndarray:
        """The last place <= at whose value is less than under (place 0 must be)."""
        return self._find(at, under, -1)

    def after(self, at: np.ndarray, under: np.ndarray) -> np.ndarray:
        """The first place >= at whose value is less than under (the last place must be)."""
        return self._find(at, under, 1)

    def _find(self, at: np.ndarray, under: np.ndarray, way: int) -> np.ndarray:
        node = at + self.n
        todo = np.flatnonzero(self.tree[node] >= under)
        while len(todo):  # up and aside until a subtree has a lesser value
            v = node[todo]
            turn = (v & 1) == (1 if way > 0 else 0)
            while turn.any():
                v = np.where(turn, v >> 1, v)
                turn = (v & 1) == (1 if way > 0 else 0)
            node[todo] = v + way
            todo = todo[self.tree[node[todo]] >= under[todo]]
        todo = np.flatnonzero(node < self.n)
        while len(todo):  # down to the nearest such leaf
            near = node[todo] * 2 + (way < 0)
            node[todo] = np.where(self.tree[near] < under[todo], near, near + way)
            todo = todo[node[todo] < self.n]
        return node - self.n


class FMIndex:
    """Index of texts given as one array of symbols >= 1, with 0 after each text, and the document (a small number) of each symbol."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> None:
        n, self.n, self.window = len(text), len(text), window
        depth, rank, ranks = 1, text.astype(np.int64), []
        while depth < window:
            ranks.append((depth, rank))
            ahead = np.concatenate((rank[depth:] + 1, np.zeros(min(depth, n), np.int64)))
            key = rank * (n + 2) + ahead
            order = np.argsort(key)
            new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            depth *= 2
        suffixes = np.argsort(rank, kind="stable")
        symbols = int(text.max()) + 1 if n else 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.transform = WaveletMatrix(text[suffixes - 1], symbols)
        a, b, common = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(n + 1, np.int64)
        for d, r in [*ranks, (depth, rank)][::-1]:
            same = (a < n) & (b < n) & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
            a, b = a + d * same, b + d * same
            common[1:n] += d * same
        common[0] = common[n] = 0  # neighbours that agree on nothing: edges of every interval
        common = np.minimum(common, window) + 1
        common[0] = common[n] = 0
        self.common = MinTree(common.astype(np.uint8))
        self.edges = np.flatnonzero(common <= window).astype(np.int32)  # where windows change
        self.owner = MinTree(owner[suffixes].astype(np.int32))

    def matching_statistics(self, patterns: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of patterns (pattern i is [start, stop)): how many symbols match from there on, window at most, and the
        smallest document where a whole window does (else -1). Symbols outside the index are given as -1."""
        length, least = np.zeros(len(patterns), np.int64), np.full(len(patterns), -1, np.int64)
        n = self.n
        by = np.argsort(start - stop, kind="stable")
        start, at = start[by], stop[by] - 1
        lo, hi, m = np.zeros(len(by), np.int64), np.full(len(by), n), np.zeros(len(by), np.int64)
        live = len(by)
        while True:
            while live and at[live - 1] < start[live - 1]:
                live -= 1
            if not live:
                return length, least
            c = patterns[at[:live]]
            todo = np.arange(live)
            while len(todo):
                s = np.maximum(c[todo], 0)
                r = self.transform.rank(np.concatenate((s, s)), np.concatenate((lo[todo], hi[todo]))).reshape(2, -1) + self.before[s]
                fit = (r[0] < r[1]) & (c[todo] >= 0)
                good, bad = todo[fit], todo[~fit]
                lo[good], hi[good], m[good] = r[0][fit], r[1][fit], m[good] + 1
                bad, lost = bad[m[bad] > 0], bad[m[bad] == 0]
                lo[lost], hi[lost] = 0, n
                if len(bad):  # drop symbols at the far end: to the interval of the longest shorter match
                    wide = np.maximum(self.common.tree[lo[bad] + self.common.n], self.common.tree[hi[bad] + self.common.n]).astype(np.int64)
                    m[bad] = np.maximum(wide - 1, 0)
                    lo[bad], hi[bad] = self.common.before(lo[bad], wide), self.common.after(hi[bad], wide)
                todo = bad
            over = np.flatnonzero(m[:live] > self.window)
            if len(over):
                lo[over], hi[over] = self.edges[np.searchsorted(self.edges, lo[over], "right") - 1], self.edges[np.searchsorted(self.edges, hi[over])]
                m[over] = self.window
            whole = np.flatnonzero(m[:live] >= self.window)
            least[at[whole]] = self.owner.least(lo[whole], hi[whole])
            length[at[:live]] = m[:live]
            at[:live] -= 1


def flat(pieces: list[list[bytes]], numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the pieces one after another, with 0 after each, and their starts and stops."""
    lens = np.array([len(x) for x in pieces], np.int64)
    stop = np.cumsum(lens + 1) - 1
    out = np.zeros(int(stop[-1]) + 1 if len(stop) else 0, np.int64)
    for x, e, n in zip(numbers, stop, lens, strict=True):
        out[e - n : e] = x
    return out, stop - lens, stop


def repeated_windows(texts: list[bytes], mark: np.ndarray, first: np.ndarray, copies: np.ndarray) -> list[np.ndarray | None]:
    """Per piece, (its first document, its number of windows, and start and stop of runs of windows that a smaller document has); None
    for pieces of one document without such windows."""
    split = [x.split() for x in texts]
    _, group = np.unique(mark, return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, first)
    np.maximum.at(high, group, first)
    sources, readers = np.flatnonzero(first < high[group]), np.flatnonzero(first > low[group])
    found: dict[int, np.ndarray] = {}
    if len(sources):
        number: dict[bytes, int] = {}
        documents, rank = np.unique(first[sources], return_inverse=True)
        own = [split[i] for i in sources]
        text, start, stop = flat(own, [[number.setdefault(w, len(number) + 1) for w in x] for x in own])
        index = FMIndex(text, np.repeat(rank, stop - start + 1))
        read = [split[i] for i in readers]
        text, start, stop = flat(read, [[number.get(w, -1) for w in x] for x in read])
        length, least = index.matching_statistics(text, start, stop)
        again = length >= WINDOW
        again &= documents[np.maximum(least, 0)] < np.repeat(first[readers], stop - start + 1)
        for i, s, e in zip(readers.tolist(), start, stop, strict=True):
            found[i] = flag_runs(again[s : e - WINDOW + 1]).ravel()
    none = np.zeros(0, np.int64)
    out: list[np.ndarray | None] = []
    for i, x in enumerate(split):
        runs = found.get(i, none)
        out.append(np.concatenate(([first[i], len(x) - WINDOW + 1], runs)) if len(runs) or copies[i] > 1 else None)
    return out


def intervals(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """h1, h2, spans: per text, its windows that a smaller document has, as (start, stop). A piece that a smaller document has is such
    as a whole; for the piece's first document the verdict's runs hold."""
    met = rows.join(verdicts, ["mark", "p1", "p2"])
    own = "if(size(verdict) > 2, transform(sequence(2, size(verdict) - 2, 2), i -> struct(start + verdict[i] as a, start + verdict[i + 1] as b)), cast(array() as array<struct<a: bigint, b: bigint>>))"
    ends = F.expr(f"if(first > verdict[0], array(struct(start as a, start + verdict[1] as b)), {own})")
    return met.select(*KEY, F.explode(ends).alias("span")).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))


def judged(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """h1, h2, first, n_words, n_removed, whole_sha, kept_sha, none_sha of each distinct text."""
    joined = texts.join(spans, KEY, "left").select(*KEY, "first", F.col("text").cast("binary").alias("text"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for x, a, e in zip(*(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                    w = x.split()
                    gone = cover(len(w), np.array([a or [], e or []], np.int64).T, WINDOW)
                    n = int(gone.sum())
                    whole = sha(w)
                    out.append((len(w), n, whole, sha([w[i] for i in np.flatnonzero(~gone)]) if n else whole))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(c) for c in zip(*out, strict=True))], ["h1", "h2", "first", "n_words", "n_removed", "whole_sha", "kept_sha"])

    return joined.mapInArrow(cut_out, "h1 long, h2 long, first long, n_words long, n_removed long, whole_sha string, kept_sha string")


def digest(docs: DataFrame) -> DataFrame:
    texts = distinct_texts(docs)
    rows = cut(marked(texts, WORDS), "runs")
    spots = cut(shared_runs(rows.where("first is not null"), "low < high"), "spots")
    verdicts = cut(by_shard(pieces(texts, spots, WORDS, True), repeated_windows, "array<long>", SHARD_WORDS, lambda x: x.count(b" ") + 1), "verdicts")
    results = judged(texts, intervals(pieces(texts, spots, WORDS, False), verdicts)).withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    d = keyed(docs).select("doc_id", *KEY).join(results, F.expr("h1 = _h1 and h2 = _h2"))
    later = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    own = F.col("doc_id") == F.col("first")
    removed = F.when(later, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0).cast("long"))
    sha = F.when(later, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.col("kept_sha")).otherwise(F.col("whole_sha"))
    return d.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))
