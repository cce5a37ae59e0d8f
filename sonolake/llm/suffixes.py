"""Substring dedup over bytes with a hash-compared suffix sort.

In a shard (see passages) the suffixes at the marks of all pieces are sorted by mergesort. Two suffixes are compared through
prefix polynomial hashes: whole windows first, then binary search over lengths finds their common extension in a few steps and the
next byte decides. Equal windows agree on their mark and on its place in the window, so suffixes are merged inside buckets of a mark;
two suffixes alone in a bucket need one comparison and no sort. Suffixes at windows that begin before their mark follow by induced
sorting, a byte further ahead at a time.

Collisions: neighbours of the sorted order are compared byte by byte. Windows count as equal by their bytes only, and where a
neighbour does not come after the one before it, a hash lied: that bucket is sorted anew by its bytes. Different hashes prove
different bytes. So no collision can remove or keep anything.

Result of a text: its bytes covered by strings of WINDOW bytes that also start anywhere else, in the same document or another.
Equal texts are each other's repeats, and so are repeated rows; matches never cross documents; a null text is empty. Null ids are
kept. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import cut
from sonolake.llm.passages import KEY, Unit, by_shard, byte_cells, cover, distinct_texts, flag_runs, grams, keyed, marked, pieces, powers, prefix, shared_runs

WINDOW = 200
BYTES = Unit(byte_cells, WINDOW, 32)
SHARD_BYTES = 3_000_000


class HashedText:
    """Compares suffixes of a buffer through prefix hashes."""

    def __init__(self, text: np.ndarray, window: int = WINDOW) -> None:
        self.text, self.window = text, window
        self.prefix = prefix(text.astype(np.uint64))
        self.back = powers(len(text) + 1)[1]
        self._views: np.ndarray | None = None

    def _same(self, s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """Whether the hashes of n bytes at s and t agree; no n bytes are left near the end."""
        size = len(self.text)
        e, f = np.minimum(s + n, size), np.minimum(t + n, size)
        return (self.prefix[e] - self.prefix[s]) * self.back[s] == (self.prefix[f] - self.prefix[t]) * self.back[t]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes a and b, at most a window: whole windows first, then binary search over lengths."""
        length = np.where(self._same(a, b, self.window), self.window, 0)
        part = np.flatnonzero(length == 0)
        s, t, found = a[part], b[part], np.zeros(len(part), np.int64)
        step = 1 << (self.window.bit_length() - 1)
        while step and len(part):
            found += step * ((found + step <= self.window) & self._same(s + found, t + found, step))
            step //= 2
        length[part] = found
        return length

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; equal windows count as ties says."""
        n = self.common(a, b)
        ends = n >= self.window
        x, y = (self.text[np.minimum(i + n, len(self.text) - 1)] for i in (a, b))
        return np.where(ends, ties, x < y)

    def _eights(self, at: np.ndarray) -> np.ndarray:
        """The windows at some places, eight bytes to a number (big end first), as rows; the last number overlaps the one before."""
        steps = np.append(np.arange(0, self.window - 8, 8), self.window - 8)
        if self._views is None:
            self._views = np.ndarray((max(0, len(self.text) - 7),), ">u8", self.text.tobytes(), strides=(1,))
        return self._views[at[:, None] + steps]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether whole windows are equal: by hash, then byte by byte."""
        same = self._same(a, b, self.window)
        for lo in range(0, len(a), 8192):
            i = lo + np.flatnonzero(same[lo : lo + 8192])
            same[i] = (self._eights(a[i]) == self._eights(b[i])).all(axis=1)
        return same

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the windows a and b begin with alike, by their bytes."""
        out = np.zeros(len(a), np.uint8 if self.window < 256 else np.int64)
        steps = np.append(np.arange(0, self.window - 8, 8), self.window - 8)
        for lo in range(0, len(a), 8192):
            apart = self._eights(a[lo : lo + 8192]) ^ self._eights(b[lo : lo + 8192])
            step = (apart != 0).argmax(axis=1)
            bits = np.ascontiguousarray(apart[np.arange(len(apart)), step]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
            out[lo : lo + 8192] = np.where(bits.any(axis=1), steps[step] + bits.argmax(axis=1), self.window)
        return out

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as window a is less than, equal to or greater than window b, by their bytes."""
        out = np.zeros(len(a), np.int8)
        for lo in range(0, len(a), 8192):
            x, y = (self._eights(i[lo : lo + 8192]) for i in (a, b))
            row, first = np.arange(len(x)), (x != y).argmax(axis=1)
            x, y = x[row, first], y[row, first]
            out[lo : lo + 8192] = (x > y).astype(np.int8) - (x < y)
        return out


def merge_sort(text: HashedText, suffixes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Suffixes sorted inside each bucket; start has the buckets' first places. All buckets' runs of a length merge together: each
    suffix finds its place among the neighbouring run by binary search."""
    size = np.diff(np.append(start, len(suffixes)))
    base, n = np.repeat(start, size), np.repeat(size, size)
    inside = np.arange(len(suffixes)) - base
    run = 1
    while run < (size.max() if len(size) else 0):
        number = inside // run
        lo = np.minimum((number ^ 1) * run, n)  # the neighbouring run, inside the bucket
        end = np.minimum(lo + run, n)
        first, open_ = lo.copy(), np.flatnonzero(lo < end)
        ties = number % 2 == 1  # the right run's suffix goes after equal ones of the left run
        hi = end.copy()
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = text.before(suffixes[base[open_] + mid], suffixes[open_], ties[open_])
            lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        inside = (number & ~1) * run + inside - number * run + (lo - first)
        out = suffixes.copy()
        out[base + inside] = suffixes
        suffixes = out
        inside = np.arange(len(suffixes)) - base
        run *= 2
    return suffixes


def sorted_groups(text: HashedText, suffixes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of each bucket (of two or more) in order, and which of them begin a group of equal windows."""
    size = np.diff(np.append(start, len(suffixes)))
    new = np.zeros(len(suffixes), bool)
    new[start] = True
    two = start[size == 2]
    new[two + 1] = ~text.equal(suffixes[two], suffixes[two + 1])  # no sort needed
    more = np.repeat(size > 2, size)
    if more.any():
        sizes = size[size > 2]
        begin = np.cumsum(sizes) - sizes
        placed = merge_sort(text, suffixes[more], begin)
        lost = np.zeros(len(sizes), bool)
        if not np.array_equal(np.sort(placed), np.sort(suffixes[more])):  # hashes that contradict each other
            lost[:] = [set(placed[i : i + n].tolist()) != set(suffixes[more][i : i + n].tolist()) for i, n in zip(begin, sizes, strict=True)]
            for k in np.flatnonzero(lost):
                placed[begin[k] : begin[k] + sizes[k]] = suffixes[more][begin[k] : begin[k] + sizes[k]]
        inner = np.ones(len(placed), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)
        order = text.order(placed[at - 1], placed[at])
        lost[np.searchsorted(begin, at[order > 0], "right") - 1] = True
        for k in np.flatnonzero(lost):  # a hash collision: by bytes instead
            i, e = begin[k], begin[k] + sizes[k]
            placed[i:e] = sorted(placed[i:e], key=lambda x: text.text[x : x + text.window].tobytes())
            own = (at > i) & (at < e)
            order[own] = text.order(placed[at[own] - 1], placed[at[own]])
        first = np.ones(len(placed), bool)
        first[at] = order != 0
        suffixes = suffixes.copy()
        suffixes[more], new[more] = placed, first
    return suffixes, new


def extensions(least: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """least: what each suffix shares with the one before it in a sorted order. Gives what the suffixes at two places, x before y, share."""
    levels = [least]
    while 2 << (len(levels) - 1) <= len(least):
        step = 1 << (len(levels) - 1)
        levels.append(np.append(np.minimum(levels[-1][:-step], levels[-1][step:]), levels[-1][len(least) - step :]))
    table = np.stack(levels)
    power = np.frexp(np.arange(len(least) + 1))[1] - 1  # of two, at most a distance

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = power[y - x]
        return np.minimum(table[k, x + 1], table[k, y + 1 - (1 << k)])

    return shared


def flag_equal(text: HashedText, group: np.ndarray, mark: np.ndarray, least: np.ndarray, most: np.ndarray, window: np.ndarray, flags: np.ndarray) -> None:
    """Flags each window that equals another one. An occurrence of a group's mark, by groups, has the windows whose first mark it is: they begin least to most
    bytes before it, window is the number of the one that begins with it.

    The suffixes at the marks alone are sorted. The order of those that begin one byte earlier follows from theirs and that byte (induced sorting): suffixes
    at all windows are placed without being compared. Equal windows have equal bytes before the mark (a class) and are neighbours among those of their class
    that have a window so far before the mark. An occurrence alone in its class is so at all places further ahead, too, and leaves."""
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    kind = (np.cumsum(np.bincount(begin, minlength=len(group))) - 1).astype(np.uint16 if len(begin) < 1 << 16 else np.uint32)
    by_mark = np.argsort(mark)
    order = by_mark[np.searchsorted(mark, sorted_groups(text, mark, begin)[0], sorter=by_mark)]
    shared = extensions(np.append(np.uint8(0), text.shared(mark[order[:-1]], mark[order[1:]])))
    # from here on, occurrences have the numbers of the sorted order
    mark, kind, least, most, window = (x[order] for x in (mark, kind, least, most, window))
    now, before = np.arange(len(order)), kind.astype(np.int64)
    for place in range(text.window):
        now = now[most[now] >= place]
        first = before[now]
        if place:
            byte = text.text[mark[now] - place]
            to = np.argsort(byte, kind="stable")
            to = to[np.argsort(kind[now[to]], kind="stable")]
            now, first, byte = now[to], first[to], byte[to]
            new = np.concatenate(([True], (first[1:] != first[:-1]) | (byte[1:] != byte[:-1])))[: len(now)]
        else:
            new = np.concatenate(([True], first[1:] != first[:-1]))[: len(now)]
        alone = new & np.append(new[1:], True)[: len(now)]
        before[now] = np.cumsum(new)
        now = now[~alone]
        if not len(now):
            return
        own = now[least[now] <= place]
        x, y = own[:-1], own[1:]
        near = np.flatnonzero(before[x] == before[y])
        x, y = x[near], y[near]
        same = shared(x, y) >= text.window - place
        flags[window[x[same]] - place] = flags[window[y[same]] - place] = True


def repeated_windows(texts: list[bytes], mark: np.ndarray, first: np.ndarray, copies: np.ndarray) -> list[np.ndarray | None]:
    """Per piece, its windows that start twice or more as (start, stop, ...); None where there are none."""
    lens = np.array([len(x) for x in texts])
    stop = np.cumsum(lens)
    start = stop - lens
    buf = np.frombuffer(b"".join([*texts, bytes(WINDOW)]), np.uint8)  # so that each suffix has a whole window
    windows = lens - WINDOW + 1
    ends = np.cumsum(windows)
    flags = np.repeat(copies > 1, windows)
    at = np.flatnonzero(grams(buf.astype(np.uint64), BYTES.gram).view(np.int64)[: stop[-1]] == np.repeat(mark, lens))
    piece = np.searchsorted(stop, at, "right")
    inside = at + BYTES.gram <= stop[piece]
    at, piece = at[inside], piece[inside]
    earlier = np.concatenate(([False], piece[1:] == piece[:-1]))[: len(at)]  # a window's place is that of its first mark
    most = np.minimum(at - np.where(earlier, np.append(-1, at[:-1])[: len(at)] + 1, start[piece]), WINDOW - BYTES.gram)
    least = np.maximum(0, at + WINDOW - stop[piece])
    group = np.concatenate(([0], np.cumsum(mark[1:] != mark[:-1])))[piece]
    own = least <= most
    own &= np.bincount(group[own], minlength=len(texts))[group] > 1
    if own.any():
        number = (ends - windows - start)[piece] + at
        flag_equal(HashedText(buf), *(x[own] for x in (group, at, least, most, number)), flags)
    found = flag_runs(np.concatenate(([False], np.insert(flags, ends[:-1], False)))) - 1  # pieces kept apart, so that no run crosses
    owner = np.searchsorted(ends + np.arange(len(ends)), found[:, 0], "right")
    found -= (ends - windows + np.arange(len(ends)))[owner][:, None]
    cuts = np.searchsorted(owner, np.arange(len(ends) + 1))
    return [found[i:j].ravel() if j > i else None for i, j in zip(cuts, cuts[1:], strict=False)]


def intervals(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """h1, h2, spans: per text, its repeated windows as (a, b)."""
    met = rows.join(verdicts, ["mark", "p1", "p2"])
    ends = F.expr("transform(sequence(0, size(verdict) - 2, 2), i -> struct(start + verdict[i] as a, start + verdict[i + 1] as b))")
    return met.select(*KEY, F.explode(ends).alias("span")).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))


def judged(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """h1, h2, n_bytes, n_removed, n_spans, kept_sha256 of each distinct text."""
    joined = texts.join(spans, KEY, "left").select(*KEY, F.col("text").cast("binary").alias("text"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for x, a, e in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    gone = cover(len(x), np.array([a or [], e or []], np.int64).T, WINDOW)
                    kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
                    out.append((len(x), int(gone.sum()), len(flag_runs(gone)), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in zip(*out, strict=True))], ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(cut_out, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    texts = distinct_texts(docs)
    rows = cut(marked(texts, BYTES), "runs")
    spots = cut(shared_runs(rows, "n > 1"), "spots")
    verdicts = cut(by_shard(pieces(texts, spots, BYTES, True), repeated_windows, "array<long>", SHARD_BYTES, len), "verdicts")
    results = judged(texts, intervals(pieces(texts, spots, BYTES, False), verdicts)).withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    d = keyed(docs).select("doc_id", *KEY).join(results, F.expr("h1 = _h1 and h2 = _h2"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
