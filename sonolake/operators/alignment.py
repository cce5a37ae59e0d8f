"""Alignment of long sequences: the edit path in linear memory, and longest matching blocks without comparing all pairs.

Sequences are arrays of whole numbers (see numbered). Both give exactly what the plain forms give, ties included.
"""

from __future__ import annotations

import difflib
import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

#: Cells of the distance table that are kept at once; beyond, rows are kept as marks from which a part is computed again.
CELLS = 1 << 22
#: Parts into which a stretch of rows is cut by marks.
PARTS = 16
#: Pairs of equal word pairs that are looked at together.
PAIRS = 1 << 20
#: Lengths of the blocks that are looked for together, powers of two.
GRAMS = (32, 16, 8, 4, 2)
#: Gaps of so many pairs of elements are left to difflib.
SMALL = 256


#: Rows of the distance table that one pass keeps as bits of a number; longer references take several passes.
STRIP = 1 << 13


def distance(ref: list[int], hyp: list[int]) -> int:
    """The edit distance of two sequences, by bit-parallel columns: differences of neighbouring cells are bits of whole numbers (Myers;
    Hyyro for strips of rows, which hand their lower edge's differences on to the next)."""
    while ref and hyp and ref[-1] == hyp[-1]:
        ref, hyp = ref[:-1], hyp[:-1]
    same = next((i for i, (x, y) in enumerate(zip(ref, hyp, strict=False)) if x != y), min(len(ref), len(hyp)))
    ref, hyp = ref[same:], hyp[same:]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    edge = [1] * len(hyp)  # differences along the row above, from cell to cell
    for lo in range(0, len(ref), STRIP):
        strip = ref[lo : lo + STRIP]
        places: dict[int, int] = {}
        for i, x in enumerate(strip):
            places[x] = places.get(x, 0) | 1 << i
        every, last = (1 << len(strip)) - 1, len(strip) - 1
        up, down = every, 0  # where a cell is one more, or one less, than the cell above it
        for j, y in enumerate(hyp):
            match = places.get(y, 0)
            above = edge[j]
            start = match | 1 if above < 0 else match
            diagonal = (((start & up) + up) ^ up) | start
            right, left = (down | ~(diagonal | up)) & every, up & diagonal
            edge[j] = (right >> last & 1) - (left >> last & 1)
            right, left = right << 1 | (above > 0), left << 1 | (above < 0)
            match |= down
            up, down = (left | ~(match | right)) & every, right & match & every
    return len(ref) + sum(edge)


def numbered(*sides: Iterable[str]) -> list[np.ndarray]:
    """Equal words of the sides as equal numbers."""
    known: dict[str, int] = {}
    return [np.array([known.setdefault(x, len(known)) for x in side], np.int64) for side in sides]


class _Band:
    """The distance table inside the diagonals that an optimal path can reach: with d edits there are at most (d + m - n) / 2 insertions
    and (d - m + n) / 2 deletions. A row is an array over diagonals: at k stands the cell of column row + k - low."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray):
        self.ref, self.n, self.m = ref, len(ref), len(hyp)
        d = distance(ref.tolist(), hyp.tolist())
        self.low, self.high = (d - self.m + self.n) // 2, (d + self.m - self.n) // 2
        self.width = self.low + self.high + 1
        self.hyp = np.concatenate((np.full(self.low, -1), hyp, np.full(self.high + self.n + 1, -1)))
        self.steps = np.arange(self.width, dtype=np.int32)

    def top(self) -> np.ndarray:
        column = self.steps - self.low
        return np.where(column >= 0, column, 1 << 29).astype(np.int32)

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i from row i - 1."""
        cost = row + (self.hyp[i - 1 : i - 1 + self.width] != self.ref[i - 1])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        return (np.minimum.accumulate(cost - self.steps) + self.steps).astype(np.int32)

    def rows(self, row: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, rows) of stretches of lo to hi, the last stretch first; each begins with the row that the one before it ends with. row: row lo."""
        if (hi - lo) * self.width <= CELLS or hi - lo < 2 * PARTS:
            kept = [row]
            for i in range(lo + 1, hi + 1):
                kept.append(self.after(kept[-1], i))
            yield lo, kept
            return
        step = -(-(hi - lo) // PARTS)
        marks = [(lo, row)]
        for i in range(lo + 1, hi + 1 - step):
            row = self.after(row, i)
            if (i - lo) % step == 0:
                marks.append((i, row))
        if marks[-1][0] + step < hi:
            for i in range(hi + 1 - step, marks[-1][0] + step + 1):
                row = self.after(row, i)
            marks.append((marks[-1][0] + step, row))
        for at, start in reversed(marks):
            yield from self.rows(start, at, min(at + step, hi))


def edit_path(ref: np.ndarray, hyp: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(op, ref index, hyp index) from the end, with unit costs; ties prefer substitution (S), then insertion (I), then deletion (D); C is
    an equal pair. Memory is linear in the sequences: CELLS, and PARTS rows for each level of marks."""
    i, j = len(ref), len(hyp)
    while i and j and ref[i - 1] == hyp[j - 1]:  # an equal pair is always taken, so equal ends need no table
        i, j = i - 1, j - 1
        yield "C", i, j
    band = _Band(ref[:i], hyp[:j])
    for first, rows in band.rows(band.top(), 0, i):
        while i > first or (first == 0 and j > 0):
            k = j - i + band.low
            if i and j and ref[i - 1] == hyp[j - 1]:
                op = "C"
            else:
                here = rows[i - first][k]
                if i and j and here == rows[i - 1 - first][k] + 1:
                    op = "S"
                elif j and (not i or (k > 0 and here == rows[i - first][k - 1] + 1)):
                    op = "I"
                else:
                    op = "D"
            i, j = i - (op != "I"), j - (op != "D")
            yield op, i, j


def _grams(a: np.ndarray, b: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of GRAMS, numbers of the runs of so many elements of a and of b; equal runs have equal numbers."""
    n, out, x, size = len(a), {}, np.concatenate((a, [-1], b)), 1
    while size <= max(GRAMS):
        out[size] = x[: max(0, n - size + 1)], x[n + 1 :]
        pairs = x[:-size] * (int(x.max()) + 2) + x[size:] if len(x) > size else x[:0]
        x, size = np.unique(pairs, return_inverse=True)[1], 2 * size
    return out


def _runs(grams: dict, gap: tuple[int, int, int, int], size: int) -> list[tuple[int, int, int]]:
    """(-length, i, j) of all maximal diagonal runs of size or more equal elements inside a gap."""
    a_lo, a_hi, b_lo, b_hi = gap
    if min(a_hi - a_lo, b_hi - b_lo) < size:
        return []
    x, y = grams[size][0][a_lo : a_hi - size + 1], grams[size][1][b_lo : b_hi - size + 1]
    a, b = grams[1][0][a_lo:a_hi], grams[1][1][b_lo:b_hi]
    before, after, other_before, other_after = (np.concatenate(z) for z in (([-1], a), (a, [-1]), ([-2], b), (b, [-2])))
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    lo = np.searchsorted(ranked, x, "left")
    counts, starts, ends, at = np.searchsorted(ranked, x, "right") - lo, [], [], 0
    total = np.cumsum(counts)
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = order[np.repeat(lo[at:to] - (np.cumsum(n) - n), n) + np.arange(len(i))]
        opens, closes = before[i] != other_before[j], after[i + size] != other_after[j + size]
        starts.append(np.stack([j[opens] - i[opens], i[opens]]))
        ends.append(np.stack([j[closes] - i[closes], i[closes]]))
        at = to
    first, last = (np.concatenate(z, axis=1) for z in (starts, ends))
    first, last = first[:, np.lexsort(first[::-1])], last[:, np.lexsort(last[::-1])]  # the k-th start of a diagonal has its k-th end
    return list(zip((first[1] - last[1] - size).tolist(), (first[1] + a_lo).tolist(), (first[1] + first[0] + b_lo).tolist(), strict=True))


def _divide(grams: dict, gap: tuple[int, int, int, int], size: int) -> tuple[list, list]:
    """The blocks of size or more elements in a gap, and the gaps between them, where the longest left is shorter. Runs are taken from a heap; one
    that reaches beyond its gap is cut to the gaps it touches."""
    heap, blocks, gap_at, gaps = _runs(grams, gap, size), [], [gap[0]], [gap]
    heapq.heapify(heap)
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        k = max(0, bisect_right(gap_at, i) - 1)
        a_lo, a_hi, b_lo, b_hi = gaps[k]
        if i >= a_lo and j >= b_lo and i + length <= a_hi and j + length <= b_hi:
            blocks.append((i, j, length))
            gaps[k : k + 1] = [(a_lo, i, b_lo, j), (i + length, a_hi, j + length, b_hi)]
            gap_at[k : k + 1] = [a_lo, i + length]
            continue
        while k < len(gaps) and gaps[k][0] < i + length:
            a_lo, a_hi, b_lo, b_hi = gaps[k]
            skip = max(0, a_lo - i, b_lo - j)
            left = min(i + length, a_hi, b_hi - j + i) - (i + skip)
            if left >= size:
                heapq.heappush(heap, (-left, i + skip, j + skip))
            k += 1
    return blocks, gaps


def matching_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, length) in order: the longest block of equal elements, of equally long ones the first in a, then in b; then the same before and
    after it. Long blocks are found first, through numbers of runs of the greatest length of GRAMS, and only inside the gaps between them shorter
    ones, so that common elements far apart never meet."""
    grams, sizes, blocks = _grams(a, b), sorted(GRAMS, reverse=True), []
    gaps = [(0, len(a), 0, len(b), 0)]
    while gaps:
        a_lo, a_hi, b_lo, b_hi, level = gaps.pop()
        if a_lo == a_hi or b_lo == b_hi:
            continue
        if (a_hi - a_lo) * (b_hi - b_lo) <= SMALL:
            found = difflib.SequenceMatcher(None, a[a_lo:a_hi].tolist(), b[b_lo:b_hi].tolist(), autojunk=False).get_matching_blocks()
            blocks += [(i + a_lo, j + b_lo, n) for i, j, n in found if n]
        elif level < len(sizes):
            new, rest = _divide(grams, (a_lo, a_hi, b_lo, b_hi), sizes[level])
            blocks += new
            gaps += [(*g, level + 1) for g in rest]
        else:  # only blocks of one element are left: the first of a that b has, at its first place, and so on after it
            places = defaultdict(list)
            for j, y in enumerate(b[b_lo:b_hi].tolist(), b_lo):
                places[y].append(j)
            for i, x in enumerate(a[a_lo:a_hi].tolist(), a_lo):
                if (own := places.get(x)) and (k := bisect_left(own, b_lo)) < len(own):
                    blocks.append((i, own[k], 1))
                    b_lo = own[k] + 1
    return sorted(blocks)


def matched(a: np.ndarray, b: np.ndarray, substitutions: bool) -> Iterator[tuple[int, int, bool]]:
    """(i, j, equal) of the elements of matching blocks and, with substitutions, of the stretches between them that are equally long."""
    at, by = 0, 0
    for i, j, length in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if substitutions and i - at == j - by:
            yield from ((at + d, by + d, False) for d in range(i - at))
        yield from ((i + d, j + d, True) for d in range(length))
        at, by = i + length, j + length
