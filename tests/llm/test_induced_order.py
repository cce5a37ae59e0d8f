"""Suffixes at the marks are sorted; all others follow from them."""

import itertools
from collections import Counter

import numpy as np
import pytest


def pieces_of(texts):
    """Equal pieces as one, by marks, as a shard gets them, and how often each string of WINDOW bytes starts."""
    from sonolake.llm import passages, suffixes

    found = Counter()
    for x in texts:
        mark, start, _ = passages.runs(x, suffixes.BYTES)
        stops = [*start[1:].tolist(), len(x) - suffixes.WINDOW + 1]
        found.update((int(m), x[s : e - 1 + suffixes.WINDOW]) for m, s, e in zip(mark, start, stops, strict=False))
    rows = sorted((m, p, n) for (m, p), n in found.items())
    return [r[1] for r in rows], np.array([r[0] for r in rows], np.int64), np.zeros(len(rows), np.int64), np.array([r[2] for r in rows], np.int64)


def passages_around(rng, n):
    """A passage that n texts embed, each with words of its own around it; periods, copies, edits and runs longer than a piece."""
    letters = lambda k, top=123: rng.integers(97, top, k).astype(np.uint8).tobytes()
    shared = letters(330)
    texts = [letters(int(rng.integers(0, 90))) + shared[int(rng.integers(0, 40)) : 330 - int(rng.integers(0, 60))] + letters(int(rng.integers(0, 90))) for _ in range(n)]
    texts += [b"ab" * 500, b"a" * 700, shared, shared, letters(600, 99), b"", b"a" * 199, (letters(61) * 12)[:650], shared[:250] + b"x" + shared[251:]]
    return texts + [texts[0][:210] + letters(40), texts[1][-220:]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_of_a_shard_against_brute_force(seed):
    from sonolake.llm import suffixes

    shard = pieces_of(passages_around(np.random.default_rng(seed), 40))
    times = Counter()
    for x, n in zip(shard[0], shard[3].tolist(), strict=True):
        times.update({x[i : i + 200]: 0 for i in range(len(x) - 199)})
        for i in range(len(x) - 199):
            times[x[i : i + 200]] += n
    for x, got in zip(shard[0], suffixes.repeated_windows(*shard), strict=True):
        want = [i for i in range(len(x) - 199) if times[x[i : i + 200]] > 1]
        assert [i for a, b in itertools.batched([] if got is None else got.tolist(), 2) for i in range(a, b)] == want


def test_only_suffixes_at_marks_are_compared(monkeypatch):
    """The cost of one mark's pieces, each different, does not grow with their windows: these are placed without being compared."""
    from sonolake.llm import suffixes

    compared, real = [], suffixes.HashedText.before
    monkeypatch.setattr(suffixes.HashedText, "before", lambda self, a, b, ties: compared.append(len(a)) or real(self, a, b, ties))
    shard = pieces_of(passages_around(np.random.default_rng(5), 300)[:300])
    windows = sum(len(x) - 199 for x in shard[0])
    assert suffixes.repeated_windows(*shard) and windows > 8 * len(shard[0]) and 0 < sum(compared) < windows


def test_shared_bytes(monkeypatch):
    from sonolake.llm import suffixes

    rng = np.random.default_rng(6)
    raw = rng.integers(97, 99, 900).astype(np.uint8)
    raw[300:600] = raw[:300]
    text, (a, b) = suffixes.HashedText(raw), rng.integers(0, 700, (2, 500))
    a[:50], b[:50] = np.arange(50), np.arange(50) + 300
    want = [next((k for k in range(200) if raw[i + k] != raw[j + k]), 200) for i, j in zip(a, b, strict=True)]
    assert text.shared(a, b).tolist() == want and 200 in want
    least = rng.integers(0, 200, 77).astype(np.uint8)
    shared = suffixes.extensions(least)
    x, y = np.array([(i, j) for i in range(77) for j in range(i + 1, 77)]).T
    assert shared(x, y).tolist() == [int(least[i + 1 : j + 1].min()) for i, j in zip(x, y, strict=True)]
