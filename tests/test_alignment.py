"""Alignment of long sequences gives what the plain forms give, in memory that is linear in them."""

import difflib
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolake.operators import alignment, errorrate, timing

WORDS = st.lists(st.sampled_from("abcd"), max_size=30)


def plain_path(ref, hyp):
    table = [list(range(len(hyp) + 1))]
    for i, r in enumerate(ref, 1):
        table.append([i])
        for j, h in enumerate(hyp, 1):
            table[i].append(min(table[i - 1][j - 1] + (r != h), table[i][j - 1] + 1, table[i - 1][j] + 1))
    i, j = len(ref), len(hyp)
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            op = "C"
        elif i and j and table[i][j] == table[i - 1][j - 1] + 1:
            op = "S"
        elif j and table[i][j] == table[i][j - 1] + 1:
            op = "I"
        else:
            op = "D"
        i, j = i - (op != "I"), j - (op != "D")
        yield op, i, j


@given(WORDS, WORDS, st.sampled_from([1, 60, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_path_has_the_same_ties(a, b, cells):
    kept = alignment.CELLS
    try:
        alignment.CELLS = cells
        assert list(alignment.edit_path(*alignment.numbered(a, b))) == list(plain_path(a, b))
    finally:
        alignment.CELLS = kept


@given(WORDS, WORDS, st.sampled_from([0, 30, 256]), st.sampled_from([3, 1 << 20]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_blocks_are_difflib_s(a, b, small, pairs, edited):
    kept = alignment.SMALL, alignment.PAIRS
    b = [x for i, x in enumerate(a) if (i * 7 + len(b)) % 5] if edited else b
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    want = [(i + d, k + d, op == "equal") for op, i, j, k, m in matcher.get_opcodes() if op == "equal" or (op == "replace" and j - i == m - k) for d in range(j - i)]
    try:
        alignment.SMALL, alignment.PAIRS = small, pairs
        assert list(alignment.matched(*alignment.numbered(a, b), True)) == want
        assert list(alignment.matched(*alignment.numbered(a, b), False)) == [x for x in want if x[2]]
    finally:
        alignment.SMALL, alignment.PAIRS = kept


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.5)) % 9000}" + rng.choice(["", "", "", ",", ".", "?"]) for _ in range(20_000)]
    heard = []
    for w in words:
        r = rng.random()
        heard += [] if r < 0.05 else ["zz"] if r < 0.15 else [w, w] if r > 0.93 else [w.rstrip(",.?")] if r > 0.85 else [w]
    return words, heard


def test_documents_of_20_000_words(spark, texts):
    words, heard = texts
    x, y = alignment.numbered(words, heard)
    tracemalloc.start()
    path = list(alignment.edit_path(x, y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, "the table has 400 million cells"
    assert sum(op != "C" for op, *_ in path) == alignment.distance(x.tolist(), y.tolist())
    ops = errorrate.mark_operations(spark.createDataFrame([(1, " ".join(words), " ".join(heard)), (2, None, "a."), (3, "", "")], "utt long, ref string, hyp string"))
    rates = {r.mark: r for r in errorrate.mark_rates(ops).collect()}
    assert set(rates) == {",", ".", "?", None} and 0.7 < rates[None].correct < 0.95
    side = lambda w: spark.createDataFrame([(1, i, x) for i, x in enumerate(w)], "file long, seq long, word string")
    found = timing.aligned_words(side(words), side(heard)).collect()
    assert all(words[r.ref_seq] == heard[r.hyp_seq] == r.word for r in found if r.word is not None)
    assert len(found) > 0.85 * len(words)
