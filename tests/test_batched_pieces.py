"""Sub-words a batch at a time: expected counts as for one word after the other, ids in order whatever the rows."""

import math
import random

import numpy as np
import pyarrow as pa

from sonolake.functions import tokens
from sonolake.operators import lm


def test_expected_counts_of_a_batch_are_those_of_its_words():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé日", k=rng.randrange(1, 14))) for _ in range(500)] + ["a" * 300, "b"]
    score = {w[i : i + n]: -1 - 8 * rng.random() for w in words[:60] for i in range(len(w)) for n in (1, 2, 3, 8) if i + n <= len(w)}
    del score["日"]
    times, want = [rng.randrange(1, 9) for _ in words], {}
    for w, c in zip(words, times, strict=True):
        for p, x in lm.expected_pieces(w, score, 8):
            want[p] = want.get(p, 0.0) + c * x
    sums = lm.PieceSums(score, 8)
    for part in (slice(0, 200), slice(200, None)):
        sums.add(pa.array(words[part]), np.array(times[part], float))
    got = sums.found()
    assert got.keys() <= want.keys() and "日" in got
    assert all(math.isclose(x, got.get(p, 0.0), rel_tol=1e-9, abs_tol=1e-9) for p, x in want.items())
    assert lm.PieceSums({}, 8).found() == {}


def test_words_are_split_where_they_lie(spark, monkeypatch):
    v = spark.createDataFrame([("a", -1.0), ("ab", -1.5), ("b", -2.0)], "piece string, score double")
    rows = [(1, ["ab", None, "a"]), (1, ["b", "c", "ba"]), (2, []), (3, None), (4, [None]), (5, ["ab"] * 1000)]
    d = spark.createDataFrame(rows, "id long, words array<string>").coalesce(1)
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 4)
    found = tokens.tokenised(d, v, "id")
    # ids 1 a, 2 ab, 3 b; rows of one key by position
    assert {r.id: r.ids for r in found.collect()} == {1: [2, 3, 0, 1, 3, 1], 5: [2] * 1000}
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan, "no word is moved"
    drawn = tokens.sampled(d, v, "id", share=0.5)
    text = {r.id: r.text for r in tokens.decoded(drawn, v, "id").collect()}
    assert text == {1: "abbaba", 5: "ab" * 1000}
    assert {tuple(r.ids) for r in tokens.sampled(d.where("id = 5"), v, "id", theta=0.0).collect()} != {(2,) * 1000}
