"""Sub-word sampling: shares of all splits, round trips, unknown characters, draws that a second run repeats."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sonolake.functions import tokens

PIECES = {"a": -1.0, "b": -1.5, "n": -1.2, "an": -0.7, "na": -0.9, "ban": -2.0, "ana": -1.1}


def vocabulary(spark):
    return spark.createDataFrame(list(PIECES.items()), "piece string, score double")


def splits(word):
    if not word:
        yield ()
    for i in range(1, len(word) + 1):
        if word[:i] in PIECES:
            yield from ((word[:i], *rest) for rest in splits(word[i:]))


def numbers():
    return [p for p, _ in sorted(PIECES.items(), key=lambda x: (-x[1], x[0]))]


@pytest.mark.parametrize("theta", [0.0, 0.5, 1.0])
def test_draws_follow_the_weights_of_all_splits(spark, theta):
    n = 20_000
    d = spark.range(n).select("id", F.array(F.lit("banana")).alias("words"))
    got = Counter(tuple(numbers()[i - 1] for i in r.ids) for r in tokens.sampled(d, vocabulary(spark), "id", theta=theta).collect())
    weight = {s: math.exp(theta * sum(PIECES[p] for p in s)) for s in splits("banana")}
    total = sum(weight.values())
    assert sum(got.values()) == n and set(got) <= set(weight) and len(weight) > 8
    for s, w in weight.items():
        share = w / total
        assert abs(got[s] / n - share) < 5 * math.sqrt(share * (1 - share) / n), s


def test_forward_sums_equal_all_splits():
    for theta in (0.1, 1.0):
        whole = math.log(sum(math.exp(theta * sum(PIECES[p] for p in s)) for s in splits("bananabana")))
        assert abs(tokens.forward("bananabana", PIECES, 32, theta)[-1] - whole) < 1e-9


def test_no_share_is_the_best_split_and_some_share_mixes(spark):
    d = spark.range(3000).select("id", F.expr("array('banana', 'nab')").alias("words"))
    v = vocabulary(spark)
    best = {r.id: r.ids for r in tokens.tokenised(d, v, "id").collect()}
    assert {r.id: r.ids for r in tokens.sampled(d, v, "id", share=0.0).collect()} == best
    some = {r.id: r.ids for r in tokens.sampled(d, v, "id", share=0.3).collect()}
    differ = sum(some[k] != best[k] for k in best) / len(best)
    assert len(some) == 3000 and 0.2 < differ < 1 - 0.7**2 + 0.05
    assert some == {r.id: r.ids for r in tokens.sampled(d.repartition(5), v, "id", share=0.3).collect()}
    assert some != {r.id: r.ids for r in tokens.sampled(d, v, "id", share=0.3, seed=2).collect()}


def test_unknown_characters_empty_rows_and_long_words(spark):
    d = spark.createDataFrame([(1, ["bxa"]), (2, []), (3, None), (4, ["", "a"]), (5, ["ban" * 3000]), (6, [None, "b"])], "id long, words array<string>")
    v = vocabulary(spark)
    got = {r.id: r.ids for r in tokens.sampled(d, v, "id").collect()}
    number = {p: i for i, p in enumerate(numbers(), 1)}
    assert got[1] == [number["b"], 0, number["a"]] and got[4] == [number["a"]] and got[6] == [number["b"]] and set(got) == {1, 4, 5, 6}
    assert "".join(numbers()[i - 1] for i in got[5]) == "ban" * 3000
    text = tokens.decoded(tokens.sampled(d, v, "id"), v, "id").collect()
    assert {r.id: len(r.text) for r in text} == {1: 2, 4: 1, 5: 9000, 6: 1}
    with pytest.raises(ValueError, match="share"):
        tokens.sampled(d, v, "id", share=1.5)
