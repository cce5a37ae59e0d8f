"""Grams are combined in tasks far smaller than a split of the texts."""

import re
from collections import Counter

import pytest

from sonolake.operators import lm
from sonolake.plans import catalogue
from sonolake.tables import spread


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_grams_and_counts(spark, n):
    lists = [list("abcabdaacb"), list("abc"), ["x", "y"], ["a"], [], None, ["a", None, "b", "c"]]
    found = lm.ngrams(spark.createDataFrame([(x,) for x in lists], "words array<string>"), n).collect()
    wanted = Counter(" ".join(w for w in x[i : i + n] if w is not None) for x in lists if x for i in range(len(x) - n + 1))
    assert {r.gram: r.c for r in found} == wanted and len(found) == len(wanted)


def test_spread_by_splits(spark):
    df = spark.range(100, numPartitions=6)
    assert [spread(df).rdd.getNumPartitions(), spread(df, 16).rdd.getNumPartitions(), spread(df.coalesce(1)).rdd.getNumPartitions()] == [6, 96, 4]
    assert spread(df, 16).agg({"id": "sum"}).first()[0] == 4950


def test_counts_are_combined_in_small_tasks(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 9))) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    splits = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
    counts = catalogue.QUERIES["ngram_counts"](spark, str(tmp_path))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    dealt = [int(x) for x in re.findall(r"RoundRobinPartitioning\((\d+)\)", plan)]
    assert dealt and max(dealt) >= 16 * splits
    assert "lambdafunction" not in plan and plan.count("split(text") == 1  # compiled, and a text is split once
    words = [t.split() for _, t in texts]
    assert {r.gram: r.c for r in counts.collect()} == Counter(" ".join(w[i : i + 3]) for w in words for i in range(len(w) - 2))
