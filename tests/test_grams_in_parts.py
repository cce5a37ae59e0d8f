"""Grams of a batch are combined in bounded parts."""

import pyarrow as pa
import pytest

from sonolake.operators import lm


@pytest.mark.parametrize("most", [1, 3, 7, 1 << 19])
def test_lists_in_parts(monkeypatch, most):
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", most)
    lists = pa.array([["a", "b"], None, [], ["c"] * 5, ["d"], ["e", "f"]], pa.list_(pa.string()))
    parts = list(lm.parts_of_lists(lists.slice(1))) + list(lm.parts_of_lists(lists.slice(0, 0)))
    assert [x for p in parts for x in p.to_pylist()] == lists.to_pylist()[1:]
    assert all(len(p.flatten()) <= most or len(p) == 1 for p in parts)


def test_a_bucketed_table_is_joined_where_it_lies(spark, monkeypatch):
    """The model joins what pairs know to all grams: only the pairs move."""
    from sonolake import tables

    moved, real = [], tables.bucketed
    monkeypatch.setattr(lm, "bucketed", lambda df, name, keys: moved.append((real(df, name, keys), keys)) or moved[-1][0])
    words = spark.createDataFrame([(list("abcabdaacb"),), (list("bca"),), ([],), (None,)], "words array<string>")
    model, backoff = lm.kneser_ney(words, 4)
    (grams, keys), = moved
    assert keys == ["r1", "r2"] and grams.count() == grams.distinct().count() > 0
    assert backoff.count() == backoff.select("context").distinct().count() == model.where("n > 1").select("context").distinct().count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = grams.join(grams.groupBy("r1").count().join(grams.select("r1", "r2").distinct(), "r1"), keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "r4" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "Bucketed: true" in plan
