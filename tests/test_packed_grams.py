"""The packed model and its scores against the same from plain joins and windows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from sonolake.operators import lm, packed


def texts(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    place = lambda k: (vocabulary * rng.random(k) ** 3).astype(int)  # noqa: E731  some words are frequent
    rows = [[f"w{i}é" for i in place(int(rng.integers(0, 30)))] for _ in range(n)]
    return [*rows, [], None, ["alone"], ["two", "words"], rows[0], ["w0é"] * 12]


@pytest.fixture(scope="module")
def corpora(spark):
    frame = lambda rows: spark.createDataFrame([(i if i != 3 else None, x) for i, x in enumerate(rows)], "id long, words array<string>").repartition(3).cache()
    return frame(texts(1, 120, 40)), frame(texts(2, 60, 55) + [["unknown", "w1é", "words"], ["w1é", "unknown", "w2é", "w3é"]])


@pytest.mark.parametrize("order, share", [(2, 1000), (2, 8), (3, 8), (4, 1000), (4, 8), (4, 1)])
def test_model_and_scores_are_those_of_joins(corpora, order, share):
    words, asked = corpora
    model, backoff = lm.kneser_ney(words, order)
    compact = packed.count_grams(words, order, share=share)
    assert len(compact.names) <= 2 * share and (share == 1000 or 0 < len(compact.names) < 40 or share == 1)
    want = {(r.n, r.context, r.word): r.p for r in model.collect()}
    rows = packed.model_rows(compact).collect()
    got = {(r.n, r.context, r.word): r.p for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    best = {r.id: r for r in lm.scored(asked, model, backoff, "id", order).collect()}
    mine = packed.scored(asked, compact, "id").collect()
    assert len(mine) == len(best) and None in best
    assert all(r.n == best[r.id].n and abs(r.log_prob - best[r.id].log_prob) < 2e-6 for r in mine)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, words array<string>")
    model = packed.count_grams(none)
    assert packed.model_rows(model).count() == packed.scored(none, model, "id").count() == 0
    said = spark.createDataFrame([(1, ["a", "b"])], "id long, words array<string>")
    assert [(r.n, r.log_prob) for r in packed.scored(said, model, "id").collect()] == [(2, round(2 * math.log(1e-7), 6))]


def test_packed_columns():
    columns = [np.array([0, 1, 2**32 - 1, 7]), np.array([3, 256, 65536, 0])]
    assert packed.unsqueeze(packed.squeeze(columns), 2, 4).tolist() == [x.tolist() for x in columns]
    words = pa.array([f"w{i}" for i in range(3000)])
    for n in (5, 3000):  # few and many of the words
        coded = [np.arange(n) % 4, np.arange(n)[::-1]]
        rows = packed.blobs(np.arange(n) % 3, words, coded, [np.arange(n) + 5], np.arange(3001))
        names, maps, c1 = packed.unified(rows)
        a, b, c = packed.unpacked(rows, maps, 2, 1)
        said = lambda x: None if x == 0 else names[int(x) - 1].as_py()
        assert {(said(x), said(y), int(z)) for x, y, z in zip(a, b, c, strict=True)} == {(words[i % 4 - 1].as_py() if i % 4 else None, words[n - 2 - i].as_py() if n - 1 - i else None, i + 5) for i in range(n)}
        assert all(c1[k + 1] == int(names[k].as_py()[1:]) + 1 for k in range(len(names)))


def test_a_gram_moves_in_few_bytes(spark):
    """Rows of strings took some forty bytes a gram, each time."""
    rng = np.random.default_rng(3)
    rows = [([f"word{i}" for i in (20_000 * rng.random(500) ** 4).astype(int)],) for _ in range(200)]
    words = spark.createDataFrame(rows, "words array<string>").coalesce(1)
    grams = packed.gathered(words, 4, "words", pa.array([], pa.string()), 4)
    held = grams.selectExpr("sum(n)", "sum(length(heads) + length(words) + length(codes))").first()
    assert held[0] > 95_000 and held[1] < 9 * held[0]
    model = packed.count_grams(words)
    held = packed.grams_of(model).selectExpr("sum(n)", "sum(length(heads) + length(words) + length(codes))").first()
    assert held[0] > 95_000 and held[1] < 11 * held[0]


def test_the_queries_join_no_grams_of_the_model(spark, tmp_path):
    from sonolake.plans import catalogue

    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i % 19))) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["ngram_model"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_scores_join_only_what_partitions_leave_open(spark, tmp_path):
    """Joins of all grams and their answers made broadcasts that a small driver could not hold."""
    from sonolake.plans import catalogue

    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i % 19))) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    said = [(i, k, " ".join(f"w{(i * 3 + j * k) % 60}" for j in range(i % 9))) for i in range(20) for k in range(4)]
    spark.createDataFrame(said, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    scores = catalogue.QUERIES["ngram_score"](spark, str(tmp_path))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan and "Generate" not in plan
    assert scores.count() == sum(1 for *_, t in said if t)
