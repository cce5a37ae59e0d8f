"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

from sonolake.llm import neardup

DOCS = "doc_id long, text string, source string"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def planted():
    rng = random.Random(4)
    texts = []
    for g in range(60):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(90, 400))]
        texts.append(" ".join(words))
        for share in (0.004, 0.008, 0.012, 0.03, 0.06):  # about 0.96 to 0.55 of the shingles
            texts.append(" ".join(edited(rng, words, max(1, round(share * len(words))))))
    return texts


def test_near_copies_as_brute_force(spark):
    from sonolake.llm import neardup

    texts = planted()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    label = classes(texts)
    least = {}
    for i, x in enumerate(label):
        least[x] = min(i, least.get(x, i))
    want, got = set(least.values()), {r.doc_id for r in neardup.keep_first(docs).collect()}
    assert want <= got, "what brute force keeps stays"
    assert len(got - want) <= 0.03 * (len(texts) - len(want)), "recall"


def test_a_large_group_is_one_class(spark, monkeypatch):
    from sonolake.llm import neardup

    monkeypatch.setattr(neardup, "PIECE", 128)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, words, 1)), "s") for i in range(1500)]
    i, j, d, lead = neardup.bucket_edges(np.array([neardup.fingerprint(neardup.shingles(t.encode())) for _, t, _ in rows]), np.zeros(1500, int))
    assert len(i) < 3 * len(rows)
    assert [r.doc_id for r in neardup.keep_first(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_forest_joins_by_least_distance():
    from sonolake.llm import neardup

    got = neardup.forest(4, np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([5, 1, 2, 9]))
    assert sorted(got.tolist()) == [1, 2, 3]


def test_pipeline_stage_takes_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"v{i}" for i in range(150)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(edited(rng, words, 2)), "s"), (3, " ".join(edited(rng, words, 60)), "s"), (4, None, "s"), (5, "", "s")]
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {1, 3, 4}
    assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_rows_stay_by_id_and_text(spark):
    from sonolake.llm import neardup

    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a, "s"), (2, " ".join(edited(rng, a.split(), 1)), "s"), (2, b, "s"), (2, b, "s"), (None, c, "s"), (None, c, "s"), (None, b, "s")]
    got = neardup.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == sorted([(1, a), (2, b), (0, c)])


@pytest.mark.parametrize("size", [1_200, 2_000, 4_000, 10_000])
def test_large_buckets_lose_no_partner(size):
    """A bucket of unrelated fingerprints, each with one partner 8 bits away."""
    rng = np.random.default_rng(size)
    own = rng.integers(0, 2**63, (size // 2, 2), dtype=np.uint64)
    flip = np.zeros((size // 2, 128), np.uint8)
    for row in flip:
        row[rng.choice(128, 8, replace=False)] = 1
    fps = np.concatenate((own, own ^ np.packbits(flip, axis=1, bitorder="little").view("<u8")))
    order = rng.permutation(size)
    i, j, d, lead = neardup.bucket_edges(np.ascontiguousarray(fps[order]), np.zeros(size, np.int64))
    met = {frozenset((int(order[a]), int(order[b]))) for a, b, x in zip(i, j, lead, strict=True) if not x}
    assert sum(frozenset((k, k + size // 2)) in met for k in range(size // 2)) >= 0.99 * (size // 2)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_groups_and_pairs_give_the_same_classes(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "GROUP_BYTES", limit)
    rng = np.random.default_rng(5)
    rows, want = [], []
    for c in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(6):
            text = list(base)
            text[int(rng.integers(0, 120))] = f"own{c}x{k}"
            rows.append((c * 100 + k, " ".join(text)))
        rows += [(c * 100 + 50, rows[-1][1]), (None, rows[-2][1])]
        want.append(c * 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.keep_first(docs).collect()) == want


def test_bloom_filter_misses_no_key(spark):
    from sonolake.llm.common import bloom, maybe_in

    keys = spark.range(0, 60_000, 3).selectExpr("xxhash64(id) as k").union(spark.sql("select cast(null as bigint)"))
    filter_ = bloom(keys, "k", "test")
    assert filter_[1] == 5  # 16 bits for each of 20,001 keys
    assert maybe_in(keys, "k", filter_, "x").where("not x").count() == 0
    others = spark.range(1, 60_000, 3).selectExpr("xxhash64(id) as k")
    assert maybe_in(others, "k", filter_, "x").where("x").count() < 200
    assert maybe_in(others, "k", bloom(keys.limit(0), "k", "none"), "x").where("x").count() == 0


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    """What holds beyond the bound of the filter: every row is in doubt and is judged by the table."""
    from pyspark.sql import functions as F
    from sonolake.llm import neardup, secrets

    texts = planted()[:30] + ["", "", "token = abcdefgh12345678 and more"]
    docs = spark.createDataFrame([(i % 40, t, "s") for i, t in enumerate(texts + texts[:9])] + [(None, texts[0], "s"), (None, None, "s"), (None, None, "s"), (90, None, "s")], DOCS).repartition(3)
    rows = lambda d: sorted(map(str, d.collect()))
    near, clean = rows(neardup.keep_first(docs)), rows(secrets.redact(docs))
    assert len(clean) == docs.count() and any("[SECRET]" in r for r in clean)
    full = lambda d, key, filter_, name: d.withColumn(name, F.lit(True))
    monkeypatch.setattr(neardup, "maybe_in", full)
    monkeypatch.setattr(secrets, "maybe_in", full)
    assert rows(neardup.keep_first(docs)) == near
    assert rows(secrets.redact(docs)) == clean


def test_pairs_between_classes_stay_in_their_piece(spark, monkeypatch):
    """A group of texts that are all candidates of each other, most of them below 0.8: rows grow with its members, not with its pairs."""
    monkeypatch.setattr(neardup, "PIECE", 256)
    rng = random.Random(12)
    base = [f"v{i}" for i in range(300)]
    cores = [edited(rng, base, 9) for _ in range(150)]  # about 0.74 of each other
    texts = [" ".join(edited(rng, w, k)) for w in cores for k in (0, 2)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    own = neardup.scan(docs).select("node", "f0", "f1").distinct()
    text = docs.join(neardup.scan(docs).select("doc_id", "node"), "doc_id").select("node", "text")
    again = own.selectExpr("node", "f0", "f1", "node as label")
    members, pairs = neardup.members_apart(again, 300), neardup.bucket_pairs(again, 300).select("a", "b").distinct()
    assert members.count() <= 300 * len(neardup.tables(300)) * neardup.orders(300)
    assert pairs.count() > 3 * members.count() / len(neardup.tables(300)) > 0
    found = neardup.verified_pieces(members, text)
    assert found.count() < pairs.count() / 10
    least = lambda edges: {r.node: r.root for r in neardup.components(edges).collect()}
    assert least(found) == least(neardup.verified(pairs, text)) != {}, "the same classes as by all pairs"
