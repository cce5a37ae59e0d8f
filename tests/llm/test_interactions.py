"""The filter audit against plain Python, and its Bloom filter."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from sonolake.llm import interactions

DOCS = "doc_id long, text string, source string, part string, mask string, quality int"
PROSE = " ".join(f"word{i}" for i in range(60))
HOT = "copied text " + PROSE
TEXTS = (
    [(None, None, None), (0, "", None), (1, "", "a"), (2, PROSE, "a"), (3, PROSE, "b"), (3, PROSE, "b"), (4, PROSE + " #", "b"), (None, PROSE, "b"), (5, "say it again " * 30, "a"), (6, "SHOUT " + PROSE.upper(), "a")]
    + [(7, "\x0b\t \n", "a"), (8, "x " * 200_000, "b"), (9, PROSE + " É", ""), (10, None, "b"), (-5, PROSE, "c"), (11, "Straße ÀÉ", "c"), (12, "a|b", "c")] + [(100 + i, HOT, "abc"[i % 3]) for i in range(300)]
)
LABELS = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, 0, 1), (101, 1, 1), (None, 1, 1), (999, 1, 1), (102, None, 1)]


def brute(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if x}
        docs.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own, share = [x for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in own)
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(share[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


@pytest.mark.parametrize("counters", [interactions.MAX_COUNTERS, interactions.BLOCK])
def test_audit_is_the_simulation(spark, monkeypatch, counters):
    monkeypatch.setattr(interactions, "MAX_COUNTERS", counters)
    docs = spark.createDataFrame([(i, t, s, "part", "mask", 1) for i, t, s in TEXTS], DOCS).repartition(3)
    labels = spark.createDataFrame([(*x, "s") for x in LABELS], "doc_id long, quality int, toxic int, source string")
    got = interactions.digest(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(TEXTS, LABELS) and len(got) == 600 * 4
    assert interactions.digest(docs.limit(0), labels).count() == 0
    assert interactions.digest(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_sketch_clears_unique_texts_only(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id") + 10_000)).alias("text"))
    bits, blocks = interactions.repeat_bits(docs)
    flagged = interactions.with_repeats(docs, bits, blocks)
    assert blocks == 5 and flagged.count() == 20_000
    assert flagged.where("doc_id % 10 = 0 and not repeat").count() == 0, "a copy was cleared"
    assert flagged.where("doc_id % 10 <> 0 and repeat").count() < 200, "unique texts were not cleared"
    crowded = docs.sparkSession.range(1).select(F.lit(0).alias("block"), F.array_repeat(F.lit(-1).cast("long"), interactions.BLOCK // 64).alias("bits"))
    assert interactions.with_repeats(docs, crowded, 1).where("repeat").count() == 20_000
