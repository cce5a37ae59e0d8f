"""Texts through Python functions: parts of bounded size, and only the texts that need it."""

import pyarrow as pa
from pyspark.sql import functions as F

from sonolake.functions import parts
from sonolake.functions import text as t


def test_parts_of_a_batch_are_bounded(monkeypatch):
    monkeypatch.setattr(parts, "BYTES_AT_ONCE", 10)
    seen, slices = [], []
    texts = pa.array(["abcd", None, "", "efghijklmnopq", "rs", "t" * 10, None])
    real = pa.array
    monkeypatch.setattr(parts.pa, "array", lambda x, *a: slices.append(sum(len(s or "") for s in x)) or real(x, *a))
    assert parts.in_parts(texts, lambda s: seen.append(s) or s.upper()).to_pylist() == ["ABCD", None, "", "EFGHIJKLMNOPQ", "RS", "T" * 10, None]
    assert seen == ["abcd", "", "efghijklmnopq", "rs", "t" * 10]
    assert slices == [4, 13, 2, 10], "at most 10 bytes or one text"
    assert parts.in_parts(real([], pa.string()), str.upper).to_pylist() == []


def test_python_gets_only_the_texts_that_need_it(spark):
    @F.arrow_udf("string")
    def known(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else f"<{s}>" if not s.isascii() else 1 // 0 for s in x.to_pylist()], pa.string())

    d = spark.createDataFrame([("plain",), ("é",), (None,)], "s string")
    assert [r.x for r in d.select(parts.only_where(F.col("s").rlike(r"[^\x00-\x7F]"), known, F.col("s")).alias("x")).collect()] == ["plain", "<é>", None]
    rows = spark.createDataFrame([("Été 12 Œ",), ("plain",), ("7",), (None,)], "s string")
    assert [r.x for r in rows.select(t.lower_pipeline(F.col("s"), " abcdefghijklmnopqrstuvwxyz").alias("x")).collect()] == ["ete twelve oe", "plain", "seven", None]
    assert [r.x for r in rows.select(t.strip_symbols(F.col("s")).alias("x")).collect()] == ["Ete 12 OE", "plain", "7", None]


def test_rules_run_only_where_one_is_found(spark):
    examples = [p.replace(r"\b", "") for p, _ in t.CONTRACTIONS]
    texts = [*examples, *(f"so {x} x" for x in examples), *(f"q{x}" for x in examples), "none of them", "", None, "l'été n'tis", "cuzco"]
    texts += [f"{short}. x" for short, _ in t.ABBREVIATIONS] + ["DR. No", "xdr. a", "mr x"]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    plain = F.col("s")
    for short, long in t.ABBREVIATIONS:
        plain = F.regexp_replace(plain, rf"(?iU)\b{short}\.", long)
    rows = d.select(t.where_found(F.col("s"), t.CONTRACTED, t.contract).alias("a"), t.contract(F.col("s")).alias("b"), t.expand_abbreviations(F.col("s")).alias("c"), plain.alias("d")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [r.c for r in rows] == [r.d for r in rows]
    guarded = t.where_found(F.col("s"), t.CONTRACTED, lambda x: F.raise_error(F.concat(F.lit("rules on: "), x)))
    assert [r.x for r in d.where("s in ('none of them', 'cuzco', '')").select(guarded.alias("x")).collect()] == ["none of them", "", "cuzco"]
