"""Operators of speech corpora against plain programs and golden cases."""

import difflib
import hashlib
import io
import json
import math
import random
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sonolake.functions import numbers
from sonolake.functions import text as t
from sonolake.functions import tokens
from sonolake.operators import alignment, audio, curate, errorrate, lm, report, sampling, segments, signal, timing
from sonolake.sources import iterated, readers, writers
from sonolake.tables import running


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.sampled_from([1, 3, 7, 64]))
@settings(max_examples=400, deadline=None)
def test_bit_parallel_distance_in_strips(a, b, strip):
    old, alignment.STRIP = alignment.STRIP, strip
    try:
        assert alignment.distance(a, b) == plain_distance(a, b)
    finally:
        alignment.STRIP = old


def test_distance_of_long_texts_with_many_tokens(spark):
    words = [f"w{i}" for i in range(40_000)]
    heard = [w for i, w in enumerate(words) if i % 100] + ["more"]
    d = spark.createDataFrame([(1, words, heard), (2, ["a"], None), (3, [], []), (4, [None, "a"], ["a"])], "id int, ref_words array<string>, hyp_words array<string>")
    assert {r.id: r.errors for r in errorrate.with_distance(d, "ref_words", "hyp_words").collect()} == {1: 401, 2: None, 3: 0, 4: 1}


def test_ctm_error_rate(spark):
    side = lambda rows: spark.createDataFrame(rows, "file string, transcript string")
    r = errorrate.ctm_error_rate(side([("a", "Hello  there"), ("b", ""), ("c", "only here")]), side([("a", "hello there"), ("b", "")]), F.lower).first()
    assert (r.percent, r.errors, r.words) == (25.0, 1, 4), "two spaces hold an empty word, an empty transcript is one"
    none = errorrate.ctm_error_rate(side([]), side([]), F.lower).first()
    assert (none.percent, none.errors, none.words) == (math.inf, 0, 0)


def test_standardised_error_rate(spark):
    pairs = spark.createDataFrame([("Um, it's $5 <noise> colour!", "it is five dollars colour"), ("Lemme see, mmhmm", "let me see")], "ref string, hyp string")
    r = errorrate.text_error_rate(pairs, [], standard=t.wer_standard()).first()
    assert (r.errors, r.words) == (0, 8)
    assert errorrate.text_error_rate(pairs, []).first().errors > 0


def test_breakdown(spark):
    pairs = spark.createDataFrame([("Hi, you.", "hi you")], "ref string, hyp string")
    got = {r.variant: (r.errors, r.improvement) for r in errorrate.breakdown(pairs, errorrate.variants(",.")).collect()}
    assert got == {"none": (2, 0.0), "case": (2, 0.0), "mark ,": (2, 0.0), "mark .": (1, 50.0), "marks": (1, 50.0)}


def test_numbers_by_rule():
    cases = {"1001": "ten oh one", "1010": "ten ten", "2000": "two thousand", "2009": "two thousand nine", "2010": "twenty ten", "2999": "twenty nine ninety nine", "1100": "eleven hundred", "3000": "three thousand", "1000": "one thousand",
        "$0": "zero dollars", "$1": "one dollar", "$2.01": "two dollars, one cent", "$0.50": "fifty cents", "$1.2.3": "one point two.three dollars", "$1,000": "one thousand dollars", "21st": "twenty first", "twenty-thirds": "twenty thirds"}
    assert {k: numbers.expand(k) for k in cases} == cases


def test_latency_chain(spark):
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    ref_rows = [(1, 0, "Hello,", 0.0, 0.4), (1, 1, "<noise>", 0.4, 0.1), (1, 2, "World", 0.5, 0.5), (2, 0, "a", 0.0, 0.2), (2, 1, "b", 0.3, 0.2), (3, 0, "<x>", 0.0, 1.0), (4, 0, "unheard", 0.0, 1.0)]
    hyp_rows = [(1, 0, "hello", 0.1, 0.0), (1, 1, "world!", 0.9, 0.0), (2, 0, "a", 0.1, 0.0), (2, 1, "c", 0.5, 0.0), (3, 0, "<y>", 0.2, 0.0)]
    ref = spark.createDataFrame(ref_rows, "file long, seq long, word string, start double, duration double")
    hyp = spark.createDataFrame(hyp_rows, ref.schema)
    aligned = timing.aligned_words(timing.spoken_words(ref, norm), timing.spoken_words(hyp, norm), substitutions=False)
    assert sorted((r.file, r.ref_seq, r.hyp_seq) for r in aligned.collect()) == [(1, 0, 0), (1, 2, 1), (2, 0, 0)]
    rates = timing.usage_rates(aligned, ref, hyp, norm).first()
    assert (rates.token_usage, rates.terminal_usage) == (0.75, round(2 / 3, 8)), "file 4 was not heard, file 3 has no words on either side"
    last = timing.last_words(ref, hyp, norm)
    ends = spark.createDataFrame([(1, "EOS", 1.5), (2, "Silence", 9.0), (3, "Silence", 2.0)], "file long, kind string, final_time double")
    assert sorted(map(tuple, timing.endpoint_latencies(last, ends).collect())) == [(1, "EOS", 0.5), (3, "Silence", 2.0)]
    with pytest.raises(PySparkException, match="no termination"):
        timing.endpoint_latencies(last, ends.where("file <> 1")).collect()
    hello = timing.aligned_words(spark.createDataFrame([(1, 0, "hello")], "file long, seq long, word string"), spark.createDataFrame([(1, 0, "world")], "file long, seq long, word string"), substitutions=False)
    assert hello.count() == 0


def test_medians_from_histograms(spark):
    rng = random.Random(2)
    rows = [(i % 3, round(rng.random(), 2), float(rng.randrange(9))) for i in range(301)]
    got = {r.k: (round(r.a, 6), r.b) for r in timing.medians(spark.createDataFrame(rows, "k int, a double, b double"), ["k"], ["a", "b"]).collect()}
    assert got == {k: (round(float(np.median([a for g, a, _ in rows if g == k])), 6), float(np.median([b for g, _, b in rows if g == k]))) for k in range(3)}


def test_running_totals_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(500)]
    got = {(r.g, r.i): r.before for r in running(spark.createDataFrame(rows, "g string, i long, x long").repartition(7), ["g"], ["i"], {"before": "x"}).collect()}
    assert got == {(g, i): sum(x for h, j, x in rows if h == g and j < i) for g, i, _ in rows}


def plain_model(sentences, order):
    """Interpolated Kneser-Ney by the book, over dicts."""
    grams = {n: [tuple(s[i : i + n]) for s in sentences for i in range(len(s) - n + 1)] for n in range(1, order + 1)}
    counts = {}
    for n in range(1, order + 1):
        counts[n] = {}
        for g in grams[n] if n == order else {x for x in set(grams[n + 1])}:
            key = g if n == order else g[1:]
            counts[n][key] = counts[n].get(key, 0) + 1
    p = {1: {g: c / sum(counts[1].values()) for g, c in counts[1].items()}}
    backoff = {}
    for n in range(2, order + 1):
        k = [sum(c == i for c in counts[n].values()) for i in range(5)]
        off = (0.5, 1.0, 1.5)
        if all(k[1:]):
            y = k[1] / (k[1] + 2 * k[2])
            found = tuple(i - (i + 1) * y * k[i + 1] / k[i] for i in (1, 2, 3))
            off = found if all(0 <= d <= i for i, d in enumerate(found, 1)) else off
        total, saved = {}, {}
        for g, c in counts[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            saved[g[:-1]] = saved.get(g[:-1], 0) + off[min(c, 3) - 1]
        p[n] = {g: (c - off[min(c, 3) - 1]) / total[g[:-1]] + saved[g[:-1]] / total[g[:-1]] * p[n - 1][g[1:]] for g, c in counts[n].items()}
        backoff |= {g: saved[g] / total[g] for g in total}
    return p, backoff


def test_model_of_order_four(spark):
    rng = random.Random(5)
    sentences = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    d = spark.createDataFrame([(s,) for s in sentences], "words array<string>")
    model, backoff = lm.kneser_ney(d, 4)
    p, b = plain_model(sentences, 4)
    got = {(r.n, *(r.context.split(" ") if r.context else ()), r.word): r.p for r in model.collect()}
    assert got.keys() == {(n, *g) for n in p for g in p[n]}
    assert all(abs(got[n, *g] - p[n][g]) < 1e-12 for n in p for g in p[n])
    assert {tuple(r.context.split(" ")): round(r.backoff, 9) for r in backoff.collect()} == {g: round(x, 9) for g, x in b.items()}
    spoken = [["a", "b", "zz", "c", "d"], list("abcabcab")]

    def log(words):
        def prob(context, w):
            if (*context, w) in p[len(context) + 1]:
                return p[len(context) + 1][*context, w]
            return b.get(context, 1.0) * prob(context[1:], w) if context else 1e-7

        return round(sum(math.log(prob(tuple(words[max(0, i - 3) : i]), w)) for i, w in enumerate(words)), 6)

    scores = lm.scored(spark.createDataFrame(list(enumerate(spoken)), "id int, words array<string>"), model, backoff, "id").collect()
    assert all(abs(r.log_prob - log(spoken[r.id])) < 2e-6 and r.n == len(spoken[r.id]) for r in scores)


def test_lm_lines(spark):
    texts = spark.createDataFrame([(1, "Ab  abc <EOS> b"), (2, "abq"), (3, "")], "id long, text string")
    vocabulary = spark.createDataFrame([("ab", -1.0), ("a", -2.0), ("b", -2.5), ("c", -3.0), ("<EOS>", -9.0)], "piece string, score double")
    got = {r.id: r.line for r in tokens.lm_lines(texts, vocabulary, "id", F.lower, {"eos": "<EOS>"}).collect()}
    assert got == {1: "ab ab c b"}, "unknown characters drop a text, so does emptiness"
    assert tokens.user_token({"eos": "<EOS>"}, "eos") == "<EOS>"
    with pytest.raises(ValueError, match="no user token"):
        tokens.user_token({}, "eos")
    tokens.check_user_tokens(vocabulary, {"eos": "<EOS>"})
    with pytest.raises(ValueError, match="no pieces"):
        tokens.check_user_tokens(vocabulary, {"x": "<X>"})


def test_keywords_step_by_step(spark):
    d = spark.createDataFrame([(1, "abcab"), (2, None), (3, "")], "id long, text string")
    k = spark.createDataFrame([("abc", 2.0), ("b", 1.0)], "phrase string, weight double")
    assert {r.id: r.score for r in lm.keyword_scores(d, k, "id").collect()} == {1: 2 * (3 + 2) + 2 * 1.0, 2: None, 3: 0.0}
    steps = lm.running_scores(d.where("id = 1"), k, "id").orderBy("pos").collect()
    assert [r.delta for r in steps] == [2.0, 3.0, 2.0, 2.0, 3.0]
    nbest = spark.createDataFrame([(1, "abc", -3.0), (1, "zzz", -2.0)], "utt long, text string, score double")
    assert {r.text: r.score for r in lm.keyword_rescored(nbest, k, 0.5).collect()} == {"abc": 0.5, "zzz": -2.0}
    assert [r.text for r in lm.first_hypotheses(nbest, [F.desc("score")], 1).collect()] == ["zzz"]


def test_forced_prefix(spark):
    rows = [(u, list(x), s, w) for u, w in ((1, 0.5), (2, 3.0)) for x, s in (("abc", 3.0), ("abd", 2.0), ("ax", 1.0), ("zz", 0.0))] + [(3, ["q"], 1.0, 9.0)]
    got = {r.utt: (r.n_kept, r.n_prefix, r.prefix) for r in lm.forced_prefix(spark.createDataFrame(rows, "utt long, tokens array<string>, score double, waited double"), 1.0).collect()}
    assert got == {1: (4, 0, []), 2: (3, 1, ["a"]), 3: (1, 1, ["q"])}


def test_pessimistic_order(spark):
    rng = random.Random(7)
    lengths = [rng.randrange(1000) for _ in range(96)]
    d = spark.createDataFrame([(f"f{i}", float(x), i) for i, x in enumerate(lengths)], "fname string, duration double, place long")

    epoch = list(range(96))
    for width in (24, 12, 4):
        chunks = [epoch[i : i + width] for i in range(0, 96, width)]
        best = max(range(len(chunks)), key=lambda i: sum(lengths[x] for x in chunks[i]))
        chunks[0], chunks[best] = chunks[best], chunks[0]
        epoch = [x for c in chunks for x in c]
    for i, far in enumerate(sorted(range(96), key=lambda p: (-lengths[epoch[p]], p))[:6]):
        near = max(range(4 * i, 4 * i + 4), key=lambda p: lengths[epoch[p]])
        epoch[near], epoch[far] = epoch[far], epoch[near]
    got = sampling.pessimistic(d, (24, 12, 4)).orderBy("place").collect()
    assert [r.fname for r in got] == [f"f{x}" for x in epoch]
    assert sampling.pessimistic(d.where("place < 24"), (24, 12, 4)).orderBy("place").first().fname == "f0", "no more than a step: as it was"


def test_buffers_and_batches(spark):
    d = spark.range(50).selectExpr("id as place", "id * 7 % 50 as k")
    rows = sampling.in_buffers(d, 20, [F.col("k")]).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(50))
    assert all([r.k for r in rows[i : i + 20]] == sorted(j * 7 % 50 for j in range(i, min(i + 20, 50))) for i in (0, 20, 40))
    assert [r.place for r in sampling.nth_batch(d, 8, 2).orderBy("place").collect()] == list(range(16, 24))
    assert [r.place for r in sampling.first_n(d, [F.desc("place")], 2).collect()] == [49, 48]


def test_noise_crop_and_tiling(spark):
    x = spark.createDataFrame([([1.0, -1.0, 2.0, 0.5], [float(i) for i in range(10)])], "s array<double>, n array<double>")
    part = x.select(signal.cropped(F.col("n"), F.lit(4), F.lit(0.5)).alias("c")).first().c
    assert part == [3.0, 4.0, 5.0, 6.0]
    mixed = x.select(signal.noise_mixed(F.col("s"), F.col("n"), F.lit(10.0), F.lit(0.5)).alias("m")).first().m
    s, n = np.array([1.0, -1.0, 2.0, 0.5]), np.array(part)
    want = s + n * math.sqrt((s**2).mean() / ((n**2).mean() * 10))
    assert np.allclose(mixed, want * math.sqrt((s**2).mean() / (want**2).mean()))
    quiet = x.select(signal.noise_mixed(F.col("s"), F.col("n"), F.lit(400.0), F.lit(0.0)).alias("m")).first().m
    assert np.allclose(quiet, s)
    with pytest.raises(PySparkException, match="shorter"):
        x.select(signal.noise_mixed(F.col("n"), F.col("s"), F.lit(10.0), F.lit(0.5))).collect()
    for size, overlap in ((10, 4), (10, 9), (3, 2)):
        y = spark.createDataFrame([([1.0] * size,)], "x array<double>").select(signal.tiled(overlap)(F.col("x"), F.lit(100)).alias("y")).first().y
        assert len(y) > 100 and y[0] == y[-1] == 1.0
    fade = np.cos(np.linspace(0, np.pi / 2, 4))
    once = spark.createDataFrame([([1.0] * 10,)], "x array<double>").select(signal.tiled(4)(F.col("x"), F.lit(12)).alias("y")).first().y
    assert np.allclose(once, [1.0] * 6 + (fade + fade[::-1]).tolist() + [1.0] * 6)


def test_masks(spark):
    x = [[float(f * 10 + d + 1) for d in range(10)] for f in range(40)]
    d = spark.createDataFrame([(i, x) for i in range(50)], "id long, x array<array<double>>")
    zeros = lambda **k: d.select(signal.spec_masked(F.col("x"), F.col("id"), **k).alias("y")).collect()
    for r in zeros(freq=(1, 2, 3)):
        gone = {j for j in range(10) if all(row[j] == 0 for row in r.y)}
        assert 2 <= len(gone) <= 3 and max(gone) - min(gone) == len(gone) - 1
        assert all((v == 0) == (j in gone) for row in r.y for j, v in enumerate(row))
    counts = [sum(all(v == 0 for v in row) for row in r.y) for r in zeros(time=(0.05, 1, 0.2))]
    assert max(counts) <= 16 and min(counts) >= 1, "2 masks of at most 8 of 40 frames"
    assert zeros(freq=(1, 2, 3)) == zeros(freq=(1, 2, 3)) and len({str(r.y) for r in zeros(freq=(1, 2, 3))}) > 5
    assert all(r.y == x for r in zeros())
    noisy = np.array([r.y for r in d.select(signal.spec_masked(F.col("x"), F.col("id"), time=(1, 20, 20), noise=0.5).alias("y")).collect()])
    hit = noisy != np.array(x)
    column = np.array(x).mean(axis=0)
    assert abs((noisy - column)[hit].mean()) < 6 and abs((noisy - column)[hit].std() - 0.5 * np.array(x).std(axis=0, ddof=1).mean()) < 6


def test_blended_normalisation(spark):
    rows = [(u, f, [float(u * 10 + f), 5.0]) for u in range(3) for f in range(4)]
    d = spark.createDataFrame(rows, "utt long, frame long, features array<double>")
    got = {(r.utt, r.frame, r.dim): r.value for r in signal.blended(d, signal.feature_stats(d), 0.0).collect()}
    own = np.array([0.0, 1, 2, 3])
    assert [got[2, f, 0] for f in range(4)] == [round(x, 6) for x in (own - own.mean()) / own.std()]
    assert all(got[u, f, 1] == 0.0 for u in range(3) for f in range(4)), "what does not vary is centred"
    assert signal.stat_preconditions({"dither": 1e-5, "window": 0.02}) == {"dither": 0.0, "window": 0.02, **dict.fromkeys(["normalise", "speed", "noise", "babble", "narrow_band", "masks"], False)}


def test_curation(spark):
    d = spark.createDataFrame([("a", "x", [("f", 1)]), ("b", " ", [("g", None)]), ("c", None, [("h", 1)])], "fname string, transcript string, files array<struct<name: string, n: int>>")
    assert [r.fname for r in curate.complete(d).collect()] == ["a"] and {r.fname for r in curate.incomplete(d).collect()} == {"b", "c"}
    out = curate.with_text(d, lambda x: x.withColumn("transcript", F.concat("transcript", F.lit("!"))))
    assert sorted((r.fname, r.transcript) for r in out.collect()) == [("a", "x!"), ("b", " "), ("c", None)]
    assert curate.merged([d.where("fname = 'a'"), d.where("fname = 'b'")]).count() == 2
    with pytest.raises(PySparkException, match="twice"):
        curate.merged([d, d.where("fname = 'b'")]).collect()
    names = curate.file_names(spark.createDataFrame([(0,), (9,)], "label long"), spark.createDataFrame([(0, "f0")], "label long, fname string"))
    assert sorted((r.label, r.fname) for r in names.collect()) == [(0, "f0"), (9, None)]
    with pytest.raises(PySparkException, match="nothing"):
        curate.coverage(spark.range(3).toDF("utt"), spark.createDataFrame([], "utt long, words array<string>"), "utt", "words").collect()
    assert curate.pending(spark.range(9).toDF("k"), spark.range(3).toDF("k"), "k", 2).count() == 2
    row = spark.createDataFrame([([7, 8], [["a", "b"], []], ["hello ", "wor", "ld", " x"])], "v array<int>, p array<array<string>>, s array<string>")
    got = row.select(curate.repeated_like(F.col("v"), F.col("p")).alias("r"), t.merged_splits(F.col("s")).alias("m")).first()
    assert got.r == [7, 7] and got.m == ["hello ", "world", " x"]
    assert row.select(t.cleaned(F.lit(" A & <b>B"), ["tags", "symbols", "lower", "collapse"]).alias("x")).first().x == " a and b"
    with pytest.raises(KeyError):
        t.cleaned(F.lit("x"), ["unknown"])


def test_losses_and_reports(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 6.0)], "worker int, loss double")
    assert errorrate.worker_mean(d).first().mean == 4.0
    rows = spark.createDataFrame([("x", "wer", 0.123456), ("y", "words", 7.0), ("x", "other", 1.0)], "dataset string, metric string, value double")
    got = {r.metric: (r.x, r.y) for r in report.validation_report(rows, ["x", "y"]).collect()}
    assert got["wer"][0] == 0.1235 and math.isnan(got["wer"][1]) and got["eos_share"] == (0.0, 0.0) and len(got) == len(report.METRICS)


def test_stacking_by_dimension(spark):
    rows = [(0, d, f, float(10 * d + f)) for d in range(2) for f in range(3)]
    got = segments.stacked(spark.createDataFrame(rows, "utt long, dim int, frame long, value double"), 2, 2, by=("utt", "dim")).orderBy("dim", "frame").collect()
    assert [(r.dim, r.frame, r.v0, r.v1) for r in got] == [(0, 0, 0.0, 1.0), (0, 2, 2.0, 0.0), (1, 0, 10.0, 11.0), (1, 2, 12.0, 0.0)]


def test_aligned_words_as_difflib(spark):
    rng = random.Random(11)
    a, b = ([rng.choice("abcd") for _ in range(60)] for _ in range(2))
    side = lambda x: spark.createDataFrame([(1, i, w) for i, w in enumerate(x)], "file long, seq long, word string")
    want = [(i + k, j + k) for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(n)]
    assert sorted((r.ref_seq, r.hyp_seq) for r in timing.aligned_words(side(a), side(b), substitutions=False).collect()) == want


def test_pieces_make_up_words(spark):
    pieces = spark.createDataFrame([(1, 0, "▁he", 2), (1, 1, "llo", 5), (1, 2, "▁", 6), (1, 3, "w", 8), (1, 4, "orld", 9), (2, 0, "a", 1)], "utt long, pos long, piece string, frame long")
    words = spark.createDataFrame([(1, 0, "hello"), (1, 1, "world"), (2, 0, "a")], "utt long, seq long, word string")
    assert sorted(map(tuple, timing.piece_words(pieces, words).collect())) == [(1, 0, "hello", 2, 5), (1, 1, "world", 8, 9), (2, 0, "a", 1, 1)]


def test_manifest_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id long, text string").repartition(3)
    writers.write_manifest(d, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 25
    writers.write_manifest(d, str(tmp_path / "arrays"), arrays=True)
    parts = [json.loads(f.read_text()) for f in (tmp_path / "arrays").glob("part-*") if f.stat().st_size]
    assert sorted(r["id"] for p in parts for r in p) == list(range(25))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "arrays")).count() == 25


def test_benchmark_table(spark, tmp_path):
    run = lambda n: spark.createDataFrame([tuple(f"{n}-{c}" for c in writers.BENCHMARK)], ", ".join(f"{c} string" for c in writers.BENCHMARK))
    path = str(tmp_path / "runs")
    for n in ("one", "two", "three"):
        writers.append_benchmark(run(n), path)
    text = "".join(f.read_text() for f in (tmp_path / "runs").glob("part-*"))
    assert text.count("Run name") == 1 and text.count("-provider") == 3
    assert {r.run for r in writers.read_benchmark(spark, path).collect()} == {"one-run", "two-run", "three-run"}


def test_reports_and_latency_sink(spark, tmp_path):
    d = spark.createDataFrame([("h", "r", 0.5, "f")], "hyp string, ref string, rate double, fname string")
    writers.write_report(d, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().wer == 0.5
    r = writers.latency_report(spark.createDataFrame([(0.1,), (0.1,), (0.25,)], "latency double"), spark.createDataFrame([("EOS",), ("Silence",), ("Never",), ("EOS",)], "kind string")).first()
    assert (r.sil_share, r.eos_share, [tuple(x) for x in r.latencies]) == (0.25, 0.5, [(0.1, 2), (0.25, 1)])


def test_directories_archives_and_checksums(spark, tmp_path):
    for name, text in (("a/x/one.wav", "sound"), ("a/two.wav", "sound"), ("t/one.txt", "first text"), ("t/three.txt", "third")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.stem: (r.transcript, r.side) for r in readers.directory_pairs(spark, str(tmp_path / "a"), str(tmp_path / "t")).collect()}
    assert got == {"one": ("first text", None), "two": (None, "text"), "three": ("third", "audio")}
    (tmp_path / "s").mkdir()
    with tarfile.open(tmp_path / "s" / "shard.tar", "w") as tar:
        for name in ("b.1.flac", "b.1.txt", "a.wav"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"xy"))
    assert [(r.pos, r.name) for r in readers.archive_names(spark, str(tmp_path / "s")).orderBy("pos").collect()] == [(0, "b.1.flac"), (1, "a.wav")]
    assert sorted((r.key, r.ext, r.content) for r in readers.archive_members(spark, str(tmp_path / "s"), ("txt",)).collect()) == [("a", "wav", None), ("b_1", "flac", None), ("b_1", "txt", bytearray(b"xy"))]
    md5 = lambda x: hashlib.md5(x).hexdigest()
    expected = spark.createDataFrame([("one.txt", md5(b"first text")), ("three.txt", md5(b"other")), ("none.txt", "")], "name string, md5 string")
    assert {r.name: r.ok for r in readers.checksums(spark, str(tmp_path / "t"), expected).collect()} == {"one.txt": True, "three.txt": False, "none.txt": False}


def test_logs_responses_keywords_and_mixes(spark, tmp_path):
    (tmp_path / "log").write_text("session_start;2024-01-01 00:00:00.000000;[];x\npartial;2024-01-01 00:00:01.500000;[{'text': 'hi there'}];x\nfinal;2024-01-01 00:00:02.000000;[\"plain\"];x\n")
    got = [(r.kind, r.seconds, r.text) for r in readers.session_log(spark, str(tmp_path / "log")).orderBy("seconds").collect()]
    assert got == [("session_start", 0.0, None), ("partial", 1.5, "hi there"), ("final", 2.0, "plain")]
    message = json.dumps({"start": 0.0, "end": 1.5, "is_provisional": True, "alternatives": [{"transcript": "hey", "confidence": 1.0}]})
    empty = message.replace("hey", "")
    r = readers.server_responses(spark.createDataFrame([(message,), (empty,)], "value string")).collect()
    assert [(x.text, x.ts, x.kind) for x in r] == [("hey", 1.5, "partial")]
    (tmp_path / "keywords.json").write_text('{"new york": 2, "bay": 1.5}')
    assert {r.phrase: r.weight for r in readers.keyword_file(spark, str(tmp_path / "keywords.json")).collect()} == {"new▁york": 2.0, "bay": 1.5}
    (tmp_path / "bad.json").write_text('{"x": "heavy"}')
    with pytest.raises(PySparkException):
        readers.keyword_file(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "mix.json").write_text('{"datasets": {"a": {"manifest": "a.json", "other": 1}, "b": {"manifest": "b.json", "weight": 3}}}')
    assert sorted(map(tuple, readers.mix_file(spark, str(tmp_path / "mix.json")).collect())) == [("a", "a.json", 1.0), ("b", "b.json", 3.0)]
    with pytest.raises(ValueError, match="negative"):
        readers.mix_table(spark, {"a": {"manifest": "m", "weight": -1}})
    paths = spark.createDataFrame([("/m/a.json",), ("/m/b.json",)], "path string")
    timings = spark.createDataFrame([("/m/a.ctm",)], "path string")
    assert sorted((r.path, r.ctm) for r in readers.reference_timings(paths, timings).collect()) == [("/m/a.json", "/m/a.ctm"), ("/m/b.json", None)]
    late = spark.sql("select timestamp'2024-01-01 00:00:00' as t").select(readers.shifted(F.col("t"), F.lit(1.25)).alias("x")).first().x
    assert late.microsecond == 250_000 and late.second == 1


def test_an_iterator_as_a_source(spark):
    iterated.register(spark)
    d = spark.read.format("iterated").schema("part long, total long").option("factory", "iterated_factory:numbers").option("partitions", "3").load()
    assert sorted(map(tuple, d.collect())) == [(i, 3) for i in range(3) for _ in range(2)]
    with pytest.raises(PySparkException, match="schema"):
        spark.read.format("iterated").option("factory", "x:y").load().collect()


def test_audio_augmentation(spark):
    tone = np.sin(np.arange(4000) * 2 * np.pi * 3000 / 16000) + np.sin(np.arange(4000) * 2 * np.pi * 200 / 16000)
    d = spark.createDataFrame([(i, 16000, tone.tolist()) for i in range(40)], "utt long, rate long, signal array<double>")
    rows = audio.augmented(d, 5, speed_share=0.5, narrow_share=0.5, limit=4000).collect()
    fast, narrow = [r for r in rows if r.speed != 1], [r for r in rows if r.narrow and r.speed == 1]
    assert 8 < len(fast) < 32 and len(narrow) > 2 and all(0.85 <= r.speed < 1.15 for r in fast)
    assert all(len(r.signal) == int(4000 / r.speed) for r in rows)
    spectrum = np.abs(np.fft.rfft(narrow[0].signal))
    assert spectrum[750] < 1e-6 < spectrum[50]
    assert all(r.signal == tone.tolist() for r in rows if r.speed == 1 and not r.narrow)
    x = np.zeros(800)
    assert not np.array_equal(audio.log_mel(x, 16000, 8, dither=1e-3, seed=1), audio.log_mel(x, 16000, 8)) and np.array_equal(audio.log_mel(x, 16000, 8, dither=1e-3, seed=1), audio.log_mel(x, 16000, 8, dither=1e-3, seed=1))


@pytest.mark.parametrize("kind", ["cer", "mer"])
def test_character_and_mixture_rates_as_plain_programs(spark, kind):
    rng = random.Random(6)
    texts = [("".join(rng.choices("ab 一二", k=20)), "".join(rng.choices("ab 一二", k=20))) for _ in range(30)]
    split = {"cer": lambda x: [c for c in x if not c.isspace()], "mer": lambda x: "".join(f" {c} " if c in "一二" else c for c in x).split()}[kind]
    want = sum(plain_distance(split(a), split(b)) for a, b in texts), sum(len(split(a)) for a, _ in texts)
    r = errorrate.text_error_rate(spark.createDataFrame(texts, "ref string, hyp string"), [], kind).first()
    assert (r.errors, r.words) == want


def test_noises_and_babble(spark):
    noises = spark.createDataFrame([(i,) for i in range(5)], "noise_id long")
    rows = signal.noise_assignment(spark.range(200).toDF("utt"), noises, 3, 5.0, 15.0).collect()
    assert len(rows) == 200 and {r.noise_id for r in rows} == set(range(5)) and all(5 <= r.snr < 15 and 0 <= r.start < 1 for r in rows)
    d = spark.createDataFrame([(0, i, [float(i + 1), 1.0]) for i in range(3)] + [(1, 0, [1.0, 2.0])], "batch_no long, pos long, signal array<double>")
    got = {(r.batch_no, r.pos): r.mixed for r in signal.babble(d, 3, 0.0).collect()}
    assert got.keys() == {(0, 0), (0, 1), (0, 2)}, "a signal alone in its batch has no neighbour"
    s, n = np.array([3.0, 1.0]), np.array([1.0, 1.0])
    mixed = s + n * math.sqrt((s**2).mean() / (n**2).mean())
    assert np.allclose(got[0, 2], mixed * math.sqrt((s**2).mean() / (mixed**2).mean()))


def test_orders_of_first_epochs(spark):
    d = spark.createDataFrame([(e, f"f{i}", float(9 - i)) for e in range(3) for i in range(9)], "epoch int, fname string, duration double")
    rows = sampling.shuffled_prefix(d, 1).orderBy("epoch", "order_key").collect()
    by_epoch = [[r.duration for r in rows if r.epoch == e] for e in range(3)]
    assert by_epoch[1] == by_epoch[2] == sorted(by_epoch[1]) != by_epoch[0]


def test_common_prefix(spark):
    d = spark.createDataFrame([(1, list("abc")), (1, list("abd")), (2, list("x")), (3, []), (3, ["a"])], "utt long, tokens array<string>")
    assert {r.utt: (r.n_prefix, r.prefix) for r in lm.common_prefix(d).collect()} == {1: (2, ["a", "b"]), 2: (1, ["x"]), 3: (0, [])}


def test_islands_of_a_file_that_fills_the_table(spark):
    rng = random.Random(8)
    files = ["big"] * 300 + ["small"] * 3
    lines = [(10 * i + rng.randrange(10), rng.choice(files), f"w{i}") for i in range(400)]
    d = spark.createDataFrame(lines, "line long, file string, word string").repartition(5)
    runs, starts, last = {}, {}, None
    for line, file, word in lines:
        starts[file] = starts.get(file, 0) + (file != last)
        runs[line], last = (file, starts[file]), file
    assert {r.line: (r.file, r.island) for r in timing.islands(d).collect()} == runs
    want = {f: " ".join(w for n, g, w in lines if g == f and runs[n][1] == starts[f]) for f in starts}
    assert {r.file: r.transcript for r in timing.transcripts(d).collect()} == want


def test_expected_pieces_against_all_splits():
    score = {"a": -1.0, "b": -2.0, "ab": -1.5, "ba": -2.5, "aba": -3.0}

    def splits(w):
        if not w:
            yield ()
        for i in range(1, min(3, len(w)) + 1):
            if w[:i] in score or i == 1:
                yield from ((w[:i], *rest) for rest in splits(w[i:]))

    for word in ("a", "ababa", "axb"):
        weigh = {s: math.exp(sum(score.get(p, -30.0) for p in s)) for s in splits(word)}
        want = {}
        for s, x in weigh.items():
            for p in s:
                want[p] = want.get(p, 0.0) + x / sum(weigh.values())
        got = {}
        for p, x in lm.expected_pieces(word, score, 3):
            got[p] = got.get(p, 0.0) + x
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_vocabulary_size_and_symbols(spark):
    d = spark.createDataFrame([(["banana", "bandana", "ananas", "band"],)] * 9, "words array<string>")
    rows = lm.subwords(d, 9, symbols=("<EOS>",)).collect()
    assert len(rows) == 10 and rows[0].piece == "<EOS>" and set("bands") <= {r.piece for r in rows} and any(len(r.piece) > 2 and r.piece != "<EOS>" for r in rows)


def test_hooks_models_and_rejects(spark, tmp_path):
    d = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0)], "fname string, duration double")
    assert [r.fname for r in sampling.ordered_by(d, lambda df: [F.desc("duration")]).orderBy("place").collect()] == ["a", "c", "b"]
    with pytest.raises(FileNotFoundError):
        readers.model_file(spark, str(tmp_path))
    (tmp_path / "m.arpa").write_text("x")
    assert readers.model_file(spark, str(tmp_path)).endswith("m.arpa")
    (tmp_path / "z.binary").write_text("x")
    assert readers.model_file(spark, str(tmp_path)).endswith("z.binary")
    found = spark.createDataFrame([("s", "a", True, True), ("s", "b", False, True), ("s", "c", True, False)], "shard string, key string, complete boolean, known boolean")
    assert sorted((r.key, r.reason) for r in readers.rejected_samples(found).collect()) == [("b", "one side missing"), ("c", "unknown kind")]
    with pytest.raises(PySparkException, match="unknown kind"):
        readers.known_samples(found).collect()


def test_large_spelling_tables(spark):
    table = {f"colour{i}": f"color{i}" for i in range(100)}
    d = spark.createDataFrame([("a colour7  b",), (None,), ("colour70",)], "x string")
    assert [r.y for r in d.select(t.american(F.col("x"), table).alias("y")).collect()] == ["a color7 b", None, "color70"]


def test_epoch_report(spark):
    sizes = spark.createDataFrame([("a", 10, 8, 2), ("b", 30, 16, 2), ("c", 9, 8, 2)], "manifest string, n long, utts long, repetition long")
    rows = {r.manifest: r for r in sampling.epoch_report(sizes, 100).collect()}
    assert {r.epochs for r in rows.values()} == {4} and {r.repetition_epochs for r in rows.values()} == {2} and rows["b"].share == 0.5
    with pytest.raises(PySparkException, match="no whole batch"):
        sampling.epoch_report(sizes.union(spark.createDataFrame([("d", 3, 0, None)], sizes.schema)), 100).collect()


def test_flac_headers(spark, tmp_path):
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | 88200
    (tmp_path / "a.flac").write_bytes(b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + packed.to_bytes(8, "big") + bytes(16))
    (tmp_path / "b.flac").write_bytes(b"nothing")
    got = {r.fname[-6:]: (r.channels, r.sample_rate, r.bitdepth, r.num_samples, r.duration) for r in readers.audio_metadata(spark, str(tmp_path)).collect()}
    assert got == {"a.flac": (2, 44100, 16, 88200, 2.0), "b.flac": (None,) * 5}


def test_dropped_and_written_rows_are_counted_in_the_same_pass(spark, tmp_path):
    from pyspark.sql import Observation
    from sonolake.operators import curate
    from sonolake.sources import writers

    d = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "y"), ("c", 30.0, "z"), ("d", 2.0, None), ("e", 3.0, "w")], "fname string, duration double, transcript string").repartition(3)
    nulls, lengths = Observation(), Observation()
    kept = curate.by_length(curate.complete(d, nulls), "manifest", 16.7, 100, counts=lengths)
    assert writers.write_manifest(kept, str(tmp_path / "lines")) == 2
    assert nulls.get == {"rows": 5, "dropped": 2} and lengths.get == {"rows": 3, "dropped": 1}
    assert writers.write_manifest(kept.limit(0), str(tmp_path / "none"), arrays=True) == 0
    # a null bound drops a row, which counts
    only = Observation()
    assert curate.by_length(d, "hub", 16.7, 100, counts=only).count() == 2
    assert only.get == {"rows": 5, "dropped": 3}


def test_matched_and_unmatched_rows_are_counted_with_the_join(spark):
    from pyspark.sql import Observation
    from sonolake.operators import curate

    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), ("c", 5)], "utt string, audio int").repartition(3)
    right = spark.createDataFrame([("b", "x"), ("d", "y"), (None, "z"), ("a", "w"), ("a", "v")], "utt string, text string")
    counts = Observation()
    want = [("a", 1, "v"), ("a", 1, "w"), ("b", 2, "x"), ("b", 3, "x")]
    assert sorted(map(tuple, curate.paired(left, right, "utt", counts).collect())) == want
    assert counts.get == {"matched": 4, "left_only": 2, "right_only": 2}
    assert sorted(map(tuple, curate.paired(left, right, "utt").collect())) == want
    none = Observation()
    assert curate.paired(left.limit(0), right, "utt", none).count() == 0 and none.get == {"matched": 0, "left_only": 0, "right_only": 5}
    with pytest.raises(ValueError, match="both sides have"):
        curate.paired(left, left, "utt")


def test_rates_by_checkpoint(spark):
    d = spark.createDataFrame([("k1", "a b c", "a x c"), ("k1", "d", "d"), ("k2", "a b c", "a b"), ("k3", "", "a"), ("k3", "", "")], "checkpoint string, ref string, hyp string")
    assert {r.checkpoint: r.percent for r in errorrate.by_checkpoint(d).collect()} == {"k1": 25.0, "k2": 33.333, "k3": float("inf")}
