"""Golden cases and properties of the speech-corpus operators."""

import io
import random
import struct
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonolake.functions import numbers
from sonolake.functions import text as t
from sonolake.operators import alignment, curate, errorrate, lm, sampling, segments, signal, timing
from sonolake.sources import readers, writers
from sonolake.streaming import fusion, windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def rates(spark, rows, kind="wer"):
    split = errorrate.TOKENS[kind]
    d = spark.createDataFrame(rows, "ref string, hyp string").select(split(F.col("ref")).alias("ref_words"), split(F.col("hyp")).alias("hyp_words"))
    r = errorrate.error_rate(d, []).first()
    return r.rate, r.errors, r.words


def test_error_rates(spark):
    assert rates(spark, [("hello world", "hello world")]) == (0.0, 0, 2)
    assert rates(spark, [("hi everyone", "hello world")]) == (1.0, 2, 2)
    assert rates(spark, [("", "")]) == (float("inf"), 0, 0)
    assert rates(spark, [("hello new world", "hello world")]) == (round(1 / 3, 8), 1, 3)
    assert rates(spark, [("good morning mars", "good morning earth"), ("good morning", "")]) == (0.6, 3, 5)
    assert rates(spark, [("One two three一二三", "One two four一二四")], "mer") == (round(1 / 3, 8), 2, 6)
    assert rates(spark, [("a b", "ab c")], "cer") == (0.5, 1, 2)


def test_distance_against_plain_programming(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab", k=rng.randrange(60))), "".join(rng.choices("ab", k=rng.randrange(60)))) for _ in range(60)]
    d = spark.createDataFrame([(list(a), list(b), distance(a, b)) for a, b in pairs], "r array<string>, h array<string>, want int")
    assert errorrate.with_distance(d, "r", "h").where("errors <> want").count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_edit_path_is_shortest(a, b):
    path = list(alignment.edit_path(*alignment.numbered(a, b)))
    assert sum(op != "C" for op, *_ in path) == distance(a, b)
    assert sum(op in "CSD" for op, *_ in path) == len(a) and sum(op in "CSI" for op, *_ in path) == len(b)


def test_punctuation(spark):
    d = spark.createDataFrame([(1, "hi, there. you?", "hi. there. you"), (2, "no marks", "no marks")], "utt long, ref string, hyp string")
    ops = errorrate.mark_operations(d)
    assert sorted((r.mark, r.op) for r in ops.collect()) == [(",", "Substitutions"), (".", "Correct"), ("?", "Deletions")]
    r = errorrate.punctuation_error_rate(ops).first()
    assert (r.n, r.errors, r.per) == (3, 2, 2 / 3)
    empty = errorrate.punctuation_error_rate(ops.limit(0)).first()
    assert (empty.n, empty.errors, empty.per) == (0, 0, 0.0)
    total = errorrate.mark_rates(ops).where("mark is null").first()
    assert (total.n, total.per) == (3, round(2 / 3, 8))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1990", "nineteen ninety"), ("2005", "two thousand five"), ("1900", "nineteen hundred"), ("1905", "nineteen oh five"), ("007", "zero, zero, seven"), ("$1.2", "one dollar, two cents"), ("$3 million", "three million dollars"),
        ("3pm", "three pm"), ("1-5", "one to five"), ("-5", "minus five"), ("£20", "twenty pounds"), ("12.5", "twelve point five"), ("123rd", "one hundred and twenty third"), ("21", "twenty one"), ("1,234", "twelve thirty four"),
    ],
)
def test_numbers(text, want):
    assert numbers.expand(text) == want


def test_text_rules(spark):
    charset = " '" + "abcdefghijklmnopqrstuvwxyz"
    low = lambda c: t.lower_pipeline(c, charset)
    assert one(spark, "Mr. Brown & Dr. Ünal paid $5!", low) == "mister brown and doctor unal paid five dollars"
    assert one(spark, "50% off @ 3", low) == "fifty percent off at three"
    assert one(spark, 'a "b"; c: d! e-f', t.normalise_punctuation) == "a b, c. d. e f"
    assert one(spark, "a <silence> b <x1>", t.remove_tags) == "a  b <x1>"
    assert one(spark, " <a>  <b> ", t.is_tag) and not one(spark, "<a> b", t.is_tag)
    assert one(spark, "Um, he's won't [noise] normalise 1,000", lambda c: t.standardise(c, {"normalise": "normalize"})).split() == ["he", "is", "will", "not", "normalize", "1000"]
    assert one(spark, "straße Łódź", t.ascii_fold) == "strasse Lodz"
    assert one(spark, "Is it? Yes. End.", lambda c: t.sentence_ends(c)[0]) == "Is it? <EOS> Yes. <EOS> End."
    assert one(spark, "a😀é", t.code_points) == [97, 0x1F600, 0xE9]
    assert one(spark, "a😀é", lambda c: t.from_code_points(F.concat(t.code_points(c), F.array(F.lit(-1))))) == "a😀é"
    symbols = ["<spk>", "@@"]
    assert one(spark, "x <spk> @@", lambda c: t.unmasked(F.lower(t.masked(c, symbols)), symbols)) == "x <spk> @@"
    d = spark.createDataFrame([("ÀB <tag> 5",)], "x string")
    assert [t.normalise(d, "x", level, charset + "5").first().x for level in ("identity", "scrub", "ascii", "lowercase")] == ["ÀB  5", "  5", "  5", "ab  five"]


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_expansion_never_fails(s):
    numbers.expand(s.lower())


def test_length_filters_differ_at_their_bounds(spark):
    d = spark.createDataFrame([(1.0, "abc"), (5.0, "abc"), (3.0, "abcd"), (3.0, "abc")], "duration double, transcript string")
    n = {m: curate.by_length(d, m, 5.0, 4, 1.0).count() for m in ("manifest", "shard", "hub")}
    assert n == {"manifest": 2, "shard": 4, "hub": 1}


def test_epochs_cover_and_repeat(spark):
    d = spark.createDataFrame([(m, f"{m}{i}", float(i)) for m, n in (("a", 5), ("b", 8)) for i in range(n)], "manifest string, fname string, duration double")
    sizes = sampling.epoch_sizes(sampling.fractions(sampling.manifest_sizes(d), "none"), 2)
    assert {r.manifest: (r.utts, r.repetition) for r in sizes.collect()} == {"a": (4, 2), "b": (8, 1)}
    e = sampling.epochs(d, sizes, 4).toPandas()
    assert e.groupby(["epoch", "manifest"]).fname.nunique().to_dict() == {(k, m): n for k in range(4) for m, n in (("a", 4), ("b", 8))}
    assert set(e.fname) == {r.fname for r in d.collect()}


def test_orders(spark):
    d = spark.createDataFrame([(f"f{i}", float(x)) for i, x in enumerate([1, 100, 2, 10, 3, 4, 4, 9])], "fname string, duration double")
    assert [(r.place, r.fname) for r in sampling.striped(d, 2).where("worker = 0").orderBy("place").collect()] == [(0, "f1"), (2, "f7"), (4, "f6"), (6, "f2")]
    b = sampling.bucketed(d, 2, 2).toPandas()
    assert b.groupby(["bucket", "batch"]).size().tolist() == [2] * 4 and set(b[b.bucket == 0].duration) == {1.0, 2.0, 3.0, 4.0}
    placed = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 1, 5, 9, 2, 2])], "place long, duration double")
    assert [r.duration for r in sampling.longest_first(placed, 2).orderBy("place").collect()] == [5, 9, 1, 1, 2, 2]
    left = sampling.resumed(spark.range(16).selectExpr("id as place"), 2, 4, 1)
    assert sorted(r.place for r in left.collect()) == [8, 9, 10, 11, 12, 13, 14, 15]


def test_islands_keep_a_files_last_run(spark):
    rows = [(0, "a", "x"), (1, "a", "y"), (2, "b", "z"), (3, "a", "w"), (4, "a", "v")]
    d = spark.createDataFrame(rows, "line long, file string, word string")
    assert {r.file: r.transcript for r in timing.transcripts(d).collect()} == {"a": "w v", "b": "z"}


def test_alignment_pairs_equal_and_same_length_stretches(spark):
    mk = lambda s: spark.createDataFrame([(1, i, w) for i, w in enumerate(s.split())], "file long, seq long, word string")
    got = timing.aligned_words(mk("a b c d e"), mk("a x c e f"))
    assert sorted((r.ref_seq, r.hyp_seq, r.word) for r in got.collect() if r.word) == [(0, 0, "a"), (2, 2, "c"), (4, 3, "e")]
    assert [(r.ref_seq, r.hyp_seq) for r in got.collect() if not r.word] == [(1, 1)]
    assert timing.aligned_words(mk("hello"), mk("world")).where("word is not null").count() == 0


def test_latency_percentiles_are_single_values(spark):
    d = spark.createDataFrame([("k", float(i)) for i in range(10)], "k string, latency double")
    r = timing.latency_summary(d, ["k"]).first()
    assert (r.n, r.mean, r.median, r.p90, r.p99) == (10, 4.5, 4.5, 9.0, 9.0)


def test_overlap_merge(spark):
    d = spark.createDataFrame([(1, 0, [7, 2, 3, 6, 5], [1, 2, 3, 4, 6]), (1, 1, [2, 6, 5, 9, 7], [1, 3, 4, 5, 6])], "utt long, seg int, tokens array<int>, timestamps array<int>")
    r = segments.merged(d, 2, 1).first()
    assert (r.tokens, r.timestamps) == ([7, 2, 3, 6, 5, 9, 7], [1, 2, 3, 4, 6, 5, 6])


def test_segments(spark):
    d = spark.createDataFrame([(1, 10), (2, 11), (3, 3)], "utt long, n long")
    got = {(r.utt, r.seg): (r.first, r.last) for r in segments.segments(d, 4, 1).collect()}
    assert got == {(1, 0): (0, 4), (1, 1): (3, 7), (1, 2): (6, 10), (2, 0): (0, 4), (2, 1): (3, 7), (2, 2): (6, 10), (2, 3): (9, 11), (3, 0): (0, 3)}
    with pytest.raises(ValueError):
        segments.segments(d, 4, 4)


def test_end_marks(spark):
    d = spark.createDataFrame([([1, 9, 2, 9, 0, 9, 0],), ([1, 9, 2],), ([],)], "y array<int>")
    got = [(r.a, r.b) for r in d.select(segments.end_place(F.col("y"), 9, 0, True).alias("a"), segments.end_place(F.col("y"), 9, 0, False).alias("b")).collect()]
    assert got == [(1, 3), (1, None), (None, None)]


@pytest.mark.parametrize(
    ("responses", "want"),
    [
        ([("partial", "hel", 1.0), ("partial", "hello", 2.0), ("final", "hello", 3.0)], [("hello", 2.0)]),
        ([("partial", "a b", 1.0), ("final", "a ", 2.0), ("final", "b", 5.0)], [("a", 1.0), ("b", 1.0)]),
        ([("partial", "x", 1.0), ("partial", "y", 2.0), ("final", "x", 4.0)], [("x", 4.0)]),
        ([("partial", "x", 1.0)], []),
    ],
)
def test_fusion(spark, responses, want):
    d = spark.createDataFrame([(1, i, ts, k, x) for i, (k, x, ts) in enumerate(responses)], "session long, seq long, ts double, kind string, text string")
    assert sorted((r.word, r.ts) for r in fusion.words(d).collect()) == want


def final(frame, tokens):
    return ("final", frame, tokens)


def partial(frame, tokens):
    return ("partial", frame, tokens)


@pytest.mark.parametrize(
    ("responses", "want"),
    [
        ([partial(0, "a"), partial(1, "ab"), partial(2, "abc"), partial(5, "abde"), final(9, "abdf")], [0, 1, 5, 9]),
        ([partial(1, ["a", "b"]), final(2, ["ab"])], [1]),
        ([partial(1, "ab"), partial(2, "bbd"), final(4, "cd")], [4, 4]),
        ([partial(1, ["a", "b"]), partial(2, ["b", "b", "c"]), final(4, ["bb", "c"])], [2, 2]),
        ([partial(0, "a"), partial(1, "abc"), final(4, "a"), final(5, "bc")], [0, 1, 1]),
        ([final(i, "zz") for i in range(3)], [0, 0, 1, 1, 2, 2]),
        ([final(3, "a"), partial(3, "b"), final(7, "b")], [3, 3]),
    ],
)
def test_token_fusion(spark, responses, want):
    d = spark.createDataFrame([(1, f, k, list(t)) for k, f, t in responses], "session long, frame long, kind string, tokens array<string>")
    assert [r.since for r in fusion.tokens(d).orderBy("frame", "pos").collect()] == want


def sessions_of_responses(rng, sessions, finals):
    rows = []
    for session in range(sessions):
        said, seq = "", 0
        for _ in range(finals):
            word = "".join(rng.choices("ab", k=rng.randrange(1, 4))) + rng.choice([" ", " ", ""])
            for _ in range(rng.randrange(4)):
                shown = word[: rng.randrange(len(word) + 1)] + "".join(rng.choices("ab ", k=rng.randrange(4)))
                rows.append((session, seq, seq * 0.25 + session / 64, "partial", shown))
                seq += 1
            rows.append((session, seq, seq * 0.25 + session / 64, "final", word))
            said, seq = said + word, seq + 1
    return rows


def words_by_character(rows):
    """The rule, literally: what the screen showed at a place, response by response."""
    out = []
    for session in sorted({r[0] for r in rows}):
        place, shown, word, ts = 0, [], "", 0.0
        for _, _, t, kind, text in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            if kind == "partial":
                shown.append((place, text, t))
                continue
            for i, c in enumerate(text, place):
                at = [(x[i - p], u) for p, x, u in shown if p <= i < p + len(x)]
                same = len(at)
                while same and at[same - 1][0] == c:
                    same -= 1
                seen = at[same][1] if same < len(at) else t
                if c != " ":
                    word, ts = word + c, max(ts, seen)
                elif word:
                    out.append((session, word, ts))
                    word = ""
                if c == " ":
                    ts = 0.0
            place += len(text)
        if word:
            out.append((session, word, ts))
    return sorted(out)


def test_fusion_of_random_sessions(spark):
    rows = sessions_of_responses(random.Random(3), 40, 8)
    d = spark.createDataFrame(rows, "session long, seq long, ts double, kind string, text string").repartition(5)
    assert sorted(map(tuple, fusion.words(d).collect())) == words_by_character(rows)


def test_fusion_on_a_stream_with_late_rows_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = sessions_of_responses(rng, 12, 6)
    last = max(r[2] for r in rows)
    # rows come up to 5 s late, well inside the watermark's 10 s, a few to a file; one row far ahead lets the watermark pass all
    come = [*sorted(rows, key=lambda r: r[2] + rng.random() * 5), (99, 0, last + 500, "partial", "")]
    schema = "session long, seq long, ts double, kind string, text string"
    stamped = lambda x: spark.createDataFrame(x, schema).withColumn("event_time", (F.lit(1_700_000_000) + F.col("ts")).cast("timestamp"))
    for i in range(0, len(come), 60):
        stamped(come[i : i + 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped(come[:1]).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = fusion.words_stream(stream).writeStream.format("memory").queryName("fused").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.session, r.word, round(r.ts, 6)) for r in spark.table("fused").collect())
    want = [(s, w, round(t, 6)) for s, w, t in words_by_character(rows)]
    assert got == want and len(got) > 40
    assert [(r.session, r.word, round(r.ts, 6)) for r in fusion.words(stamped(rows)).orderBy("session", "ts").collect()] != [] and sorted((r.session, r.word, round(r.ts, 6)) for r in fusion.words(stamped(rows)).collect()) == want


def test_display(spark):
    d = spark.createDataFrame([(1, 0, 1.0, "partial", "he"), (1, 1, 2.0, "final", "hello "), (1, 2, 3.0, "partial", "wor"), (2, 0, 1.0, "partial", "x"), (2, 1, 2.0, "final", "y")], "session long, seq long, ts double, kind string, text string")
    assert sorted(map(tuple, fusion.display(d).collect())) == [(1, "hello ", "hello wor"), (2, "y", "y")]


def test_session_windows_on_a_stream_equal_closed_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "6 hours")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    got = {(r.user_id, r.start, r.n) for r in spark.table("sessions").collect()}
    every = windows.sessions(events, "user_id", "6 hours").collect()
    closed = {(r.user_id, r.start, r.n) for r in every if (last - r.stop).total_seconds() > 3600}
    assert closed <= got <= {(r.user_id, r.start, r.n) for r in every} and closed


def test_keywords(spark):
    k = spark.createDataFrame([("abc", 2.0), ("bb", 1.0)], "phrase string, weight double")
    d = spark.createDataFrame([(1, "xabc"), (2, "bbb"), (3, "zab"), (4, "")], "id long, text string")
    assert {r.id: r.score for r in lm.keyword_scores(d, k, "id").collect()} == {1: 6.0, 2: 5.0, 3: 2 * 2 + 1.0, 4: 0.0}


def test_model_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([("a b a c a b".split(),), ("b a c c a b".split(),)], "words array<string>")
    p, backoff = lm.kneser_ney(d, 2)
    seen = p.where("context is not null").groupBy("context").agg(F.sum("p").alias("s")).join(backoff, "context").collect()
    uni = {r.word: r.p for r in p.where("context is null").collect()}
    assert abs(sum(uni.values()) - 1) < 1e-9
    pairs = {(r.context, r.word) for r in p.where("context is not null").collect()}
    for r in seen:
        rest = sum(q for w, q in uni.items() if (r.context, w) not in pairs) * r.backoff
        assert abs(r.s + rest - 1) < 1e-9


def test_subwords_cover_the_charset(spark):
    d = spark.createDataFrame([(["banana", "bandana", "ananas"],)] * 5, "words array<string>")
    v = {r.piece for r in lm.subwords(d, 8).collect()}
    assert set("bands") <= v and any(len(p) > 2 for p in v)
    assert "".join(lm.best_split("banana", {"ban": -1.0, "ana": -1.0, "b": -3.0, "a": -3.0, "n": -3.0}, 8)) == "banana"


def test_signals(spark):
    d = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5], [0.3, 0.1, -0.2, 0.4])], "s array<double>, n array<double>")
    quiet, loud = (d.select(signal.snr_mix(F.col("s"), F.col("n"), F.lit(x)).alias("y")).first().y for x in (400.0, 10.0))
    assert max(abs(a - b) for a, b in zip(quiet, [1.0, -2.0, 3.0, 0.5], strict=True)) < 1e-9 and loud != quiet
    assert abs(sum(x * x for x in loud) - sum(x * x for x in quiet)) < 1e-9
    f = spark.createDataFrame([(1, [1.0, 5.0, 3.0, 4.0])], "id long, values array<double>")
    assert [r.value for r in signal.fuzzy_top(f, 2, 4).orderBy("pos").collect()] == [3.0, 5.0, 3.0, 3.0]
    x = spark.createDataFrame([([0.0, 0.001, 1.0, 0.0, 0.5, 0.0],)], "x array<double>")
    assert x.select(signal.trim_silence(F.col("x"), -20.0).alias("y")).first().y == [1.0, 0.0, 0.5]
    tiled = x.select(signal.tiled(3)(F.col("x"), F.lit(20)).alias("y")).first().y
    assert len(tiled) > 20


def wav(n):
    data = b"\0\0" * n
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_archives_and_headers(spark, tmp_path):
    members = {"x/a.b.txt": b"hello", "x/a.b.wav": wav(160), "c.txt": b"alone"}
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, raw in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    got = readers.samples(readers.archive_members(spark, str(tmp_path), ("txt", "wav"))).collect()
    assert sorted((r.key, r.transcript, r.complete, r.known) for r in got) == sorted([("a_b", "hello", True, True), ("c", "alone", False, True)] * 2)
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wav").write_bytes(wav(160))
    (tmp_path / "w/b.wav").write_bytes(b"no header")
    meta = {r.fname[-5:]: (r.channels, r.num_samples, r.duration) for r in readers.audio_metadata(spark, str(tmp_path / "w")).collect()}
    assert meta == {"a.wav": (1, 160, 0.01), "b.wav": (None, None, None)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.ctm").write_text("f 1 0.5 0.25 hi 0.9\nbad line\n")
    good, bad = sorted(readers.ctm(spark, str(tmp_path / "a.ctm")).collect(), key=lambda r: r.error is not None)
    assert (good.file, good.start, good.word, good.error, bad.error) == ("f", 0.5, "hi", None, "bad line")
    assert writers.ctm_lines(readers.ctm(spark, str(tmp_path / "a.ctm")).where("error is null")).first().value == "f 1 0.500 0.250 hi"
    (tmp_path / "s.trans").write_text('session_start;2024-01-01 00:00:00.000000;;N/A\npartial_received;2024-01-01 00:00:01.500000;["hi"];N/A\n')
    assert [(r.seconds, r.text) for r in readers.session_log(spark, str(tmp_path / "s.trans")).orderBy("seconds").collect()] == [(0.0, None), (1.5, "hi")]
    (tmp_path / "1.trans.txt").write_text("u1 HELLO WORLD\nu2 \n")
    assert {r.utt: r.transcript for r in readers.transcript_files(spark, str(tmp_path)).collect()} == {"u1": "HELLO WORLD", "u2": ""}
    (tmp_path / "m.json").write_text('[{"transcript": "a", "files": [{"fname": "x.wav", "duration": 2.0}], "original_duration": 2.0}]')
    r = readers.manifests(spark, str(tmp_path / "m.json"), "/data").first()
    assert (r.fname, r.duration, r.transcript) == ("/data/x.wav", 2.0, "a")
    with pytest.raises(ValueError):
        readers.mix_table(spark, {"a": {"manifest": "m", "weight": -1}})


def test_tokens_round_trip(spark):
    from sonolake.functions import tokens

    v = spark.createDataFrame([("ba", -1.0), ("na", -1.0), ("b", -3.0), ("a", -3.0), ("n", -3.0)], "piece string, score double")
    d = spark.createDataFrame([(1, ["banana", "ban"]), (2, ["bxa"])], "k long, words array<string>")
    ids = tokens.tokenised(d, v, "k")
    assert {r.k: r.ids for r in ids.collect()} == {1: [1, 2, 2, 1, 5], 2: [4, 0, 3]}
    assert [r.k for r in tokens.known(ids).collect()] == [1]
    p = spark.createDataFrame([(["▁he", "llo", "<unk>", "▁you"],)], "p array<string>")
    assert p.select(tokens.piece_text(F.col("p")).alias("x")).first().x == "hello ⁇  you"


def test_audio_features(spark):
    import numpy as np

    from sonolake.operators import audio

    tone = (np.sin(np.arange(16000) * 2 * np.pi * 1000 / 16000) * 20000).astype("<i2").tobytes()
    raw = wav(16000)[:44] + tone
    d = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"no header"))], "utt long, content binary")
    got = audio.features(d, 40).orderBy("frame").collect()
    assert [r.utt for r in got] == [1] * 98 and len(got[0].features) == 40
    peak = int(np.argmax(got[5].features))
    bank = audio.mel_bank(40, 512, 16000)
    assert bank[peak, 32] > 0, "the loudest band holds 1 kHz"
    x, rate = audio.samples_of(raw)
    assert len(audio.resampled(x, 1.25)) == 12800 and np.abs(audio.narrow_band(x, rate, 1000)).max() < 0.05


def test_nothing_outside_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).parent.parent / "sonolake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sonolake.llm" not in p.read_text()
