"""Ends of utterances: the stream gives what the batch form gives, with late rows, and what plain Python gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sonolake.operators import lm
from sonolake.streaming import endings as e
from sonolake.streaming import windows

SCHEMA = f"session long, seq long, event_time timestamp, kind string, hyps {e.HYPS}"
START = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def at(s):
    return START + dt.timedelta(seconds=s)


def plain(rows, threshold, limit, until=None):
    out = []
    for session in {r[0] for r in rows}:
        last = since = None
        ended = False
        for _, seq, time, kind, hyps in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            s = (time - START).total_seconds()
            if last is not None and s - last > threshold:
                break
            since = s if since is None else since
            last = s
            if kind == "session_end":
                out.append((session, "EOS", s, None, None))
                ended = True
                break
            if kind == "final":
                since = s
            elif kind == "partial" and hyps and s - since > limit:
                best = sorted(hyps, key=lambda h: (h[0], h[1]), reverse=True)
                while len(best) > 1 and len({h[1][0] if h[1] else None for h in best} | ({None} if any(not h[1] for h in best) else set())) > 1:
                    best.pop()
                n = next((i for i in range(len(best[0][1])) if len({tuple(h[1][: i + 1]) for h in best}) > 1), len(best[0][1]))
                if n:
                    out.append((session, "Forced", s, len(best), best[0][1][:n]))
                    since = s
        else:
            ended = until is None or until - last <= threshold
        if not ended:
            out.append((session, "Silence", last + threshold, None, None))
    return sorted(map(repr, out))


def rows_of(df):
    zero = START.timestamp()
    return sorted(repr((r.session, r.kind, round(r.at - zero, 3), r.n_kept, r.prefix)) for r in df.collect())


@pytest.fixture(scope="module")
def events():
    rng, rows = random.Random(8), []
    for session in range(12):
        s = rng.uniform(0, 20)
        for i in range(40):
            s += rng.choice([0.2, 0.5, 1.0, 2.0]) if rng.random() < 0.97 else 9.0
            kind = rng.choices(["partial", "final", "session_end", "session_start"], [0.85, 0.1, 0.02, 0.03])[0]
            hyps = [(round(-rng.random(), 2), [rng.choice("ab") for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 4))] if kind == "partial" else None
            rows.append((session, session * 100 + i, at(round(s, 3)), kind, hyps))
    return rows


def test_batch_fold_is_the_plain_program(spark, events):
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    assert rows_of(e.endings(df, 5.0, 1.5)) == plain(events, 5.0, 1.5)
    assert rows_of(e.endings(df, 5.0, 1.5, F.lit(at(100)))) == plain(events, 5.0, 1.5, 100)
    assert e.endings(df.limit(0), 5.0, 1.5).count() == 0
    kinds = {r.kind for r in e.endings(df, 5.0, 1.5).collect()}
    assert kinds == {"EOS", "Silence", "Forced"}


def test_ends_agree_with_terminations(spark, events):
    df = spark.createDataFrame(events, SCHEMA)
    ends = e.endings(df, 5.0, 1.5).where("kind <> 'Forced'").select("session", "kind", F.round("at", 6).alias("final_time"))
    known = windows.terminations(df.withColumn("ts", F.unix_millis("event_time") / 1000.0), "session", 5.0).where("kind <> 'Never'")
    assert sorted(map(tuple, ends.collect())) == sorted((r.session, r.kind, r.final_time) for r in known.collect())


def test_forced_prefixes_agree_with_the_table_form(spark, events):
    df = spark.createDataFrame(events, SCHEMA).where("size(hyps) > 0")
    mine = {r.seq: (r.n_kept, r.prefix) for r in e.prepared(df).collect()}
    flat = df.select(F.col("seq").alias("utt"), F.explode("hyps").alias("h")).select("utt", "h.tokens", "h.score", F.lit(2.0).alias("waited"))
    assert mine == {r.utt: (r.n_kept, r.prefix) for r in lm.forced_prefix(flat, 1.0).collect()}


def run(spark, folder, batches, stream, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"batch={i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "*"))
    q = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name), q


def test_stream_with_late_rows_equals_batch(spark, events, tmp_path):
    """Rows come up to 6 s late; a last row of another session lets the watermark pass all."""
    rng = random.Random(2)
    come = sorted(events, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 6)))
    batches = [come[i : i + 60] for i in range(0, len(come), 60)] + [[(99, 1, at(500), "session_start", None)]]
    got, q = run(spark, tmp_path, batches, lambda s: e.endings_stream(s, 5.0, 1.5, late="7 seconds", keep=1000.0), "endings")
    assert rows_of(got) == plain(events, 5.0, 1.5, 493)
    rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(rows[1:]) < len(events) / 2, "passed events stay in the state"


def test_processing_time_ends_a_session_without_a_watermark(spark, tmp_path):
    rows = [(1, 1, at(0), "session_start", None), (1, 2, at(1), "partial", [(0.0, ["a"])]), (2, 1, at(0), "session_end", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = e.endings_stream(source, 1.0, 60.0, clock="processing").writeStream.format("memory").queryName("clock").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(2)
            if spark.table("clock").count() == 2:
                break
        assert {(r.session, r.kind) for r in spark.table("clock").collect()} == {(1, "Silence"), (2, "EOS")}
    finally:
        q.stop()


def test_a_session_costs_one_read_and_one_write():
    """All that a session has is one row of state, no frame leaves without rows, and only a timer that has changed is touched."""
    calls, held = [], []

    class State:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, row):
            calls.append("update")
            held.append(row)

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, t):  # noqa: N802
            calls.append(("register", t))

        def deleteTimer(self, t):  # noqa: N802
            calls.append(("delete", t))

    own = e.Endings(5000, 1500, False, 10_000)
    own.init(Handle())
    assert list(own.settle((7,), [(3000, 1, "partial", 1, ["a"]), (1000, 0, "final", None, None)], 0)) == []
    assert calls == ["get", ("register", 1000), "update"]
    calls.clear()
    assert list(own.settle((7,), [(2000, 2, "partial", 1, ["b"])], 0)) == [] and calls == ["get", "update"], "the timer stays"
    calls.clear()
    (found,) = own.settle((7,), [], 4000, expired=1000)
    assert found[["kind", "at", "n_kept"]].values.tolist() == [["Forced", 3.0, 1]] and calls == ["get", ("register", 8001), "update"]
    calls.clear()
    (found,) = own.settle((7,), [], 8001, expired=8001)
    assert found[["kind", "at"]].values.tolist() == [["Silence", 8.0]] and calls == ["get", ("register", 18_000), "update"]
    calls.clear()
    assert list(own.settle((7,), [], 18_000, expired=18_000)) == [] and calls == ["get", "clear"] and not held
