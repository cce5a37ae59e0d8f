"""Overlapping segments: the fold against a plain program, and the stream against the fold."""

import datetime as dt
import random

import pytest

from sonolake.operators import segments
from sonolake.streaming import overlaps

EVENTS = "utt long, seq long, event_time timestamp, token int, x string"
START = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def plain(segs, edge, look=3, hop=0, end=None):
    out, before, done = [], None, False
    for seg, tokens, stamps in sorted(segs):
        if done:
            break
        own = list(zip(tokens, stamps, strict=True))
        done = end is not None and end in tokens
        if before is not None:
            while own and own[0][1] < edge:
                own.pop(0)
            trusted = before[1][-look:] if before[0] + 1 == seg else []
            for y, _ in list(own[:look]):
                if y in trusted:
                    own.remove(next(o for o in own if o[0] == y))
                    trusted = trusted[trusted.index(y) + 1 :]
        before = seg, [y for y, _ in own]
        out += [(y, t + seg * hop) for y, t in own]
    return [y for y, _ in out], [t for _, t in out]


@pytest.mark.parametrize("end", [None, 5])
def test_fold_is_the_plain_program(spark, end):
    rng, rows = random.Random(3), []
    for utt in range(120):
        for seg in range(rng.randint(1, 5)):
            if rng.random() < 0.9:
                n = rng.randint(0, 6)
                rows.append((utt, seg, [rng.randint(0, 5) for _ in range(n)], sorted(rng.randint(0, 6) for _ in range(n))))
    rng.shuffle(rows)
    got = segments.merged(spark.createDataFrame(rows, "utt long, seg int, tokens array<int>, timestamps array<int>"), 5, 2, hop=4, end=end).collect()
    want = {u: plain([r[1:] for r in rows if r[0] == u], 3, hop=4, end=end) for u in {r[0] for r in rows}}
    assert {r.utt: (r.tokens, r.timestamps) for r in got} == want


def test_shared_tokens_are_used_up_in_order(spark):
    """Cases of tokens that two segments share: a trusted token is used once, and those before it are then gone."""
    cases = {
        "one": ([1, 2, 3, 4], [3, 4, 5], [1, 2, 3, 4, 5]), "none": ([1, 2, 3], [7, 8], [1, 2, 3, 7, 8]), "twice": ([4, 4, 4], [4, 4, 4, 4], [4, 4, 4, 4]),
        "order": ([1, 2, 3], [3, 1, 9], [1, 2, 3, 1, 9]), "beyond": ([1, 2, 3], [7, 8, 9, 3], [1, 2, 3, 7, 8, 9, 3]), "empty": ([], [1, 2], [1, 2]), "nothing": ([1], [], [1]),
    }
    rows = [(k, seg, x, [10 + i for i in range(len(x))]) for k, (a, b, _) in cases.items() for seg, x in enumerate((a, b))]
    got = segments.merged(spark.createDataFrame(rows, "utt string, seg int, tokens array<int>, timestamps array<int>"), 4, 1).collect()
    assert {r.utt: r.tokens for r in got} == {k: c for k, (_, _, c) in cases.items()}


def test_stream_with_late_rows_equals_the_table(spark, tmp_path):
    rng, rows = random.Random(6), []
    for utt in range(8):
        s = rng.uniform(0, 5)
        for i in range(60):
            s += rng.choice([0.1, 0.3, 0.5, 1.0]) if rng.random() < 0.97 else 40.0
            rows.append((utt, i, START + dt.timedelta(seconds=round(s, 2)), rng.randint(0, 3), "x"))
    table = spark.createDataFrame(rows, EVENTS)
    come = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 4)))
    end = (99, 0, START + dt.timedelta(seconds=5000), 0, "x")
    for i, part in enumerate([*(come[k : k + 120] for k in range(0, len(come), 120)), [end]]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream = overlaps.merged(source, 5.0, 1.0, 0.5, late="5 seconds")
    q = stream.writeStream.format("memory").queryName("merged_segments").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = sorted(map(tuple, overlaps.merged(table, 5.0, 1.0, 0.5).collect()))
    assert sorted(map(tuple, spark.table("merged_segments").collect())) == want and len(want) > len(rows) * 0.8
    with pytest.raises(ValueError, match="whole units"):
        overlaps.merged(table, 5.0, 1.2, 0.5)
