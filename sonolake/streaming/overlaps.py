"""Overlapping segments of token streams, merged as they close.

Tokens (utt, seq, event_time, token) are cut into segments of length seconds, each sharing overlap seconds with the next. A closed
segment loses what it shares with the one before (see operators.segments.merged). On a stream the segments are windows that close with the watermark,
and a second stateful operator behind them keeps the last tokens of each utterance's last segment; a table goes through the ordered
fold. Both give a row per token that stays. Times are whole units since the epoch, the unit being given in seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonolake.operators import segments
from sonolake.streaming.endings import PROVIDER

OUT = "utt long, t long, token int"


def closed_segments(events: DataFrame, length: float, overlap: float, unit: float, late: str = "10 seconds") -> DataFrame:
    """utt, seg, closes (event time of the segment's last moment), tokens and timestamps (units since the segment's start)."""
    hop = length - overlap
    rows = events.select("utt", "seq", F.col("event_time").cast("timestamp").alias("event_time"), F.col("token").cast("int").alias("token"))
    rows = rows.withWatermark("event_time", late) if events.isStreaming else rows
    w = F.window("event_time", f"{round(length * 1000)} milliseconds", f"{round(hop * 1000)} milliseconds").alias("w")
    listed = F.array_sort(F.collect_list(F.struct(F.unix_millis("event_time").alias("ms"), "seq", "token")))
    closed = rows.groupBy("utt", w).agg(listed.alias("x"))
    since = F.transform("x", lambda x: F.floor((x["ms"] - F.unix_millis("w.start")) / round(unit * 1000)).cast("int"))
    return closed.select("utt", F.expr(f"unix_millis(w.start) div {round(hop * 1000)}").alias("seg"), F.window_time("w").alias("closes"), F.col("x.token").alias("tokens"), since.alias("timestamps"))


class Merging(StatefulProcessor):
    """State of an utterance: its last segment's number and the last tokens that stayed of it."""

    def __init__(self, edge: int, look: int, hop: int, length_ms: int, hop_ms: int):
        self.edge, self.look, self.hop, self.length_ms, self.hop_ms = edge, look, hop, length_ms, hop_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "seg long, last array<int>")

    def trimmed(self, own: list[tuple[int, int]], trusted: list[int]) -> list[tuple[int, int]]:
        lead = next((i for i, (_, t) in enumerate(own) if t >= self.edge), len(own))
        left = own[lead:]
        for y, _ in own[lead : lead + self.look]:
            if y in trusted:
                del left[[z for z, _ in left].index(y)]
                trusted = trusted[trusted.index(y) + 1 :]
        return left

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        closed = sorted(((int(s), [int(y) for y in x], [int(t) for t in at]) for b in rows for s, x, at in zip(b["seg"], b["tokens"], b["timestamps"], strict=True)), key=lambda r: r[0])
        before = self.before.get()
        tokens, times = [], []
        for seg, x, at in closed:
            own = list(zip(x, at, strict=True))
            if before:
                own = self.trimmed(own, list(before[1]) if before[0] + 1 == seg else [])
            before = seg, [y for y, _ in own[-self.look :]]
            tokens += [y for y, _ in own]
            times += [t + seg * self.hop for _, t in own]
        self.before.update(before)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        # by then a segment that follows would have closed; after a gap nothing is shared
        self.handle.registerTimer(max(before[0] * self.hop_ms + self.length_ms + 2 * self.hop_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"utt": pd.Series([key[0]] * len(tokens), dtype="int64"), "t": pd.Series(times, dtype="int64"), "token": pd.Series(tokens, dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.before.clear()
        yield pd.DataFrame({"utt": pd.Series([], dtype="int64"), "t": pd.Series([], dtype="int64"), "token": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def merged(events: DataFrame, length: float, overlap: float, unit: float, look: int = 3, late: str = "10 seconds") -> DataFrame:
    """utt, t, token of a table or, in append mode, of a stream. The hop must be whole units."""
    hop = round((length - overlap) / unit)
    if abs(hop * unit - (length - overlap)) > 1e-9:
        raise ValueError("a hop must be whole units")
    closed, edge = closed_segments(events, length, overlap, unit, late), round(overlap / unit)
    if events.isStreaming:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        own = Merging(edge, look, hop, round(length * 1000), round((length - overlap) * 1000))
        return closed.groupBy("utt").transformWithStateInPandas(own, OUT, "append", "EventTime")
    whole = segments.merged(closed, edge, 1, look, hop)
    return whole.select("utt", F.explode(F.arrays_zip("tokens", "timestamps")).alias("o")).select("utt", F.col("o.timestamps").alias("t"), F.col("o.tokens").alias("token"))
