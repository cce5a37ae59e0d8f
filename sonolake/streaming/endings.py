"""How utterances end: by an end mark, by silence, or, while no final comes, by forced finals.

Events (session, seq, event_time, kind, hyps: array of (score, tokens), or null) are taken in the order of (event time in ms, seq). The first of these ends a session:
a session_end (EOS), or silence of over threshold seconds after the last event (Silence, at the time when it had lasted so long). Until then
a partial that comes over limit seconds after the last final (or forced one, or the session's first event) drops its worst hypotheses until
those left begin alike, and what they share is final (Forced). What comes after the end is ignored.

endings() is the batch form, an ordered fold in the JVM over the events of each session. endings_stream() keeps per session the events that
the watermark hasn't passed and one row of progress; timers end it. In event time both forms give the same rows, late events within the
watermark's delay included. In processing time (clock='processing') events count as they arrive and silence is measured by the clock, so that a
session ends although no watermark moves; what is known of ended sessions expires by its time to live.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HYPS = "array<struct<score: double, tokens: array<string>>>"
OUT = "session long, kind string, at double, n_kept int, prefix array<string>"
_STATE = "last long, since long, ended boolean, timer long, waiting binary"
#: For the state store of every stream with timers or more than one state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_length(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start on."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.array_min(differ)


def alike(hyps: Column) -> Column:
    """n_kept, prefix: how many of the hypotheses stay, best first, when the worst go until those left begin alike, and what they share."""
    best_first = F.reverse(F.array_sort(hyps))

    def cut(listed: Column) -> Column:
        lengths = F.transform(listed, lambda h: shared_length(h["tokens"], F.get(listed, F.lit(0))["tokens"]))
        apart = F.array_position(F.transform(lengths, lambda n, i: (n == 0) & (i > 0)), True).cast("int")
        kept = F.when(apart > 0, apart - 1).otherwise(F.size(listed))
        return F.struct(kept.alias("n_kept"), F.slice(F.get(listed, F.lit(0))["tokens"], 1, F.array_min(F.slice(lengths, 1, kept))).alias("prefix"))

    return F.when(F.size(hyps) > 0, F.get(F.transform(F.array(best_first), cut), F.lit(0)))


def prepared(events: DataFrame) -> DataFrame:
    """session, event_time, ms, seq, kind, n_kept, prefix: what a partial would force does not depend on what came before."""
    forced = F.when(F.col("kind") == "partial", alike(F.col("hyps").cast(HYPS)))
    rows = events.select(F.col("session").cast("long").alias("session"), F.col("event_time").cast("timestamp").alias("event_time"), F.col("seq").cast("long").alias("seq"), "kind", forced.alias("f"))
    return rows.select("session", "event_time", F.unix_millis("event_time").alias("ms"), "seq", "kind", "f.n_kept", "f.prefix")


def endings(events: DataFrame, threshold: float, limit: float, until: Column | None = None) -> DataFrame:
    """session, kind, at (s), n_kept, prefix of every forced final and end. until (a timestamp, constant): when observation stopped, for
    sessions that were silent before; without it only a later event shows a silence."""
    gap, wait = int(threshold * 1000), int(limit * 1000)
    row = lambda kind, at, n="int(null)", p="cast(null as array<string>)": f"named_struct('kind', '{kind}', 'at', {at}, 'n_kept', {n}, 'prefix', {p})"
    silent, ended = f"x.ms - a.last > {gap}", "x.kind = 'session_end'"
    forced = f"(x.kind = 'partial' and size(x.prefix) > 0 and x.ms - coalesce(a.since, x.ms) > {wait})"
    add = lambda what: f"array_append(a.found, {what})"
    step = f"""case when a.ended then a
        when {silent} then named_struct('last', a.last, 'since', a.since, 'ended', true, 'found', {add(row("Silence", f"a.last + {gap}"))})
        when {ended} then named_struct('last', x.ms, 'since', a.since, 'ended', true, 'found', {add(row("EOS", "x.ms"))})
        when {forced} then named_struct('last', x.ms, 'since', x.ms, 'ended', false, 'found', {add(row("Forced", "x.ms", "x.n_kept", "x.prefix"))})
        else named_struct('last', x.ms, 'since', if(x.kind = 'final', x.ms, coalesce(a.since, x.ms)), 'ended', false, 'found', a.found) end"""
    start = "named_struct('last', bigint(null), 'since', bigint(null), 'ended', false, 'found', cast(array() as array<struct<kind: string, at: bigint, n_kept: int, prefix: array<string>>>))"
    folded = prepared(events).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ms", "seq", "kind", "n_kept", "prefix"))).alias("x")).select("session", F.expr(f"aggregate(x, {start}, (a, x) -> {step})").alias("a"))
    found = F.col("a.found")
    if until is not None:
        last = F.expr(row("Silence", f"a.last + {gap}"))
        found = F.when(~F.col("a.ended") & (F.unix_millis(until.cast("timestamp")) - F.col("a.last") > gap), F.array_append(found, last)).otherwise(found)
    return folded.select("session", F.explode(found).alias("r")).select("session", "r.kind", (F.col("r.at") / 1000.0).alias("at"), "r.n_kept", "r.prefix")


class Endings(StatefulProcessor):
    """State of a session, one row that is read and written once each time: progress, its only timer, and the events that the watermark has
    not passed, packed."""

    def __init__(self, gap: int, wait: int, by_clock: bool, keep: int):
        self.gap, self.wait, self.by_clock, self.keep = gap, wait, by_clock, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE, self.keep if self.by_clock else None)

    def take(self, progress: tuple, events: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        """Progress moved over events in order, and what they end or force."""
        last, since, ended = progress
        found = []
        for ms, _, kind, n_kept, prefix in events:
            if ended:
                break
            if last is not None and ms - last > self.gap:
                ended = True
                found.append(("Silence", last + self.gap, None, None))
            elif kind == "session_end":
                ended, last = True, ms
                found.append(("EOS", ms, None, None))
            else:
                since = ms if since is None else since
                if kind == "final":
                    since = ms
                elif kind == "partial" and prefix is not None and len(prefix) and ms - since > self.wait:
                    since = ms
                    found.append(("Forced", ms, n_kept, list(prefix)))
                last = ms
        if not ended and last is not None and now - last > self.gap:
            ended = True
            found.append(("Silence", last + self.gap, None, None))
        return (last, since, ended), found

    def settle(self, key: tuple, rows: list[tuple], now: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        last, since, ended, timer, packed = self.state.get() or (None, None, False, None, None)
        waiting = (pickle.loads(packed) if packed else []) + rows
        ready = sorted((r for r in waiting if self.by_clock or r[0] <= now), key=lambda r: r[:2])
        later = [r for r in waiting if not self.by_clock and r[0] > now]
        (last, since, ended), found = self.take((last, since, ended), ready, now)
        times = [r[0] for r in later]
        if last is not None and not ended:
            times.append(last + self.gap + 1)
        elif ended and not self.by_clock and now < last + self.gap + self.keep:
            times.append(last + self.gap + self.keep)  # state has no time to live in event time
        elif ended and not self.by_clock:
            last, since, ended = None, None, False
        wanted = max(min(times), now + 1) if times else None
        timer = None if timer == expired else timer  # Spark removes it
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if last is None and not later:
            self.state.clear()
        else:
            self.state.update((last, since, ended, wanted, pickle.dumps(later, pickle.HIGHEST_PROTOCOL) if later else None))
        if found:  # a frame costs more than most sessions' events
            kind, at, n_kept, prefix = zip(*found, strict=True)
            yield pd.DataFrame({"session": pd.Series([key[0]] * len(found), dtype="int64"), "kind": pd.Series(kind, dtype="object"), "at": pd.Series([x / 1000.0 for x in at], dtype="float64"), "n_kept": pd.Series(n_kept, dtype="Int32"), "prefix": pd.Series(prefix, dtype="object")})

    def now(self, timers) -> int:  # noqa: ANN001
        return timers.getCurrentProcessingTimeInMs() if self.by_clock else timers.getCurrentWatermarkInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, new = self.now(timerValues), []
        for b in rows:
            ms = [now] * len(b) if self.by_clock else b["ms"].tolist()
            kept = [None if pd.isna(n) else int(n) for n in b["n_kept"].tolist()]
            new += zip(ms, b["seq"].tolist(), b["kind"].tolist(), kept, [None if p is None else list(p) for p in b["prefix"].tolist()], strict=True)
        yield from self.settle(key, new, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.settle(key, [], self.now(timerValues), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def endings_stream(events: DataFrame, threshold: float, limit: float, late: str = "10 seconds", clock: str = "event", keep: float = 3600.0) -> DataFrame:
    """endings() of a stream, in append mode. keep: seconds for which an ended session is remembered, so that its later events are
    ignored. Sets the session's state store to one that has timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = prepared(events.withWatermark("event_time", late) if clock == "event" else events)
    own = Endings(int(threshold * 1000), int(limit * 1000), clock == "processing", int(keep * 1000))
    return rows.groupBy("session").transformWithStateInPandas(own, OUT, "append", "EventTime" if clock == "event" else "ProcessingTime")
