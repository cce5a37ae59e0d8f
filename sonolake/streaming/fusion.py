"""Partial and final responses fused to the times at which words or tokens were first seen, in batch and on a stream.

Finals follow one another in a session: each of their characters has a place in the session. A partial's characters stand from the
place where the finals before it end. A final's character was on the screen since the first partial after the last one that had
another character at its place (partials that do not reach that far change nothing); without such a partial, since the final.

In batch this is a join of characters by place. On a stream, responses wait until the watermark has passed them, so that they are
taken in their order and late ones count; then the same rule runs over a session's open partials.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from sonolake.tables import running

WORDS = "session long, word string, ts double"
STATE = "kinds array<string>, texts array<string>, times array<double>, seqs array<long>, stamps array<long>, places array<long>, seen array<string>, since array<double>, place long, word string, ts double, last long"


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def placed(responses: DataFrame, order: list[str]) -> DataFrame:
    """The partial and final responses (session, order, kind, text) with place, that of their first character in the session, and spaces,
    how many of those the finals before have."""
    r = responses.where("kind in ('partial', 'final')").withColumn("text", F.coalesce("text", F.lit("")))
    of = lambda x: f"if(kind = 'final', {x}, 0)"
    return running(r, ["session"], order, {"place": of("char_length(text)"), "spaces": of("char_length(text) - char_length(replace(text, ' ', ''))")})


def seen_since(finals: DataFrame, partials: DataFrame, order: list[str]) -> DataFrame:
    """finals (session, at, char, order, ts, one row per place) with since: when the character at that place was first seen for good.
    partials: session, at, char, order, ts."""
    p = partials.select(F.col("session").alias("_session"), F.col("at").alias("_at"), F.col("char").alias("_char"), F.struct(*order).alias("_order"), F.col("ts").alias("_ts"))
    met = finals.withColumn("order", F.struct(*order)).join(p, F.expr("session = _session and at = _at and _order < order"))
    later = Window.partitionBy("session", "at").orderBy(F.desc("_order")).rowsBetween(Window.unboundedPreceding, 0)
    unbroken = met.withColumn("_other", F.max(F.col("_char") != F.col("char")).over(later)).where("not _other")
    first = unbroken.groupBy("session", "at").agg(F.min_by("_ts", "_order").alias("_since"))
    return finals.join(first, ["session", "at"], "left").withColumn("since", F.coalesce("_since", "ts")).drop("_since")


def words(responses: DataFrame) -> DataFrame:
    """session, word, ts from responses (session, seq, ts, kind: partial or final, text), by the batch form of the rule. A word's time is
    that of its last character to be seen; spaces part words, also across finals."""
    order = ["ts", "seq"]
    r = placed(responses, order)
    each = r.select("session", "kind", *order, "place", "spaces", F.posexplode(characters(F.col("text"))).alias("i", "char")).withColumn("at", F.col("place") + F.col("i"))
    inside = Window.partitionBy("session", *order).orderBy("i")
    finals = each.where("kind = 'final'").withColumn("number", F.col("spaces") + F.sum((F.col("char") == " ").cast("long")).over(inside)).where("char <> ' '")
    since = seen_since(finals.select("session", "at", "char", *order, "number"), each.where("kind = 'partial'"), order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "")
    return since.groupBy("session", "number").agg(text.alias("word"), F.greatest(F.lit(0.0), F.max("since")).alias("ts")).select("session", "word", "ts")


def tokens(responses: DataFrame) -> DataFrame:
    """session, frame, pos, token, since for the tokens of finals, from responses (session, frame, kind, tokens: array): the frame at which
    the last of a token's characters was seen for good. A final precedes a partial of the same frame. Partials are dropped."""
    r = responses.where("kind in ('partial', 'final')").withColumns({"text": F.array_join("tokens", ""), "rank": (F.col("kind") == "partial").cast("int"), "ts": F.col("frame")})
    order = ["frame", "rank"]
    spots = placed(r, order)
    # the places of a response's tokens: its own place and the lengths of the tokens before
    token = spots.select("session", "kind", *order, "ts", "place", F.posexplode("tokens").alias("pos", "token"))
    before = Window.partitionBy("session", *order).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    token = token.withColumn("start", F.col("place") + F.coalesce(F.sum(F.char_length("token")).over(before), F.lit(0)))
    each = token.select("session", "kind", *order, "ts", "pos", "token", "start", F.posexplode(characters(F.col("token"))).alias("i", "char")).withColumn("at", F.col("start") + F.col("i"))
    since = seen_since(each.where("kind = 'final'").drop("kind", "i", "start"), each.where("kind = 'partial'"), order)
    return since.groupBy("session", "frame", "pos", "token").agg(F.max("since").alias("since"))


def first_seen(text: str, place: int, ts: float, places: list[int], seen: list[str], since: list[float]) -> np.ndarray:
    """The rule for one final that starts at a place, over earlier partials (their places, texts and times) in order."""
    n = len(text)
    if not n or not seen:
        return np.full(n, ts)
    own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shown = np.zeros((len(seen), n), np.uint32)
    for row, start, x in zip(shown, places, seen, strict=True):
        part = np.frombuffer(x.encode("utf-32-le"), np.uint32)[place - start :][:n]
        row[: len(part)] = part
    reach, rows = shown > 0, np.arange(len(seen))[:, None]
    last_other = np.where(reach & (shown != own), rows, -1).max(axis=0)
    first = np.where(reach & (rows > last_other), rows, len(seen)).min(axis=0)
    return np.append(np.array(since), ts)[first]


def words_stream(responses: DataFrame, idle: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """words() on a stream; rows need event_time. A response is taken once the watermark has passed it, in order of (ts, seq) with those
    that came by then. A session that stays idle gives up its open word and its state."""
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in STATE.split(", ")]
        s = dict(zip(names, state.get, strict=True)) if state.exists else {c: [] for c in names} | {"place": 0, "word": "", "ts": 0.0, "last": 0}
        waiting = list(zip(*(s[c] for c in names[:5]), strict=True))
        for b in batches:
            waiting += zip(b["kind"].tolist(), b["text"].fillna("").tolist(), b["ts"].tolist(), b["seq"].tolist(), b["stamp"].tolist(), strict=True)
        now, found = state.getCurrentWatermarkMs(), []
        s["last"] = max([s["last"], *(r[4] for r in waiting)])
        ready = sorted((r for r in waiting if r[4] <= now), key=lambda r: (r[2], r[3]))
        waiting = [r for r in waiting if r[4] > now]
        for kind, text, ts, _, _ in ready:
            if kind == "partial":
                for c, x in zip(("places", "seen", "since"), (s["place"], text, ts), strict=True):
                    s[c] = [*s[c], x]
            elif kind == "final":
                times = first_seen(text, s["place"], ts, s["places"], s["seen"], s["since"])
                s["place"] += len(text)
                open_ = [k for k, (p, x) in enumerate(zip(s["places"], s["seen"], strict=True)) if p + len(x) > s["place"]]
                for c in ("places", "seen", "since"):
                    s[c] = [s[c][k] for k in open_]
                ends = [*np.flatnonzero(np.array(list(text)) == " ").tolist(), len(text)] if text else []
                for a, e in zip([0, *(x + 1 for x in ends)], ends, strict=False):
                    s["word"], s["ts"] = s["word"] + text[a:e], max(s["ts"], float(times[a:e].max(initial=0.0)))
                    if e < len(text):
                        found += [(s["word"], s["ts"])] if s["word"] else []
                        s["word"], s["ts"] = "", 0.0
        if not waiting and now >= s["last"] + gap:
            found += [(s["word"], s["ts"])] if s["word"] else []
            if state.exists:
                state.remove()
        else:
            for c, x in zip(names[:5], zip(*waiting, strict=True) if waiting else [()] * 5, strict=True):
                s[c] = list(x)
            state.update(tuple(s[c] for c in names))
            state.setTimeoutTimestamp(max(min((r[4] for r in waiting), default=s["last"] + gap), now + 1))
        yield pd.DataFrame({"session": pd.Series([key[0]] * len(found), dtype="int64"), "word": pd.Series([w for w, _ in found], dtype="str"), "ts": pd.Series([t for _, t in found], dtype="float64")})

    rows = responses.withWatermark("event_time", late).select("session", "seq", "ts", "kind", "text", F.unix_millis("event_time").alias("stamp"), "event_time")
    return rows.groupBy("session").applyInPandasWithState(step, WORDS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def finals(responses: DataFrame) -> DataFrame:
    return responses.where("kind = 'final'").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "text"))).alias("r")).select("session", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"))


def display(responses: DataFrame) -> DataFrame:
    """session, finals, shown: all finals, and those with the last partial after them; works on a stream in update mode as well."""
    order = F.struct("ts", "seq")
    done = F.array_sort(F.collect_list(F.when(F.col("kind") == "final", F.struct("ts", "seq", "text"))))
    g = responses.where("kind in ('partial', 'final')").groupBy("session").agg(done.alias("d"), F.max(F.when(F.col("kind") == "final", order)).alias("last"), F.max(F.when(F.col("kind") == "partial", F.struct("ts", "seq", "text"))).alias("p"))
    open_ = F.when(F.col("last").isNull() | (F.struct("p.ts", "p.seq") > F.col("last")), F.col("p.text"))
    text = F.array_join(F.transform("d", lambda x: x["text"]), "")
    return g.select("session", text.alias("finals"), F.concat(text, F.coalesce(open_, F.lit(""))).alias("shown"))
