"""Frame stacking, overlapping segments and their merge, silence and end-mark trimming."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stacked(frames: DataFrame, depth: int, step: int, value: str = "value", by: tuple[str, ...] = ("utt",)) -> DataFrame:
    """Every step-th frame with the values of the next depth - 1 frames, zero past the end. frames: by, frame (from 0), value; by may name a
    dimension beside the utterance."""
    w = Window.partitionBy(*by).orderBy("frame")
    ahead = [F.lead(value, k, 0.0).over(w).alias(f"v{k}") for k in range(depth)]
    return frames.select(*by, "frame", *ahead).where(F.col("frame") % step == 0)


def segments(utts: DataFrame, size: int, overlap: int, pad: bool = True) -> DataFrame:
    """utt, seg, first, last: segments of size frames that share overlap frames; utts: utt, n. Utterances shorter than a segment are one."""
    if not size > overlap >= 0:
        raise ValueError("a segment must be longer than the overlap")
    hop = size - overlap
    whole = F.floor((F.col("n") - overlap) / hop)
    rest = (F.col("n") - overlap) % hop > 0
    count = F.when(F.col("n") < size, 1).otherwise(whole + F.when(rest & F.lit(pad), 1).otherwise(0)).cast("int")
    d = utts.withColumn("seg", F.explode(F.sequence(F.lit(0), count - 1)))
    return d.select("utt", "seg", (F.col("seg") * hop).alias("first"), F.least(F.col("seg") * hop + size, F.col("n")).alias("last"))


def frames_of(seconds: Column, width: float) -> Column:
    return F.bround(seconds / width).cast("int")


def continuous(ts: Column, seg: Column, size: int, overlap: int, reduction: int) -> Column:
    return F.transform(ts, lambda t: t + seg * ((size - overlap) // reduction))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(own: Column, trusted: Column, edge: int, look: int) -> Column:
    """A segment (array of token y, time t) without what it shares with the one before: leading tokens before the edge go, then of the first
    look tokens those among the trusted ones, each of which is used up together with those before it."""
    start = F.array_position(F.transform(own, lambda o: o["t"] >= edge), True).cast("int")
    rest = F.when(start > 0, F.slice(own, start, F.size(own))).otherwise(F.slice(own, 1, 0))

    def drop(b: Column, o: Column) -> Column:
        at, used = F.array_position(b["own"]["y"], o["y"]).cast("int"), F.array_position(b["trusted"], o["y"]).cast("int")
        left = F.concat(F.slice(b["own"], 1, at - 1), F.slice(b["own"], at + 1, F.size(b["own"])))
        return F.when(used > 0, F.struct(left.alias("own"), F.slice(b["trusted"], used + 1, F.size(b["trusted"])).alias("trusted"))).otherwise(b)

    return _let(rest, lambda r: F.aggregate(F.slice(r, 1, look), F.struct(r.alias("own"), trusted.alias("trusted")), drop)["own"])


def merged(segs: DataFrame, overlap: int, reduction: int, look: int = 3, hop: int = 0, end: int | None = None) -> DataFrame:
    """utt, tokens, timestamps: segments (utt, seg, tokens, timestamps) joined in order without what they share, by a fold in the JVM. A
    segment trusts the last look tokens of the trimmed one right before it. hop, in units of the timestamps, is added per segment; with end,
    nothing is taken after the first segment that has this token."""
    edge = math.ceil(overlap / reduction)
    zipped = F.zip_with("tokens", "timestamps", lambda y, t: F.struct(y.cast("int").alias("y"), t.cast("long").alias("t")))
    rows = segs.select("utt", F.struct(F.col("seg").cast("long").alias("seg"), zipped.alias("own")).alias("s")).groupBy("utt").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def join(a: Column, s: Column) -> Column:
        follows, known = a["seg"] + 1 == s["seg"], F.size(a["parts"]) > 0
        trusted = F.when(follows, a["last"]).otherwise(F.slice(a["last"], 1, 0))
        own = F.when(known, trimmed(s["own"], trusted, edge, look)).otherwise(s["own"])

        def added(own: Column) -> Column:
            placed = F.transform(own, lambda o: F.struct(o["y"].alias("y"), (o["t"] + s["seg"] * hop).cast("long").alias("t")))
            done = F.lit(False) if end is None else F.coalesce(F.array_contains(s["own"]["y"], end), F.lit(False))
            last = F.slice(own["y"], F.greatest(F.size(own) - look, F.lit(0)) + 1, look)
            return F.struct(s["seg"].alias("seg"), last.alias("last"), F.array_append(a["parts"], placed).alias("parts"), done.alias("done"))

        return F.when(a["done"], a).otherwise(_let(own, added))

    start = F.expr("named_struct('seg', bigint(null), 'last', cast(array() as array<int>), 'parts', cast(array() as array<array<struct<y: int, t: bigint>>>), 'done', false)")
    folded = rows.select("utt", F.flatten(F.aggregate("s", start, join)["parts"]).alias("o"))
    return folded.select("utt", F.col("o.y").alias("tokens"), F.col("o.t").alias("timestamps"))


def until_end(segs: DataFrame, has_end: Column) -> DataFrame:
    """Segments up to and with the first that has an end mark."""
    w = Window.partitionBy("utt").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("_end", has_end.cast("int")).withColumn("_before", F.coalesce(F.max("_end").over(w), F.lit(0))).where("_before = 0").drop("_end", "_before")


def silence_cut(tokens: DataFrame, threshold: float, width: float) -> DataFrame:
    """tokens (utt, pos, t) up to the first gap above the threshold, with final_time: when silence ended the utterance, or null."""
    gap = int(round(threshold / width))
    w = Window.partitionBy("utt").orderBy("pos")
    d = tokens.withColumn("_prev", F.lag("t").over(w)).withColumn("_gap", (F.col("t") - F.col("_prev")) > gap)
    first = d.where("_gap").groupBy("utt").agg(F.min("pos").alias("_first"), F.min_by("_prev", "pos").alias("_at"))
    cut = d.join(first, "utt", "left").where("_first is null or pos < _first")
    return cut.withColumn("final_time", F.when(F.col("_at").isNotNull(), F.round((F.col("_at") + 1 + gap) * width, 6))).drop("_prev", "_gap", "_first", "_at")


def end_place(tokens: Column, end: int, blank: int, terminal: bool) -> Column:
    """Index of the end mark that cuts a token array: the first one where it is terminal, else the earliest of the run of end marks and
    blanks that the tokens close with; null if there is none."""
    n = F.size(tokens)
    if terminal:
        at = F.array_position(tokens, end)
        return F.when(at > 0, (at - 1).cast("int"))
    places = F.transform(tokens, lambda y, i: F.when((y != end) & (y != blank), i))
    tail = F.coalesce(F.array_max(places), F.lit(-1)) + 1
    ends = F.filter(F.transform(tokens, lambda y, i: F.when((y == end) & (i >= tail), i)), lambda i: i.isNotNull())
    return F.when(n > 0, F.array_min(ends).cast("int"))


def chunks(values: Column, size: int) -> Column:
    """Fixed chunks of an array, the last one filled with zeros."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.concat(F.slice(values, s, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), s + size - 1 - F.size(values)))))
