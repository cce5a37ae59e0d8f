"""Feature statistics and signal arithmetic over arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def feature_stats(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, dim, n, mean, var (population) of each feature dimension."""
    d = frames.select(*(by or []), F.posexplode("features").alias("dim", "x"))
    return d.groupBy(*(by or []), "dim").agg(F.count("*").alias("n"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.var_pop("x"), 8).alias("var"))


def normalised(frames: DataFrame, stats: DataFrame) -> DataFrame:
    """utt, frame, dim, value: features less the mean, by the deviation; stats has a row per dimension."""
    d = frames.select("utt", "frame", F.posexplode("features").alias("dim", "x"))
    return d.join(F.broadcast(stats.select("dim", "mean", "var")), "dim").select("utt", "frame", "dim", F.round((F.col("x") - F.col("mean")) / F.sqrt("var"), 6).alias("value"))


def utterance_stats(frames: DataFrame) -> DataFrame:
    """utt, dim, n, mean, var of each utterance's own frames."""
    return feature_stats(frames, ["utt"])


def blended(frames: DataFrame, stats: DataFrame, share: float) -> DataFrame:
    """utt, frame, dim, value: features normalised by the data set's statistics (stats, by share) and by their utterance's own (by the rest);
    share 0 is the utterance mode. A dimension that does not vary is only centred."""
    own = utterance_stats(frames).select("utt", "dim", F.col("mean").alias("_m"), F.col("var").alias("_v"))
    d = frames.select("utt", "frame", F.posexplode("features").alias("dim", "x")).join(own, ["utt", "dim"]).join(F.broadcast(stats.select("dim", "mean", "var")), "dim")
    scaled = lambda m, v: (F.col("x") - F.col(m)) / F.when(F.col(v) > 0, F.sqrt(v)).otherwise(F.lit(1.0))
    return d.select("utt", "frame", "dim", F.round(share * scaled("mean", "var") + (1 - share) * scaled("_m", "_v"), 6).alias("value"))


def stat_preconditions(config: dict[str, object]) -> dict[str, object]:
    """A feature job's settings for a run that gathers statistics: no augmentation, noise, dither or normalisation."""
    return config | {"normalise": False, "dither": 0.0, "speed": False, "noise": False, "babble": False, "narrow_band": False, "masks": False}


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once per row: an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def snr_mix(signal: Column, noise: Column, snr_db: Column) -> Column:
    """signal plus noise (of its length) at a signal-to-noise ratio in dB, scaled back to the signal's power."""
    gain = F.sqrt(power(signal) / (power(noise) * F.pow(F.lit(10.0), snr_db / 10)))
    mixed = let(gain, lambda g: F.zip_with(signal, noise, lambda s, n: s + g * n))
    return let(mixed, lambda m: let(F.sqrt(power(signal) / power(m)), lambda c: F.transform(m, lambda v: v * c)))


def cropped(noise: Column, length: Column, ratio: Column) -> Column:
    """A stretch of the noise of a length; ratio (0 to 1) says how much of what is left over lies before it."""
    return F.slice(noise, F.floor((F.size(noise) - length) * ratio).cast("int") + 1, length)


def noise_mixed(signal: Column, noise: Column, snr_db: Column, ratio: Column) -> Column:
    """snr_mix() with the part of a longer noise that the ratio points to; a shorter noise is an error (tile it before)."""
    enough = F.when(F.size(noise) >= F.size(signal), noise).otherwise(F.raise_error(F.lit("the noise is shorter than the signal")))
    return snr_mix(signal, cropped(enough, F.size(signal), ratio), snr_db)


def babble(signals: DataFrame, batch: int, snr_db: float) -> DataFrame:
    """Each signal (batch_no, pos, signal) mixed with the next of its batch, the last with the first."""
    w = Window.partitionBy("batch_no").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lead("signal").over(w), F.first("signal").over(whole))
    d = signals.withColumn("_other", other).withColumn("_n", F.count("*").over(Window.partitionBy("batch_no")))
    return d.where("_n > 1").withColumn("mixed", snr_mix(F.col("signal"), F.col("_other"), F.lit(snr_db))).drop("_other", "_n")


def fuzzy_top(rows: DataFrame, lanes: int, packet: int) -> DataFrame:
    """id, pos, value: in each packet and lane of a row the greatest value stays, all others become the least of those that stay.
    Position p lies in packet p div packet and in lane p % lanes; the first of equal values stays."""
    d = rows.select("id", F.posexplode("values").alias("pos", "x")).withColumns({"_p": F.expr(f"pos div {packet}"), "_l": F.col("pos") % lanes})
    top = d.groupBy("id", "_p", "_l").agg(F.max(F.struct("x", (-F.col("pos")).alias("m"))).alias("_t")).select("id", (-F.col("_t.m")).alias("pos"), F.col("_t.x").alias("_kept"))
    least = top.groupBy("id").agg(F.min("_kept").alias("_least"))
    return d.select("id", "pos").join(top, ["id", "pos"], "left").join(least, "id").select("id", "pos", F.coalesce("_kept", "_least").alias("value"))


def snapshot_average(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, column: the mean of each place of the arrays of a key."""
    d = rows.select(key, F.posexplode(column).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias(column))


def trim_silence(x: Column, threshold_db: float) -> Column:
    """x from its first to its last value above a threshold in dB of its greatest value."""
    least = F.array_max(F.transform(x, F.abs)) * 10 ** (threshold_db / 20)
    loud = let(least, lambda m: F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > m, i)), lambda i: i.isNotNull()))
    return F.when(F.size(loud) > 0, F.slice(x, F.array_min(loud) + 1, F.array_max(loud) - F.array_min(loud) + 1)).otherwise(F.slice(x, 1, 0))


def padded(x: Column, before: int, after: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), before), x, F.array_repeat(F.lit(0.0), after))


def mask_spans(n: Column, masks: Column | int, least: int, most: Column | int, seed: Column, kind: str) -> Column:
    """array of (lo, hi): so many masks of least to most places among n, where a hash of the seed puts them."""
    draw = lambda i, k, below: F.pmod(F.xxhash64(seed, F.lit(kind), i, F.lit(k)), F.greatest(below, F.lit(1)))

    def span(i: Column) -> Column:
        width = F.lit(least) + draw(i, 1, F.lit(most) - least + 1)
        return let(width, lambda w: let(draw(i, 2, n - w + 1), lambda lo: F.struct(lo.alias("lo"), (lo + w).alias("hi"))))

    count = F.lit(masks).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), span)).otherwise(F.array().cast("array<struct<lo: bigint, hi: bigint>>"))


def share_of(value: float, n: Column) -> Column:
    """A number as it is, or below 1 as a share of n, rounded."""
    return F.bround(n * value).cast("int") if 0 < value < 1 else F.lit(int(value))


def spec_masked(x: Column, seed: Column, freq: tuple[int, int, int] = (0, 0, 10), time: tuple[float, int, float] = (0, 0, 10), noise: float = 0.0) -> Column:
    """Features x (an array of frames, each an array) with bands of dimensions and stretches of frames masked. freq and time: how many
    masks, least and most width; below 1, the number and the most width of time masks are shares of the frames. Masked places are 0, or
    with noise a normal draw about the dimension's mean, by noise times its deviation. All is fixed by the seed."""
    frames, dims = F.size(x), F.size(F.get(x, F.lit(0)))
    bands = mask_spans(dims, freq[0], freq[1], freq[2], seed, "f")
    gaps = mask_spans(frames, share_of(time[0], frames), time[1], share_of(time[2], frames), seed, "t")
    hit = lambda spans, i: F.exists(spans, lambda s: (i >= s["lo"]) & (i < s["hi"]))
    unit = lambda t, d, k: (F.pmod(F.xxhash64(seed, t, d, F.lit(k)), F.lit(1 << 30)) + 1) / float(1 << 30)
    total = lambda f: F.aggregate(x, F.array_repeat(F.lit(0.0), dims), lambda a, row: F.zip_with(a, row, lambda p, v: p + f(v)))

    def masked(cells: Column) -> Column:
        mean = lambda d: F.get(cells["sum"], d) / frames
        deviation = lambda d: F.sqrt(F.greatest((F.get(cells["squares"], d) - frames * mean(d) * mean(d)) / F.greatest(frames - 1, F.lit(1)), F.lit(0.0)))
        fill = lambda t, d: mean(d) + noise * deviation(d) * F.sqrt(-2 * F.log(unit(t, d, 3))) * F.cos(2 * math.pi * unit(t, d, 4)) if noise else F.lit(0.0)
        return F.transform(x, lambda row, t: F.transform(row, lambda v, d: F.when(hit(cells["gaps"], t) | hit(cells["bands"], d), fill(t, d)).otherwise(v)))

    return let(F.struct(bands.alias("bands"), gaps.alias("gaps"), total(lambda v: v).alias("sum"), total(lambda v: v * v).alias("squares")), masked)


def tiled(overlap: int = 3200, growth: float = 0.6):
    """A function of (signal, length): the signal joined to itself until it is longer than the length. Each seam fades from one copy to
    the other along quarter cosines over overlap samples, or fewer where a round would then grow the signal by less than growth."""
    fall = np.cos(np.linspace(0, np.pi / 2, overlap))

    def lengths(size: int, least: int) -> list[int]:
        """The signal's length before and after each round, the last one above least."""
        out = [size]
        while 0 < out[-1] <= least:
            n = out[-1]
            gained = n - overlap
            if gained < growth * n:
                gained = max(int(growth * n), 1)
            out.append(n + gained)
        return out

    @F.pandas_udf("array<double>")
    def run(signal: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for x, least in zip(signal, length, strict=True):
            sizes = lengths(len(x), least)
            whole = np.empty(sizes[-1])
            whole[: sizes[0]] = x
            for n, longer in zip(sizes, sizes[1:], strict=False):
                start = longer - n  # where the second copy begins
                seam = n - start
                lead, rest = whole[:seam].copy(), whole[seam:n].copy()
                whole[start:n] = whole[start:n] * fall[:seam] + lead * fall[::-1][:seam]
                whole[n:longer] = rest
            out.append(whole)
        return pd.Series(out)

    return run


def noise_assignment(utts: DataFrame, noises: DataFrame, seed: int, low: float, high: float) -> DataFrame:
    """utts with a noise (id), a ratio in [low, high) dB and a start share, all fixed by a hash of utt and seed. noises: noise_id, numbered
    from 0; their number is a one-row aggregate."""
    unit = lambda k: F.pmod(F.xxhash64("utt", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    n = noises.agg(F.count("*").alias("_n"))
    return utts.join(F.broadcast(n)).withColumns({"noise_id": F.floor(unit(1) * F.col("_n")).cast("long"), "snr": low + unit(2) * (high - low), "start": unit(3)}).drop("_n").join(noises, "noise_id")
