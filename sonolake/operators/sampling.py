"""Mixing manifests into epochs, and the order of utterances in an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.tables import indexed, ranked, seeded, written


def manifest_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("manifest").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"))


def fractions(sizes: DataFrame, mode: str, ratio: Column | None = None, exponent: float = 0.0) -> DataFrame:
    """sizes with frac, a manifest's target weight: its length, ratio times length, the ratio, or length per duration times its
    share of the duration to the exponent. Sums over all manifests are one-row aggregates, joined as such."""
    if mode == "canary":
        total = sizes.agg(F.sum("duration").alias("_t"))
        return sizes.join(F.broadcast(total)).withColumn("frac", F.col("n") / F.col("duration") * F.pow(F.col("duration") / F.col("_t"), exponent)).drop("_t")
    frac = {"none": F.col("n").cast("double"), "relative": ratio * F.col("n") if ratio is not None else None, "absolute": ratio}[mode]
    return sizes.withColumn("frac", frac.cast("double"))


def epoch_sizes(fracs: DataFrame, batch: int) -> DataFrame:
    """fracs with utts (a manifest's utterances per epoch, whole batches) and repetition (epochs until all of it is used)."""
    total = fracs.agg(F.sum("frac").alias("_tot"))
    target = fracs.join(F.broadcast(total)).withColumn("_target", F.col("frac") / F.col("_tot"))
    length = target.agg(F.min(F.col("n") / F.col("_target")).alias("_len"))
    utts = F.floor(F.floor(F.col("_target") * F.col("_len") + 1e-9) / batch) * batch
    sized = target.join(F.broadcast(length)).withColumn("utts", utts.cast("long"))
    return sized.withColumn("repetition", F.when(F.col("utts") > 0, F.ceil(F.col("n") / F.col("utts")))).drop("_tot", "_target", "_len")


def epoch_report(sizes: DataFrame, total: int) -> DataFrame:
    """sizes (of epoch_sizes) with share (of an epoch), and the same on each row: epochs (until total utterances are drawn) and
    repetition_epochs (until all manifests are used up). A manifest without a whole batch in an epoch, or with more than it has, is an error."""
    one = sizes.agg(F.sum("utts").alias("_sum"), F.max("repetition").alias("repetition_epochs"))
    fits = F.when((F.col("utts") > 0) & (F.col("utts") <= F.col("n")), F.col("utts")).otherwise(F.raise_error(F.concat(F.lit("no whole batch from manifest "), F.col("manifest"))))
    d = sizes.join(F.broadcast(one)).withColumn("utts", fits)
    return d.withColumns({"share": F.round(F.col("utts") / F.col("_sum"), 8), "epochs": F.ceil(F.lit(total) / F.col("_sum"))}).drop("_sum")


def epochs(df: DataFrame, sizes: DataFrame, n_epochs: int, seed: int = 1) -> DataFrame:
    """epoch, manifest, fname, duration: manifests are cycled; epoch e takes the next utts of each one's seeded order. Each utterance
    finds its own epochs by arithmetic, so that no epoch table is multiplied by the manifest."""
    keyed = df.select("manifest", "fname", "duration", seeded(seed, "fname").alias("_key"))
    placed = ranked(keyed, ["manifest"], ["_key", "fname"], "_r").join(sizes.where("utts > 0").select("manifest", "n", "utts"), "manifest")
    # its places are _r + c * n for whole c; an epoch holds places [e * utts, (e + 1) * utts)
    cycles = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(n_epochs) * F.col("utts") - 1) / F.col("n")).cast("long"))
    every = placed.withColumn("_c", F.explode(cycles)).withColumn("_place", F.col("_r") + F.col("_c") * F.col("n"))
    return every.where(F.col("_place") < n_epochs * F.col("utts")).select(F.expr("_place div utts").cast("int").alias("epoch"), "manifest", "fname", "duration")


def bucketed(df: DataFrame, buckets: int, batch: int, seed: int = 1) -> DataFrame:
    """fname, duration, bucket, batch, batch_order: sorted by duration into buckets of whole batches, shuffled inside them, then the
    batches shuffled. batch is the number inside the bucket; batch_order is the sort key of its turn."""
    by_duration = indexed(df.select("fname", "duration", seeded(seed, "fname").alias("_k")), ["duration", "_k", "fname"], "_rn")
    size = df.agg((F.ceil(F.ceil(F.count("*") / buckets) / batch) * batch).alias("_size"))
    b = by_duration.join(F.broadcast(size)).withColumn("bucket", F.expr("_rn div _size")).withColumn("_k2", seeded(seed + 1, "fname"))
    inside = ranked(b.drop("_size"), ["bucket"], ["_k2", "fname"], "_in")
    return inside.withColumn("batch", F.expr(f"_in div {batch}")).select("fname", "duration", "bucket", "batch", seeded(seed + 2, "bucket", "batch").alias("batch_order"))


def striped(df: DataFrame, world: int) -> DataFrame:
    """df with place (longest first) and worker: worker i takes places i, i + world, ..."""
    ordered = indexed(df, [F.desc("duration"), F.col("fname")], "place")
    return ordered.withColumn("worker", (F.col("place") % world).cast("int"))


def longest_first(ordered: DataFrame, width: int) -> DataFrame:
    """ordered (place, duration, ...) with the chunk of width that has most audio swapped with the first chunk; ties go to the earlier."""
    chunk = ordered.groupBy(F.expr(f"place div {width}").alias("chunk")).agg(F.sum("duration").alias("total"))
    best = chunk.agg(F.max_by("chunk", F.struct("total", -F.col("chunk"))).alias("_best"))
    own = F.expr(f"place div {width}")
    moved = F.when(own == F.col("_best"), F.col("place") - F.col("_best") * width).when(own == 0, F.col("place") + F.col("_best") * width).otherwise(F.col("place"))
    return ordered.join(F.broadcast(best)).withColumn("place", moved).drop("_best")


def pessimistic(ordered: DataFrame, widths: tuple[int, int, int], tie: str = "fname") -> DataFrame:
    """ordered (place from 0, duration, ...) with the longest work first: the chunk with most audio is swapped to the front at three
    widths (a step of all workers, of one machine, of one batch), then the longest utterances are spread over the first step, one to
    a batch, each in exchange for the batch's longest. An order of no more than the first width stays as it is.

    The last step moves as many rows as the first width at most: their places are worked out on the driver, whatever the table's size."""
    n, (step, _, batch) = ordered.count(), widths
    if n <= step:
        return ordered
    for width in widths:
        ordered = longest_first(ordered, width) if n > width else ordered
    ordered = written(ordered, "pessimistic")
    top = [(r.place, r.duration) for r in ordered.orderBy(F.desc("duration"), "place").limit(step // batch).select("place", "duration").collect()]
    length = {r.place: r.duration for r in ordered.where(F.col("place") < step).select("place", "duration").collect()} | dict(top)
    holds = {p: p for p in length}  # which row stands at a place
    for i, (far, _) in enumerate(top):
        near = max(range(i * batch, (i + 1) * batch), key=lambda p: length[holds[p]])
        holds[near], holds[far] = holds[far], holds[near]
    moves = [(row, p) for p, row in holds.items() if row != p]
    if not moves:
        return ordered
    table = ordered.sparkSession.createDataFrame(moves, "place long, _to long")
    return ordered.join(F.broadcast(table), "place", "left").withColumn("place", F.coalesce("_to", "place")).drop("_to").select(*ordered.columns)


def in_buffers(ordered: DataFrame, buffer: int, key: list[Column]) -> DataFrame:
    """ordered (place, ...) with places dealt anew inside each buffer of so many consecutive ones, by a key: a seeded hash shuffles a stream
    of shards as far as its buffer reaches, a duration sorts it before batches are cut."""
    chunk = F.expr(f"place div {buffer}")
    inside = F.row_number().over(Window.partitionBy("_buffer").orderBy(*key, "place")) - 1
    return ordered.withColumn("_buffer", chunk).withColumn("place", (F.col("_buffer") * buffer + inside).cast("long")).drop("_buffer")


def nth_batch(ordered: DataFrame, batch: int, n: int) -> DataFrame:
    """The rows of one batch of ordered (place, ...)."""
    return ordered.where(F.expr(f"place div {batch}") == n)


def ordered_by(df: DataFrame, hook: Callable[[DataFrame], list[Column]], tie: str = "fname") -> DataFrame:
    """df with place in the order that a user's hook gives as columns, ties by a column."""
    return indexed(df, [*hook(df), F.col(tie)], "place")


def first_n(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def resumed(ordered: DataFrame, world: int, batch: int, step: int) -> DataFrame:
    """Each worker's share of ordered (place, ...), batches dealt in turn, less the step * batch utterances it has done."""
    b = F.expr(f"place div {batch}")
    dealt = ordered.withColumns({"worker": (b % world).cast("int"), "turn": F.expr(f"(place div {batch * world}) * {batch} + place % {batch}")})
    return dealt.where(F.col("turn") >= step * batch)


def longest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("duration"), "fname").limit(k)


def shuffled_prefix(df: DataFrame, n_epochs: int, seed: int = 1) -> DataFrame:
    """df (epoch, fname, ...) with order_key: epochs before n_epochs are ordered by a seeded hash, later ones by duration."""
    key = F.when(F.col("epoch") < n_epochs, seeded(seed, "epoch", "fname")).otherwise(F.lpad(F.round(F.col("duration") * 1000).cast("long").cast("string"), 20, "0"))
    return df.withColumn("order_key", key)


def snr_schedule(step: Column, delay: int, ramp: int, start: float, low: float, high: float) -> tuple[Column, Column]:
    """(lowest, highest) signal-to-noise ratio at a step: held at start, then down in a line to the final range."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - delay) / F.lit(float(ramp))))
    return start + (low - start) * t, start + (high - start) * t


def blend_schedule(step: Column, delay: int, ramp: int, start: float) -> Column:
    """The share of stored statistics at a step: start, then in a line up to 1."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - delay) / F.lit(float(ramp))))
    return start + (1 - start) * t


def loader_batches(n: Column, world: int, batch: int) -> Column:
    return F.ceil(F.ceil(n / world) / batch)


