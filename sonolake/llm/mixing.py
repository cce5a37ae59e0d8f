"""Temperature mixing of sources to a token budget (native).

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected: the largest one whose
weights still have the target entropy, but never below the smallest one that keeps every source within the repetition limit.
The weights times the budget are realised as block permutations: a source's documents lie in BLOCKS hashed blocks; in each epoch
blocks are permuted by a hash of (epoch, block) and documents in a block by a hash of (epoch, document). Whole epochs are taken
while the budget lasts; the last epoch ends inside one block, found from running sums over the table of blocks, so that no source,
however large, is ordered as a whole.

Tokens are words. One row holds an entry per source while the exponent is bisected, MAX_SOURCES at most. Nulls: a null source is a
source of its own, a null text has no tokens; sources without tokens are left out. Rows with equal doc_id and tokens are
interchangeable. An empty table gives an empty result; other columns are ignored, or carried by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.llm.common import SPACE, cut, whole

BUDGET_SHARE = 1.0
ENTROPY_SHARE = 0.97
MAX_REPEAT = 4.0
BLOCKS = 1024
STEPS = 40
#: The bisection folds one row with an entry per source: beyond so many it is an error, not a silent memory hog.
MAX_SOURCES = 100_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace(r"[\x20", r"[^\x20"))), F.lit(0)).cast("long")


def order_key(epoch: Column, what: Column) -> Column:
    return F.md5(F.concat_ws("|", epoch.cast("string"), what).cast("binary"))


def block_key(epoch: Column, block: Column) -> Column:
    return order_key(epoch, F.concat(F.lit("block|"), block.cast("string")))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens, name (doc_id as text), block."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    block = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("block|"), name).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(BLOCKS))
    return docs.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), name.alias("name"), block.alias("block"))


def weights(sources: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """source, source_tokens, exponent, weight, quota from source, source_tokens (> 0)."""
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source_tokens", "source"))).alias("s"), F.sum("source_tokens").alias("total"))
    one = one.select(F.when(F.size("s") <= MAX_SOURCES, F.col("s")).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))).alias("s"), "total")
    one = one.select("s", "total", F.expr("transform(s, x -> x.source_tokens / total)").alias("p"))
    z = "aggregate(p, 0D, (c, x) -> c + pow(x, {a}))"
    entropy = f"(ln({z}) - {{a}} / {z} * aggregate(p, 0D, (c, x) -> c + pow(x, {{a}}) * ln(x)))"
    # how often the most repeated source is repeated: its weight by its share
    repeat = f"(array_max(transform(p, x -> pow(x, {{a}} - 1))) / {z} * {budget_share})"
    mid = "((b.lo + b.hi) / 2)"
    step = "named_struct('lo', if({ok}, {m}, b.lo), 'hi', if({ok}, b.hi, {m}))"
    search = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> {{step}}, b -> {{end}})"
    # entropy falls with the exponent: lo always meets the target; repetition falls too: hi always keeps the limit (at 1 it is the budget's share)
    enough = f"{entropy} >= {entropy_share} * ln(size(p))".format(a=mid)
    by_entropy = search.format(step=step.format(ok=enough, m=mid), end="b.lo")
    too_often = f"{repeat} > {max_repeat}".format(a=mid)
    by_repeat = search.format(step=step.format(ok=too_often, m=mid), end="b.hi")
    free = f"if({repeat.format(a='0D')} <= {max_repeat}, 0D, {by_repeat})"
    full = f"if({entropy.format(a='1D')} >= {entropy_share} * ln(size(p)), 1D, {by_entropy})"
    a = one.select("s", "total", "p", F.expr(f"round(greatest({full}, {free}), 6)").alias("exponent"))
    w = a.select("s", "total", "exponent", F.expr(f"transform(array({z.format(a='exponent')}), z -> transform(p, x -> round(pow(x, exponent) / z, 9)))[0]").alias("w"))
    e = w.select("total", "exponent", F.explode(F.arrays_zip("s", "w")).alias("x"))
    quota = F.floor(F.col("x.w") * F.col("total") * budget_share).cast("long")
    return e.select(F.col("x.s.source").alias("source"), F.col("x.s.source_tokens").alias("source_tokens"), "exponent", F.col("x.w").alias("weight"), quota.alias("quota"))


def plan(rows: DataFrame, **options: float) -> DataFrame:
    """source, weight, exponent, block, full (whole epochs), room: tokens of the block that the last epoch takes (all if room >= its tokens)."""
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    totals = blocks.groupBy("source").agg(F.sum("block_tokens").alias("source_tokens")).where("source_tokens > 0")
    w = weights(totals, **options).withColumns({"full": F.expr("quota div source_tokens"), "rest": F.expr("quota % source_tokens")}).withColumnRenamed("source", "_s")
    j = blocks.join(w, F.expr("source <=> _s"))
    order = Window.partitionBy("source").orderBy(block_key(F.col("full"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("block_tokens").over(order), F.lit(0))
    return j.select("source", "block", "block_tokens", "weight", "exponent", "full", (F.col("rest") - before).alias("room"))


def selection(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, source, tokens, block, weight, exponent, full, last: the last epoch has the row; a row's copies are full + last."""
    rows = cut(counted(docs), "counted")
    return chosen(rows, cut(plan(rows, **options), "plan"))


def chosen(rows: DataFrame, p: DataFrame) -> DataFrame:
    """selection() of counted rows by a plan."""
    p = p.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "block_tokens", "weight", "exponent", "full", "room")
    j = rows.join(p, F.expr("source <=> _s and block = _b")).drop("_s", "_b")
    split = (F.col("room") > 0) & (F.col("room") < F.col("block_tokens"))
    inside = Window.partitionBy("source", "block").orderBy(order_key(F.col("full"), F.col("name")), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    cols = ["doc_id", "source", "tokens", "name", "block", "weight", "exponent", "full"]
    whole = j.where(~split).select(*cols, (F.col("room") >= F.greatest("block_tokens", F.lit(1))).alias("last"))
    part = j.where(split).select(*cols, "room", F.sum("tokens").over(inside).alias("run")).select(*cols, (F.col("run") <= F.col("room")).alias("last"))
    return whole.unionByName(part)


def turns(p: DataFrame) -> DataFrame:
    """source, block, epoch, turn (from 0): a block's place in its source's permutation of an epoch, over the table of blocks."""
    e = p.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(block_key(F.col("epoch"), F.col("block")), "block")
    return e.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


def schedule(docs: DataFrame, **options: float) -> DataFrame:
    """A row per copy: doc_id, source, tokens, epoch, block, turn (of the block in the epoch), block_key (which orders the turns), place
    (from 0, inside the block's turn), weight, exponent."""
    rows = cut(counted(docs), "counted")
    p = cut(plan(rows, **options), "plan")
    s = chosen(rows, p)
    epochs = F.expr("if(full + int(last) > 0, sequence(0, full + int(last) - 1), slice(array(0L), 1, 0))")
    e = s.withColumn("epoch", F.explode(epochs.cast("array<int>")))
    inside = Window.partitionBy("source", "block", "epoch").orderBy(order_key(F.col("epoch"), F.col("name")), "doc_id", "tokens")
    t = turns(p).select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("epoch").alias("_e"), "turn")
    placed = e.withColumn("place", (F.row_number().over(inside) - 1).cast("long")).join(t, F.expr("source <=> _s and block = _b and epoch = _e"))
    return placed.select("doc_id", "source", "tokens", "epoch", "block", "turn", block_key(F.col("epoch"), F.col("block")).alias("block_key"), "place", "weight", "exponent")


def mix(docs: DataFrame, **options: float) -> DataFrame:
    """docs with each row as often as the mix takes it; docs' other columns are carried on, whatever their names."""
    copies = selection(docs, **options).select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("tokens").alias("_t"), F.expr("full + int(last)").alias("n"))
    # rows that share doc_id, source and tokens are interchangeable: they share the sum of their copies
    copies = copies.groupBy("_id", "_s", "_t").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    order = Window.partitionBy("doc_id", "source", "tokens").orderBy(F.lit(0))
    d = whole(docs, "doc_id", "source", n_tokens(F.col("text")).alias("tokens")).join(copies, F.expr("doc_id <=> _id and source <=> _s and tokens = _t"))
    one = d.where("rows = 1").select("row", "n")
    more = d.where("rows > 1").withColumn("at", F.row_number().over(order)).select("row", F.expr("n div rows + int(at <= n % rows)").alias("n"))
    return one.unionByName(more).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
