"""Word, character, mixture and punctuation error rates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolake.operators.alignment import distance, edit_path, numbered

# The blocks of code points whose names begin with "CJK ", ideographs and their compatibility forms.
CJK = "⺀-⿟㇀-㇯㐀-䶿一-鿿豈-﫿︰-﹏\U00020000-\U0002FA1F\U00030000-\U000323AF"
MARKS = (",", ".", "?")
# Fixed value: what is a token of a punctuated text, a word or one of the marks.
TOKEN = r"[\w']+|[{}]"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.trim(text), r"\s+"), "")


def char_list(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"\s+", ""), ""), "")


def mixture_list(text: Column) -> Column:
    """Each CJK character is a token, other text is split at white space."""
    return word_list(F.regexp_replace(text, f"([{CJK}])", " $1 "))


TOKENS: dict[str, Callable[[Column], Column]] = {"wer": word_list, "cer": char_list, "mer": mixture_list}


#: Tokens of a batch that are numbered together.
TOKENS_AT_ONCE = 1 << 18


def with_distance(df: DataFrame, ref: str, hyp: str, name: str = "errors") -> DataFrame:
    """df with the edit distance of two array columns (null where one is null). Tokens are numbered in parts of a batch, of TOKENS_AT_ONCE or of
    one row; a pair's memory is its tokens and a strip of bits."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sides = [whole.column(whole.schema.get_field_index(c)) for c in (ref, hyp)]
            sizes = [np.asarray(pc.fill_null(pc.list_value_length(s), 0)).astype(np.int64) for s in sides]
            upto = np.cumsum(sizes[0] + sizes[1])
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOKENS_AT_ONCE, "right")))
                part = [s.slice(lo, hi - lo) for s in sides]
                tokens = np.asarray(pa.concat_arrays([s.flatten() for s in part]).dictionary_encode().indices)
                ends = [np.cumsum(n[lo:hi]) for n in sizes]
                ends[1] += ends[0][-1]
                pair = lambda k: [tokens[e[k] - n[lo + k] : e[k]].tolist() for e, n in zip(ends, sizes, strict=True)]  # noqa: B023, E731
                out = [distance(*pair(k)) if all(s[k].is_valid for s in part) else None for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*whole.slice(lo, hi - lo).columns, pa.array(out, pa.int64())], names=[*whole.schema.names, name])
                lo = hi

    return df.mapInArrow(run, schema)


def rate(errors: Column, words: Column) -> Column:
    """errors / words over a group; infinite without reference words."""
    return F.when(F.sum(words) > 0, F.sum(errors) / F.sum(words)).otherwise(F.lit(float("inf")))


def error_rate(pairs: DataFrame, by: list[str], ref: str = "ref_words", hyp: str = "hyp_words") -> DataFrame:
    d = with_distance(pairs.select(*by, ref, hyp), ref, hyp)
    n = F.size(ref)
    return d.groupBy(*by).agg(F.sum("errors").cast("long").alias("errors"), F.sum(n).cast("long").alias("words"), F.round(rate(F.col("errors"), n), 8).alias("rate"))


def text_error_rate(pairs: DataFrame, by: list[str], kind: str = "wer", standard: Callable[[Column], Column] | None = None) -> DataFrame:
    """Error rates of texts (ref, hyp): standardised if a standardiser is given, then split into the tokens of a kind."""
    side = lambda c: TOKENS[kind]((standard or (lambda x: x))(F.col(c)))
    return error_rate(pairs.select(*by, side("ref").alias("ref_words"), side("hyp").alias("hyp_words")), by)


def by_checkpoint(pairs: DataFrame, checkpoint: str = "checkpoint", kind: str = "wer", standard: Callable[[Column], Column] | None = None) -> DataFrame:
    """checkpoint, percent: the error rate of each checkpoint's texts (ref, hyp) as a percentage with three decimals; infinite where there
    are no reference words but errors."""
    rates = text_error_rate(pairs, [checkpoint], kind, standard)
    return rates.select(checkpoint, F.round(100 * F.col("errors") / F.nullif("words", F.lit(0)), 3).alias("_p"), "rate").select(checkpoint, F.coalesce("_p", F.col("rate")).alias("percent"))


def worker_mean(losses: DataFrame, worker: str = "worker", loss: str = "loss") -> DataFrame:
    """mean: the mean of the workers' mean losses, each worker counting once however many losses it has."""
    return losses.groupBy(worker).agg(F.avg(loss).alias("m")).agg(F.round(F.avg("m"), 8).alias("mean"))


def ctm_words(text: Column) -> Column:
    """A standardised transcript's words: trimmed, split at each single space; an empty transcript is one empty word."""
    return F.split(F.trim(text), " ", -1)


def ctm_error_rate(ref: DataFrame, hyp: DataFrame, standard: Callable[[Column], Column], key: str = "file") -> DataFrame:
    """percent (4 digits), errors, words over the files that both have; ref and hyp: a row per file with its transcript."""
    side = lambda df, name: df.select(key, ctm_words(standard(F.coalesce("transcript", F.lit("")))).alias(name))
    d = with_distance(side(ref, "ref_words").join(side(hyp, "hyp_words"), key), "ref_words", "hyp_words")
    words = F.size("ref_words")
    return d.agg(F.round(100 * rate(F.col("errors"), words), 4).alias("percent"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"))


def variants(marks: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """The transformations of a breakdown: none, case, each character of marks, all of them."""
    drop = lambda chars: lambda c: F.translate(c, chars, "")
    return [("none", lambda c: c), ("case", F.lower), *((f"mark {m}", drop(m)) for m in marks), ("marks", drop(marks))]


def breakdown(pairs: DataFrame, transforms: list[tuple[str, Callable[[Column], Column]]], kind: str = "wer") -> DataFrame:
    """variant, errors, words, rate, improvement (percent against the first variant) of texts (ref, hyp) under each transformation."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), f(F.col("ref")).alias("r"), f(F.col("hyp")).alias("h")) for n, f in transforms]))
    d = pairs.select(each.alias("x")).select("x.variant", TOKENS[kind](F.col("x.r")).alias("ref_words"), TOKENS[kind](F.col("x.h")).alias("hyp_words"))
    rates = error_rate(d, ["variant"])
    base = rates.where(F.col("variant") == transforms[0][0]).select(F.col("rate").alias("_base"))
    return rates.join(F.broadcast(base)).withColumn("improvement", F.round(F.when(F.col("_base") != 0, (F.col("_base") - F.col("rate")) / F.col("_base") * 100).otherwise(F.lit(0.0)), 6)).drop("_base")


def mark_operations(pairs: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """utt, mark, hyp_mark, op: an operation on a punctuation mark per row, from the alignment of words and masked marks. A mark
    against a word counts as a deletion or an insertion. pairs: utt, ref, hyp. Texts of any length: a pair's memory is linear in it."""
    token = re.compile(TOKEN.format(re.escape("".join(marks))))

    def operations(utt: int, ref: str, hyp: str) -> Iterator[tuple]:
        r, h = token.findall(ref), token.findall(hyp)
        for op, i, j in edit_path(*numbered(*(["\0" if t in marks else t for t in x] for x in (r, h)))):
            x, y = r[i] if op != "I" else None, h[j] if op != "D" else None
            if op == "C" and x in marks:
                yield utt, x, y, "Correct" if x == y else "Substitutions"
            elif op in "SD" and x in marks:
                yield utt, x, None, "Deletions"
            if op in "SI" and y in marks:
                yield utt, y, None, "Insertions"

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = chain.from_iterable(operations(u, r or "", h or "") for u, r, h in zip(b["utt"], b["ref"], b["hyp"], strict=True))
            while part := list(islice(found, 50_000)):
                yield pd.DataFrame(part, columns=["utt", "mark", "hyp_mark", "op"])

    return pairs.select("utt", "ref", "hyp").mapInPandas(align, "utt long, mark string, hyp_mark string, op string")


def mark_rates(operations: DataFrame) -> DataFrame:
    """mark (null: all marks), n, and the rates of the four operations and of errors."""
    ops = ("Correct", "Deletions", "Insertions", "Substitutions")
    counts = operations.rollup("mark").agg(F.count("*").alias("n"), *[F.count_if(F.col("op") == o).alias(o) for o in ops])
    share = lambda o: F.when(F.col("n") > 0, F.col(o) / F.col("n")).otherwise(F.lit(0.0))
    return counts.select("mark", "n", *[F.round(share(o), 8).alias(o.lower()) for o in ops], F.round(F.when(F.col("n") > 0, 1 - F.col("Correct") / F.col("n")).otherwise(F.lit(0.0)), 8).alias("per"))


def punctuation_error_rate(operations: DataFrame) -> DataFrame:
    """n, errors, per: each utterance's errors are rounded to whole ones before the sum; the divisor is operations."""
    per = operations.groupBy("utt").agg(F.count("*").alias("n"), F.count_if(F.col("op") != "Correct").alias("wrong"))
    summed = per.agg(F.sum("n").alias("n"), F.sum(F.bround(F.col("wrong").cast("double"))).cast("long").alias("errors"))
    return summed.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce(F.col("errors") / F.col("n"), F.lit(0.0)).alias("per"))


def reports(pairs: DataFrame) -> DataFrame:
    """pairs with each row's own errors, words and rate, for a report per file."""
    d = with_distance(pairs, "ref_words", "hyp_words")
    n = F.size("ref_words")
    return d.withColumns({"words": n.cast("long"), "rate": F.round(F.when(n > 0, F.col("errors") / n).otherwise(F.lit(float("inf"))), 8)})
