"""Spelling variants of words: near words differ by one edit, found by Gram matrices of letter counts.

Words are counted from runs of Latin letters (see word_counts). The letter counts of two words that are one edit apart have a squared distance of 2
(a replaced letter) or 1 (a letter more), so blocks of words whose lengths are equal or adjacent are compared as NumPy products of their
letter-count matrices: |a - b|^2 = |a|^2 + |b|^2 - 2ab. Pairs at most 2 apart are verified letter by letter, which decides.

Length alone would make blocks whose pairs grow with the square of the vocabulary. Blocks are therefore divided without loss: one edit leaves the
first half (of the shorter word's length, rounded down) or the rest after it as it is, so each word goes to the block of its half and of its rest, once as
the shorter word and once as the longer one; two words that share both are compared in the block of the half only. Blocks of over PIECE
words are dealt out as pairs of pieces, so that no task holds a large one; every pair of pieces is compared.

A null text has no words; a null doc_id is written as nothing before the colon. Repeated rows count again. Of near words that occur equally often the one first in code-point
order is the form. Chains of forms end, as n grows by RATIO at each step, and are followed by doubling. Very long texts are counted in
stretches that end between runs; words may have any length. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import cut, lookahead

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One run in so many (by a hash of document and run) loses a letter.
DELETED = 199
PIECE = 2048
STRETCH = 1 << 20
#: Words that a task counts before it sends the counts on.
HELD = 500_000
#: A letter's column: a to z, then U+00C0 to U+00FF. All runs are Latin-1, so a byte is a code point.
_COLUMN = np.zeros(256, np.int64)
_COLUMN[ord("a") : ord("z") + 1] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, 90)
_LETTERS = 90
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")
_GAP = re.compile(rb"[^a-z\xC0-\xFF]")


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text as Latin-1 bytes, in stretches. bytes.lower() changes A to Z only; what is not Latin-1 ends a run as any other
    character does."""
    data = text.encode("latin-1", "replace").lower()
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + STRETCH) if at + STRETCH < len(data) else None
        to = gap.end() if gap else len(data)
        yield _RUN.findall(data, at, to)
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every distinct word of the runs of documents, one letter deleted where the hash of document and run says so."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = zlib.crc32(b"%d:" % i if i is not None else b":")
                for own in runs(text.as_py() or ""):
                    counts = Counter(own)
                    for w in list(counts):
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % DELETED == 0:
                            at, n = h % len(w), counts.pop(w)
                            held[w[:at] + w[at + 1 :]] += n
                    held.update(counts)
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "word string, n long").where(f"char_length(word) >= {MIN_LENGTH}").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}")


def one_edit(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For rows of letters (padded with zeros), whether b differs from a by one replaced letter, or, where longer, by one inserted letter."""
    same = a == b
    lead = np.cumprod(same, axis=1).sum(axis=1)  # letters before the first difference
    rest = (a[:, :-1] == b[:, 1:]) | (np.arange(a.shape[1] - 1) < lead[:, None])
    return np.where(longer, rest.all(axis=1), (~same).sum(axis=1) == 1)


def near_in_block(words: list[bytes], length: int, by_half: bool, piece: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of a block, as indices; the first of a pair has the block's length, the second that or one more."""
    size = np.array([len(w) for w in words])
    letters = np.zeros((len(words), length + 1), np.uint8)
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w, np.uint8)
    filled = letters > 0
    counts = np.bincount((np.nonzero(filled)[0] * _LETTERS + _COLUMN[letters[filled]]), minlength=len(words) * _LETTERS).reshape(-1, _LETTERS).astype(np.float32 if length < 2000 else np.float64)
    norm = (counts**2).sum(axis=1)
    short = np.flatnonzero(size == length)
    i, j = np.nonzero(norm[short][:, None] + norm - 2 * (counts[short] @ counts.T) <= 2)
    i = short[i]
    fit = ((size[j] > length) | (i < j)) & (~cross | (piece[i] != piece[j]))
    i, j = i[fit], j[fit]
    if len(i):
        half = length // 2
        fit = (letters[i, :half] == letters[j, :half]).all(axis=1) == by_half
        i, j = i[fit], j[fit]
        fit = one_edit(letters[i], letters[j], size[j] > length)
        i, j = i[fit], j[fit]
    return i, j


def near_words(words: DataFrame) -> DataFrame:
    """word, other, n (of other): every near word of every word."""
    n = F.char_length("word")
    ways = []
    for longer in (0, 1):
        length = n - longer
        half = F.expr(f"(char_length(word) - {longer}) div 2").cast("int")
        for by_half, part in ((True, F.substring(F.col("word"), F.lit(1), half)), (False, F.substring(F.col("word"), half + 1 + longer, n))):
            ways.append(F.struct(length.alias("length"), F.lit(by_half).alias("by_half"), F.xxhash64(part).alias("part")))
    key = ["length", "by_half", "part"]
    keyed = words.select("word", "n", F.explode(F.array(*ways)).alias("k")).select("word", "n", "k.*").where(f"length >= {MIN_LENGTH}")
    large = keyed.groupBy(*key).agg(F.count("*").alias("members"), F.sum((n == F.col("length")).cast("int")).alias("shorter")).where("members > 1 and shorter > 0")
    met = keyed.join(large.select(*key, F.ceil(F.col("members") / PIECE).cast("int").alias("pieces")), key)
    met = met.withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select(*key, F.least("piece", "with").alias("lo"), F.greatest("piece", "with").alias("hi"), "piece", "word", "n")
    cols = [*key, "lo", "hi"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for last, b in lookahead(batches):
            part = pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks().to_batches()
            if not part:
                continue
            part = part[0]
            cells = [np.asarray(part.column(c)) if c != "by_half" else part.column(c).to_numpy(zero_copy_only=False) for c in (*cols, "piece", "n")]
            new = np.zeros(part.num_rows, bool)
            new[0] = True
            for v in cells[:5]:
                new[1:] |= v[1:] != v[:-1]
            starts = np.append(np.flatnonzero(new), part.num_rows)
            done = len(starts) - 1 if last else len(starts) - 2
            length, by_half, _, lo, hi, piece, count = cells
            word = [w.encode("latin-1") for w in part.column("word").slice(0, int(starts[done])).to_pylist()]
            first, second = [], []
            for a, z in zip(starts[:done].tolist(), starts[1 : done + 1].tolist(), strict=True):
                if z - a > 1:
                    i, j = near_in_block(word[a:z], int(length[a]), bool(by_half[a]), piece[a:z], lo[a] != hi[a])
                    first.append(i + a)
                    second.append(j + a)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
            names = part.column("word")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.append(i, j))), names.take(pa.array(np.append(j, i))), pa.array(count[np.append(j, i)], pa.int64())], ["word", "other", "n"])
            rest = part.slice(int(starts[done]))

    return met.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(meet, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form (word, form): where following forms ends. Each round doubles the steps."""
    now = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return now
        now = new.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of documents."""
    words = cut(word_counts(docs), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("fits", F.coalesce(-F.col("best.n") >= RATIO * F.col("n"), F.lit(False)))
    named = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), F.col("best.form")).alias("form"), F.when(F.col("fits"), -F.col("best.n")).alias("form_n")), "named")
    root = roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
