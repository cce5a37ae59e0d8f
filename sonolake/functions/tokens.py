"""Words to sub-word ids and back, through a table of distinct words."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolake.operators.lm import best_split


def _numbered(vocabulary: DataFrame, max_pieces: int) -> Broadcast:
    """Scores and ids of pieces (from 1 in order of score), for tasks; more than max_pieces are an error."""
    rows = vocabulary.orderBy(F.desc("score"), "piece").limit(max_pieces + 1).collect()
    if len(rows) > max_pieces:
        raise ValueError(f"over {max_pieces} pieces")
    return vocabulary.sparkSession.sparkContext.broadcast(({r.piece: r.score for r in rows}, {r.piece: i for i, r in enumerate(rows, 1)}))


def word_ids(words: DataFrame, vocabulary: DataFrame, max_pieces: int = 200_000, longest: int = 32) -> DataFrame:
    """word, ids (from 1 in order of score; 0 is a character without a piece) for distinct words (word). The vocabulary is broadcast; more
    than max_pieces are an error."""
    table = _numbered(vocabulary, max_pieces)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, number = table.value
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [[number.get(p, 0) for p in best_split(w, score, longest)] for w in b["word"]]})

    return words.mapInPandas(split, "word string, ids array<int>")


def _joined(cells: DataFrame, key: str) -> DataFrame:
    """key, ids of rows key, cells (the ids of each word in order, null for a null word); rows of one key are put together by position."""
    spoken = F.filter("cells", lambda x: x.isNotNull())
    listed = cells.where(F.size(spoken) > 0).groupBy(key).agg(F.collect_list("cells").alias("r"))
    placed = F.flatten(F.transform("r", lambda cells: F.transform(cells, lambda x, i: F.struct(i.alias("pos"), x.alias("ids")))))
    in_order = F.transform(F.array_sort(placed), lambda x: x["ids"])
    one = F.when(F.size("r") == 1, F.get("r", F.lit(0))).otherwise(in_order)
    return listed.select(key, F.flatten(F.filter(one, lambda x: x.isNotNull())).alias("ids"))


def tokenised(texts: DataFrame, vocabulary: DataFrame, key: str, column: str = "words", max_pieces: int = 200_000, longest: int = 32) -> DataFrame:
    """key, ids of an array of words. A batch splits each of its distinct words once, and a task remembers SPLITS of them; no word is moved."""
    return sampled(texts, vocabulary, key, column, share=0.0, max_pieces=max_pieces, longest=longest)


#: Draws of a word before ids with an unknown token stay as they are (a fixed value).
DRAWS = 5
#: Words whose weights and whose best splits a task remembers.
REMEMBERED, SPLITS = 100_000, 200_000
#: Words of a batch that are split together.
WORDS_AT_ONCE = 1 << 18


def piece_weight(piece: str, score: dict[str, float], theta: float) -> float:
    """The logarithm of a piece's weight; a character without a piece is taken only where nothing else fits."""
    return theta * score[piece] if piece in score else -1e6 if len(piece) == 1 else -math.inf


def forward(word: str, score: dict[str, float], longest: int, theta: float) -> list[float]:
    """For each length of a prefix, the logarithm of the summed weights of its splits into pieces."""
    total = [0.0]
    for i in range(1, len(word) + 1):
        parts = [total[j] + piece_weight(word[j:i], score, theta) for j in range(max(0, i - longest), i)]
        top = max(parts)
        total.append(top + math.log(math.fsum(math.exp(x - top) for x in parts)))
    return total


def drawn_split(word: str, total: list[float], score: dict[str, float], longest: int, theta: float, chance: random.Random) -> list[str]:
    """A split drawn by its share of all splits' weights, from the last piece back to the first."""
    out, i = [], len(word)
    while i:
        left = chance.random()
        for j in range(i - 1, max(0, i - longest) - 1, -1):
            share = math.exp(total[j] + piece_weight(word[j:i], score, theta) - total[i])
            if share > 0:
                last, left = j, left - share  # rounding may leave a rest: the last split with a share takes it
                if left < 0:
                    break
        out.append(word[last:i])
        i = last
    return out[::-1]


def sampled(texts: DataFrame, vocabulary: DataFrame, key: str, column: str = "words", share: float = 1.0, theta: float = 0.1, seed: int = 1, max_pieces: int = 200_000, longest: int = 32) -> DataFrame:
    """key, ids of an array of words. A word is drawn with probability share from all its splits (a split's weight is e to the theta times
    its score), up to five times while the ids hold an unknown token (0); other words have their best split, which a batch takes once for each
    distinct word. Draws come from a hash of seed, key, position and word: a lost task draws the same again. Texts without words have no row, null words give nothing;
    rows of one key and equal words draw alike."""
    if not 0 <= share <= 1 or theta < 0:
        raise ValueError("share lies from 0 to 1, theta is not negative")
    draws = F.transform(column, lambda w, i: F.xxhash64(F.lit(seed), F.col(key), i, w)) if share else F.array().cast("array<bigint>")
    table = _numbered(vocabulary, max_pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, number = table.value
        reach = min(longest, max(map(len, score), default=1))  # no piece is longer
        weights = lru_cache(REMEMBERED)(lambda word: forward(word, score, reach, theta))
        best = lru_cache(SPLITS)(lambda word: [number.get(p, 0) for p in best_split(word, score, reach)])

        def drawn(word: str, start: int) -> list[int]:
            chance = random.Random(start)
            for _ in range(DRAWS):
                found = [number.get(p, 0) for p in drawn_split(word, weights(word), score, reach, theta, chance)]
                if 0 not in found:
                    break
            return found

        for whole in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(whole.column(1)), 0)).astype(np.int64)
            upto, lo = np.cumsum(sizes), 0
            while lo < whole.num_rows:  # parts of a batch, of WORDS_AT_ONCE or of one row
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WORDS_AT_ONCE, "right")))
                b, size = whole.slice(lo, hi - lo), sizes[lo:hi]
                coded = b.column(1).flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                ids = pa.array([best(w) for w in words], pa.list_(pa.int32()))
                place = coded.indices
                if share:
                    start = np.asarray(b.column(2).flatten())
                    chosen = np.flatnonzero(((start.view(np.uint64) >> np.uint64(11)) / float(1 << 53) < share) & np.asarray(pc.is_valid(place)))
                    at = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
                    own = pa.array([drawn(words[k], s) for k, s in zip(at[chosen].tolist(), start[chosen].tolist(), strict=True)], ids.type)
                    at[chosen] = len(ids) + np.arange(len(own))
                    ids, place = pa.concat_arrays([ids, own]), pa.array(at, mask=~np.asarray(pc.is_valid(place)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), ids.take(place))], [key, "cells"])
                lo = hi

    kind = T.StructType([texts.select(key).schema.fields[0], T.StructField("cells", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return _joined(texts.select(key, F.col(column).alias("_w"), draws.alias("_d")).mapInArrow(run, kind), key)


def known(tokens: DataFrame, handling: str = "warn") -> DataFrame:
    """tokens without rows that hold an unknown token (0); with handling "fail" such a row is an error."""
    if handling == "fail":
        return tokens.withColumn("ids", F.when(F.array_contains("ids", 0), F.raise_error(F.lit("an unknown token"))).otherwise(F.col("ids")))
    return tokens.where(~F.array_contains("ids", 0))


def decoded(tokens: DataFrame, vocabulary: DataFrame, key: str, between: str = "") -> DataFrame:
    """key, text: the pieces of ids (from 1 in order of score) in their order; unknown tokens (0) give nothing. The vocabulary's pieces are
    one row that every row looks into."""
    rows = vocabulary.agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "piece")).alias("r"))
    pieces = rows.select(F.transform(F.array_sort("r"), lambda x: x["piece"]).alias("pieces"))
    return tokens.withColumn("_p", pieces.scalar()).select(key, F.array_join(F.transform("ids", lambda i: F.when(i > 0, F.get("_p", i - 1))), between).alias("text"))


def piece_text(pieces: Column) -> Column:
    """The text of pieces with word marks; the unknown piece shows as two question marks."""
    return F.trim(F.replace(F.array_join(F.transform(pieces, lambda p: F.when(p == "<unk>", " ⁇ ").otherwise(p)), ""), F.lit("▁"), F.lit(" ")))


def user_token(tokens: dict[str, str], name: str) -> str:
    """A user's special token by name; an unknown name is an error that lists those there are."""
    if name not in tokens:
        raise ValueError(f"no user token {name!r}, there are {sorted(tokens)}")
    return tokens[name]


def check_user_tokens(vocabulary: DataFrame, tokens: dict[str, str]) -> None:
    """Raises an error if the vocabulary (piece) lacks a user token."""
    there = {r.piece for r in vocabulary.where(F.col("piece").isin(*tokens.values())).collect()} if tokens else set()
    if missing := sorted(set(tokens.values()) - there):
        raise ValueError(f"user tokens that are no pieces: {missing}")


def lm_lines(texts: DataFrame, vocabulary: DataFrame, key: str, rule: Callable[[Column], Column], user_tokens: dict[str, str] | None = None, column: str = "text") -> DataFrame:
    """key, line: each text without user tokens, by a rule, as its pieces between spaces; texts with a character that no piece has are
    left out, empty ones too. Each distinct word is split once."""
    text = F.col(column)
    for token in (user_tokens or {}).values():
        text = F.replace(text, F.lit(token), F.lit(""))
    words = F.array_remove(F.split(rule(text), r"\s+"), "")
    ids = known(tokenised(texts.select(key, words.alias("words")), vocabulary, key))
    return decoded(ids, vocabulary, key, " ").withColumnRenamed("text", "line")
