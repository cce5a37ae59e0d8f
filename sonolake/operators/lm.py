"""Sub-word vocabularies, n-gram tables, their smoothing and scoring, keyword scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sonolake.tables import bucketed, written


def ngrams(words: DataFrame, n: int, column: str = "words") -> DataFrame:
    """gram (space-joined), c for every n-gram; counts combine before the shuffle. A task combines all its grams at once, and most are distinct: deal
    large texts out finely (spread with times), as grams that outgrow a task's memory are sorted and spilled."""
    # places are exploded, not the words: of a bare column Spark infers a filter on its size, which would split the texts a second time
    at = F.expr(f"if(size({column}) >= {n}, sequence(0, size({column}) - {n}), slice(array(0), 1, 0))")
    grams = words.select(column, F.explode(at).alias("_at")).select(F.concat_ws(" ", *[F.get(column, F.col("_at") + k) for k in range(n)]).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("c"))


#: Words of a batch that are combined at a time: what a worker holds besides the batch follows from them.
WORDS_AT_ONCE = 1 << 19


def parts_of_lists(lists: pa.ListArray, most: int = 0) -> Iterator[pa.ListArray]:
    """The lists in parts of up to most (WORDS_AT_ONCE) elements or of one list."""
    upto, lo = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)), 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (most or WORDS_AT_ONCE), "right")))
        yield lists.slice(lo, hi - lo)
        lo = hi


def reversed_grams(words: DataFrame, order: int, column: str = "words") -> DataFrame:
    """r1 to r<order>, c: each word of the texts with the words before it, nearest first (null before a text's start), and how often. Equal
    ones of a part of a batch are combined before the shuffle, the only one of single grams: r1 and r2 decide where they go."""
    names = [f"r{k + 1}" for k in range(order)]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in (part for b in batches for part in parts_of_lists(b.column(0))):
            coded = lists.flatten().dictionary_encode()
            ids, lens = np.asarray(coded.indices, np.int64), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
            back = [np.where(place >= k, np.concatenate((ids[:0], np.zeros(min(k, len(ids)), np.int64), ids[: max(0, len(ids) - k)])), -1) for k in range(order)]
            number = back[0] + 1
            for x in back[1:]:  # equal rows so far have equal numbers
                number = np.unique(number * (len(coded.dictionary) + 1) + x + 1, return_inverse=True)[1]
            _, first, count = np.unique(number, return_index=True, return_counts=True)
            cells = [pa.array(x[first], pa.int32(), mask=x[first] < 0) for x in back]
            yield pa.RecordBatch.from_arrays([*(coded.dictionary.take(x) for x in cells), pa.array(count, pa.int64())], [*names, "c"])

    rows = words.select(F.col(column).cast("array<string>")).mapInArrow(combine, ", ".join(f"{n} string" for n in names) + ", c long")
    return rows.repartition("r1", "r2").groupBy(*names).agg(F.sum("c").alias("c"))


def discounts(n: dict[int, int], fallback: tuple[float, float, float] = (0.5, 1.0, 1.5)) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many grams have the counts 1 to 4; the fallback where those do
    not allow any."""
    if not all(n.get(i) for i in (1, 2, 3, 4)):
        return fallback
    y = n[1] / (n[1] + 2 * n[2])
    found = tuple(i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3))
    return found if all(0 <= d <= i for i, d in enumerate(found, 1)) else fallback


def counted_grams(words: DataFrame, order: int, column: str = "words") -> DataFrame:
    """r1 to r<order>, c<n> and new<n> for n from 2: each distinct gram of the highest order or of a text's start, with the counts of its endings.

    The highest order has its counts; a lower order counts in how many different grams of the next order it comes last. With words read
    backwards those are runs of rows that share their first words, so all counts come from one order of rows. new<n> marks the first row
    of an ending, null where the text has no word so far back."""
    names = [f"r{k + 1}" for k in range(order)]
    d = reversed_grams(words, order, column).where("r2 is not null").withColumnRenamed("c", f"c{order}").withColumn(f"new{order}", F.col(names[-1]).isNotNull())
    for n in range(order - 1, 1, -1):
        run = Window.partitionBy(*names[:n])
        first = F.row_number().over(run.orderBy(*names[n:])) == 1
        d = d.withColumns({f"c{n}": F.count_if(f"new{n + 1}").over(run), f"new{n}": first & F.col(names[n - 1]).isNotNull()})
    return d


def kneser_ney(words: DataFrame, order: int = 4, column: str = "words") -> tuple[DataFrame, DataFrame]:
    """n, context, word, p and context, backoff of an interpolated Kneser-Ney model with three discounts per order, as tables.

    Single words (null context) are not discounted. A context's backoff is what its discounts saved. Rows of grams move twice: by their last two words
    for the counts, and by the two words before the last for the contexts, where a row has all the endings that its probability comes from. What pairs
    know is worked out on the pairs alone and joined where the grams lie.
    A group holds distinct grams only, so a passage repeated a million times weighs as one."""
    if order == 1:
        single = words.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
        one = single.join(F.broadcast(single.agg(F.sum("c").alias("all")))).select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("context"), "word", (F.col("c") / F.col("all")).alias("p"))
        return one, one.select("context", F.lit(1.0).alias("backoff")).limit(0)
    names = [f"r{k + 1}" for k in range(order)]
    grams = bucketed(counted_grams(words, order, column), "grams", ["r1", "r2"])
    seen: dict[int, dict[int, int]] = {n: {} for n in range(2, order + 1)}
    many = [F.count_if(F.col(f"new{n}") & (F.col(f"c{n}") == c)).alias(f"m{n}{c}") for n in seen for c in (1, 2, 3, 4)]
    found = grams.agg(*many).first()  # four numbers per order
    for n in seen:
        seen[n] = {c: found[f"m{n}{c}"] for c in (1, 2, 3, 4)}

    def off(n: int) -> Column:
        d1, d2, d3 = discounts(seen[n])
        c = F.col(f"c{n}")
        return F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)

    pairs = grams.where("new2").select("r1", "r2", "c2")
    last = pairs.groupBy("r1").agg(F.count("*").alias("c1"))
    one = last.join(F.broadcast(last.agg(F.sum("c1").alias("all")))).select("r1", (F.col("c1") / F.col("all")).alias("p1"))
    two = pairs.where("c2 > 0").groupBy("r2").agg(F.sum("c2").alias("t2"), (F.sum(off(2)) / F.sum("c2")).alias("b2"))
    two = written(two, "contexts")
    seconds = pairs.join(one, "r1").join(two, "r2", "left").select("r1", "r2", ((F.col("c2") - off(2)) / F.col("t2") + F.col("b2") * F.col("p1")).alias("p2"))
    d = grams.join(seconds, ["r1", "r2"]).withColumn("new2", F.col("new2") & (F.col("c2") > 0)).drop("c2")
    d = d.repartition("r2", "r3") if order > 2 else d
    for n in range(3, order + 1):
        context, use = Window.partitionBy(*names[1:n]), F.col(f"new{n}") & (F.col(f"c{n}") > 0)
        d = d.withColumns({f"t{n}": F.sum(F.when(use, F.col(f"c{n}"))).over(context), f"s{n}": F.sum(F.when(use, off(n))).over(context)}).withColumn(f"b{n}", F.col(f"s{n}") / F.col(f"t{n}"))
        d = d.withColumn(f"p{n}", (F.col(f"c{n}") - off(n)) / F.col(f"t{n}") + F.col(f"b{n}") * F.col(f"p{n - 1}"))
        d = d.withColumn(f"new{n}", use).drop(f"c{n}", f"t{n}", f"s{n}")
    only = lambda v, n: F.when(F.col(f"new{n}"), F.col(f"{v}{n}")).alias(f"{v}{n}")  # noqa: E731  no number is kept twice
    kept = written(d.select(*names, *[f"new{n}" for n in seen], *[only("p", n) for n in seen], *[only("b", n) for n in seen if n > 2]), "model")
    text = lambda n: F.concat_ws(" ", *reversed(names[1:n])).alias("context")
    model = one.select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("context"), F.col("r1").alias("word"), F.col("p1").alias("p"))
    for n in seen:
        model = model.unionByName(kept.where(f"new{n}").select(F.lit(n).alias("n"), text(n), F.col("r1").alias("word"), F.col(f"p{n}").alias("p")))
    backoff = reduce(DataFrame.unionByName, [two.select(F.col("r2").alias("context"), F.col("b2").alias("backoff")), *(kept.where(f"new{n}").groupBy(*names[1:n]).agg(F.first(f"b{n}").alias("backoff")).select(text(n), "backoff") for n in seen if n > 2)])
    return model, backoff


def lookup(model: DataFrame, backoff: DataFrame) -> DataFrame:
    """key, value: probabilities of grams (keys p and the words) and backoffs of contexts (keys b and the words) in one table."""
    p = model.select(F.concat_ws(" ", F.lit("p"), "context", "word").alias("key"), F.col("p").alias("value"))
    return p.unionByName(backoff.select(F.concat_ws(" ", F.lit("b"), "context").alias("key"), F.col("backoff").alias("value")))


def scored(words: DataFrame, model: DataFrame, backoff: DataFrame, key: str, order: int = 4, column: str = "words", floor: float = 1e-7) -> DataFrame:
    """key, n, log_prob (natural): each word after the longest context that the model has with it; each context that it gives up on the way
    costs its backoff (1 if it is unknown), a word that the model lacks the floor.

    Each distinct gram asks for itself, its endings and its contexts in one join with lookup(), and the answers come together again by
    the gram: a word costs no join per order."""
    context = lambda n: F.when(F.col("pos") >= n - 1, F.array_join(F.slice(F.col("_w"), F.col("pos") - (n - 2), n - 1), " "))
    contexts = F.array_compact(F.array(*[context(n) for n in range(2, order + 1)]))  # shortest first
    d = words.select(key, F.posexplode(column).alias("pos", "word"), F.col(column).alias("_w")).select(key, "word", contexts.alias("c"))
    times = d.groupBy(key, "word", "c").agg(F.count("*").alias("times"))
    grams = times.select("word", "c").distinct()
    ask = F.concat(F.array(F.concat_ws(" ", F.lit("p"), "word")), F.transform("c", lambda c: F.concat_ws(" ", F.lit("p"), c, "word")), F.transform("c", lambda c: F.concat_ws(" ", F.lit("b"), c)))
    found = grams.select("word", "c", F.posexplode(ask).alias("i", "key")).join(lookup(model, backoff), "key")
    answers = found.groupBy("word", "c").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("a"))
    value = lambda i: F.element_at("a", i)
    p = F.aggregate(
        F.sequence(F.lit(0), F.size("c")), F.lit(floor), lambda low, i: F.coalesce(value(i), F.when(i == 0, low).otherwise(low * F.coalesce(value(i + F.size("c")), F.lit(1.0))))
    )
    priced = grams.join(answers, ["word", "c"], "left").select("word", "c", F.coalesce(p, F.lit(floor)).alias("p"))
    return times.join(priced, ["word", "c"]).groupBy(key).agg(F.sum("times").alias("n"), F.round(F.sum(F.log("p") * F.col("times")), 6).alias("log_prob"))


def subwords(words: DataFrame, size: int, rounds: int = 3, longest: int = 8, column: str = "words", symbols: tuple[str, ...] = ()) -> DataFrame:
    """piece, score: a unigram vocabulary of size pieces, the characters of the corpus and user symbols (score 0) among them.

    Distinct words are counted once. Expectation runs over them with the current pieces (at most 8 * size, broadcast), a batch of words at a time,
    and gives each piece its expected count over all ways to split a word; maximisation is a sum per piece. After a round the pieces go whose loss the
    likelihood feels least: their count by what their own best other split would cost. Single characters stay."""
    distinct = written(words.select(F.explode(column).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c")), "words")
    seeds = distinct.where(f"length(w) > 1 and {longest} > 1").select("c", F.explode(F.expr(f"flatten(transform(sequence(1, length(w) - 1), i -> transform(sequence(2, least({longest}, length(w) - i + 1)), n -> substring(w, i, n))))")).alias("piece")).groupBy("piece").agg(F.sum("c").alias("c"))
    alphabet = distinct.select("c", F.explode(F.split("w", "")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.sum("c").alias("c")).limit(ALPHABET + 1)
    top = alphabet.unionByName(seeds.orderBy(F.desc(F.col("c") * F.length("piece")), "piece").limit(8 * size))
    now = {r["piece"]: float(r["c"]) for r in top.collect()}
    chars = {p for p in now if len(p) == 1}
    if len(chars) > ALPHABET:
        raise ValueError(f"over {ALPHABET} different characters")
    for step in range(rounds):
        total = sum(now.values())
        score = {p: math.log(c / total) for p, c in now.items() if c > 0}
        use = distinct.sparkSession.sparkContext.broadcast(score)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = PieceSums(use.value, longest)
            for b in batches:
                sums.add(b.column(0), np.asarray(b.column(1), np.float64))
            found = sums.found()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["piece", "c"])

        found = distinct.select("w", "c").mapInArrow(expect, "piece string, c double").groupBy("piece").agg(F.sum("c").alias("c"))
        counts = {r["piece"]: r["c"] for r in found.collect()}
        use.unpersist()
        keep = size if step == rounds - 1 else max(size, len(now) // 2)
        loss = {p: c * (score[p] - sum(score.get(x, -1e6) for x in best_split(p, Without(score, p), longest))) for p, c in counts.items() if len(p) > 1}
        stay = sorted(loss, key=lambda p: (-loss[p], p))[: max(0, keep - len(chars))]
        now = {p: max(counts.get(p, 0.0), 1e-3) for p in [*chars, *stay]}
    total = sum(now.values())
    rows = [(p, 0.0) for p in symbols] + sorted(((p, math.log(c / total)) for p, c in now.items()), key=lambda r: (-r[1], r[0]))
    return words.sparkSession.createDataFrame(rows, "piece string, score double")


#: Characters that a vocabulary may cover.
ALPHABET = 200_000


class Without(dict):
    """A table of scores that hides one piece."""

    def __init__(self, table: dict[str, float], piece: str) -> None:
        self.table, self.piece = table, piece

    def get(self, key: str, default: float = 0.0) -> float:
        return default if key == self.piece else self.table.get(key, default)


def expected_pieces(word: str, score: dict[str, float], longest: int) -> Iterator[tuple[str, float]]:
    """How often each piece is expected in a word, over all splits by their probability; a character without a piece counts as one of
    log probability -30."""
    n = len(word)
    edges = [[(i, score.get(word[j:i], -30.0 if i - j == 1 else None)) for i in range(j + 1, min(n, j + longest) + 1)] for j in range(n)]
    total = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs)) if xs else -math.inf
    back = [0.0] * (n + 1)  # the mass of what is left from a place on
    for j in range(n - 1, -1, -1):
        back[j] = total([s + back[i] for i, s in edges[j] if s is not None])
    ahead = [-math.inf] * (n + 1)
    ahead[0] = 0.0
    for j in range(n):
        for i, s in edges[j]:
            if s is not None:
                share = math.exp(ahead[j] + s + back[i] - back[0])
                yield word[j:i], share
                high, low = max(ahead[i], ahead[j] + s), min(ahead[i], ahead[j] + s)
                ahead[i] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class PieceSums:
    """Expected counts of pieces over words, as expected_pieces() gives them, for a batch of words at a time: pieces are the nodes of a trie,
    and all words take a step together, from the longest to the shortest."""

    def __init__(self, score: dict[str, float], longest: int) -> None:
        nodes, steps = {"": 0}, {}
        for piece in score:
            for i in range(1, min(len(piece), longest) + 1):
                if len(piece) <= longest and piece[:i] not in nodes:
                    nodes[piece[:i]] = len(nodes)
                    steps[nodes[piece[: i - 1]] << 32 | ord(piece[i - 1])] = nodes[piece[:i]]
        self.pieces, self.longest = list(nodes), longest
        self.score = np.array([score.get(p, -np.inf) if p else -np.inf for p in nodes])
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.sums, self.strange = np.zeros(len(nodes)), {}

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to; 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(node), np.int64)
        key = node << 32 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], 0)

    def add(self, words: pa.Array, times: np.ndarray, part: int = 4096) -> None:
        order = np.argsort(-np.asarray(pc.utf8_length(words)).astype(np.int64), kind="stable")
        for lo in range(0, len(order), part):
            self._add(words.take(pa.array(order[lo : lo + part])), times[order[lo : lo + part]])

    def _add(self, words: pa.Array, times: np.ndarray) -> None:
        size = np.asarray(pc.utf8_length(words)).astype(np.int64)  # falling
        char = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        n, ends = len(char), np.repeat(start + size, size)
        # piece[k], value[k]: of the piece of k + 1 characters from each place on
        piece, value = np.zeros((self.longest, n), np.int64), np.full((self.longest, n), -np.inf)
        open_, node = np.arange(n), np.zeros(n, np.int64)
        for k in range(self.longest):
            node = self.step(node, char[open_ + k])
            value[k, open_], piece[k, open_] = self.score[node], node
            if not k:
                value[0, ~np.isfinite(value[0])] = -30.0
            stay = (node > 0) & (open_ + k + 1 < ends[open_])
            open_, node = open_[stay], node[stay]
        # a word's places lie one further apart than its characters: it has an end as well
        room = np.repeat(np.arange(len(size)), size) + np.arange(n)
        first = start + np.arange(len(size))
        back, ahead = np.full(n + len(size) + self.longest, -np.inf), np.full(n + len(size) + self.longest, -np.inf)
        back[first + size] = ahead[first] = 0.0
        there = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")  # how many words have so many characters
        for r, m in enumerate(there.tolist(), 1):  # r characters before the end
            lengths = np.arange(min(r, self.longest))[:, None]
            back[first[:m] + size[:m] - r] = np.logaddexp.reduce(value[: len(lengths), start[:m] + size[:m] - r] + back[first[:m] + size[:m] - r + lengths + 1], axis=0)
        for i, m in enumerate(there.tolist(), 1):
            lengths = np.arange(min(i, self.longest))[:, None]
            ahead[first[:m] + i] = np.logaddexp.reduce(value[lengths, start[:m] + i - lengths - 1] + ahead[first[:m] + i - lengths - 1], axis=0)
        whole, weight = np.repeat(back[first], size), np.repeat(times, size)
        for k in range(self.longest):
            on = np.flatnonzero(np.isfinite(value[k]))
            share = weight[on] * np.exp(ahead[room[on]] + value[k, on] + back[room[on] + k + 1] - whole[on])
            self.sums += np.bincount(piece[k, on], share, len(self.sums))
            if not k and (odd := on[~np.isfinite(self.score[piece[0, on]])]).size:
                found, which = np.unique(char[odd], return_inverse=True)  # characters that are no pieces
                for c, x in zip(found.tolist(), np.bincount(which, share[np.searchsorted(on, odd)]).tolist(), strict=True):
                    self.strange[chr(c)] = self.strange.get(chr(c), 0.0) + x

    def found(self) -> dict[str, float]:
        on = np.flatnonzero(np.isfinite(self.score) & (self.sums > 0))
        return {self.pieces[i]: float(self.sums[i]) for i in on.tolist()} | self.strange


def best_split(word: str, score: dict[str, float], longest: int) -> list[str]:
    """The pieces of a word with the best total score; characters without a piece stand alone."""
    best, back = [0.0], [0]
    for i in range(1, len(word) + 1):
        options = [(best[j] + score.get(word[j:i], -1e6 if i - j == 1 else -math.inf), j) for j in range(max(0, i - longest), i)]
        s, j = max(options)
        best.append(s)
        back.append(j)
    out, i = [], len(word)
    while i:
        out.append(word[back[i] : i])
        i = back[i]
    return out[::-1]


def charset_coverage(texts: DataFrame, charset: str, column: str = "text") -> DataFrame:
    """char, n, covered for every character of the corpus."""
    chars = texts.select(F.explode(F.split(column, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    return chars.withColumn("covered", F.array_contains(F.array(*[F.lit(c) for c in charset]), F.col("char")))


def keyword_scores(texts: DataFrame, keywords: DataFrame, key: str, column: str = "text", most: int = 1_000_000) -> DataFrame:
    """key, score: for each keyword its weight times (its length by the overlapping places it has in the text, plus the lengths of its
    proper prefixes that the text ends with). The keywords (phrase, weight), a user's list of most at the utmost, become one automaton
    that passes over each text once. A null text has no score."""
    rows = keywords.where("phrase <> ''").groupBy("phrase").agg(F.sum("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} keywords")
    listed = texts.sparkSession.sparkContext.broadcast([(r.phrase, r.weight) for r in rows])
    kind = texts.select(key).schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, heads = ahocorasick.Automaton(), {}
        for phrase, weight in listed.value:
            found.add_word(phrase, weight * len(phrase))
            for i in range(1, len(phrase)):
                heads[phrase[:i]] = heads.get(phrase[:i], 0.0) + weight * i
        longest = max(map(len, heads), default=0)
        if len(found):
            found.make_automaton()
        for b in batches:
            scores = [None if x is None else (sum(w for _, w in found.iter(x)) if len(found) else 0.0) + sum(heads.get(x[-i:], 0.0) for i in range(1, min(longest, len(x)) + 1)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else round(v, 6) for v in scores], pa.float64())], names=[key, "score"])

    return texts.select(key, F.col(column).alias("_text")).mapInArrow(run, T.StructType([kind, T.StructField("score", T.DoubleType())]))


def merged_hypotheses(nbest: DataFrame) -> DataFrame:
    """utt, text, score: hypotheses with one text become one, their probabilities added (a log-sum-exp shifted by the maximum)."""
    top = nbest.groupBy("utt", "text").agg(F.max("score").alias("_m"))
    return nbest.join(top, ["utt", "text"]).groupBy("utt", "text", "_m").agg(F.sum(F.exp(F.col("score") - F.col("_m"))).alias("_s")).select("utt", "text", F.round(F.col("_m") + F.log("_s"), 6).alias("score"))


def first_hypotheses(nbest: DataFrame, order: list[Column], k: int) -> DataFrame:
    """nbest's first k rows of each utterance in a user's order, with their rank from 1."""
    return nbest.withColumn("rank", F.row_number().over(Window.partitionBy("utt").orderBy(*order))).where(F.col("rank") <= k)


def pruned(nbest: DataFrame, beam: float, k: int) -> DataFrame:
    """Hypotheses within beam of the best score per token, at most k by score, with their rank from 1."""
    per = F.col("score") / F.greatest(F.col("n_tokens"), F.lit(1))
    best = nbest.groupBy("utt").agg(F.max(per).alias("_b"))
    kept = nbest.join(best, "utt").where(per >= F.col("_b") - beam)
    listed = kept.groupBy("utt").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_neg"), "text", "n_tokens"))), 1, k).alias("_h"))
    return listed.select("utt", F.posexplode("_h").alias("rank", "h")).select("utt", (F.col("rank") + 1).alias("rank"), "h.text", (-F.col("h._neg")).alias("score"))


def keyword_rescored(nbest: DataFrame, keywords: DataFrame, weight: float = 1.0) -> DataFrame:
    """nbest (utt, text, score) with each hypothesis' keyword score added."""
    found = keyword_scores(nbest.select("text").distinct(), keywords, "text")
    return nbest.join(found.select("text", F.col("score").alias("_k")), "text").withColumn("score", F.round(F.col("score") + weight * F.col("_k"), 8)).drop("_k")


def running_scores(texts: DataFrame, keywords: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, pos, delta, total: a text's keyword score character by character. The score of a text so far is that of keyword_scores();
    delta is how much a character changes it. Prefixes are scored once each."""
    at = texts.select(key, F.explode(F.sequence(F.lit(0), F.char_length(column))).alias("pos"), F.col(column).alias("_t")).select(key, "pos", F.expr("left(_t, pos)").alias("head"))
    scores = keyword_scores(at.select("head").distinct(), keywords, "head", "head").select("head", F.col("score").alias("total"))
    w = Window.partitionBy(key).orderBy("pos")
    return at.join(scores, "head").select(key, "pos", F.round(F.col("total") - F.lag("total").over(w), 6).alias("delta"), "total").where("pos > 0")


def rescored(nbest: DataFrame, extra: DataFrame, weight: float) -> DataFrame:
    """nbest with score + weight * extra's score of the same (utt, text)."""
    e = extra.select("utt", "text", F.col("score").alias("_e"))
    return nbest.join(e, ["utt", "text"], "left").withColumn("score", F.round(F.col("score") + weight * F.coalesce("_e", F.lit(0.0)), 8)).drop("_e")


def forced_prefix(nbest: DataFrame, limit: float) -> DataFrame:
    """utt, n_kept, n_prefix, prefix: where an utterance has waited for a final for more than limit seconds, its worst hypotheses are dropped
    until those left begin alike; else all stay. nbest: utt, tokens, score, waited (s)."""
    best = nbest.groupBy("utt").agg(F.max_by("tokens", F.struct("score", "tokens")).alias("_best"))
    least = F.least(F.size("tokens"), F.size("_best"))
    alike = F.expr("array_min(filter(sequence(0, least(size(tokens), size(_best))), i -> i >= least(size(tokens), size(_best)) or not get(tokens, i) <=> get(_best, i)))")
    r = nbest.join(best, "utt").withColumn("_n", F.when(least == 0, 0).otherwise(alike))
    worse = Window.partitionBy("utt").orderBy(F.desc("score"), F.desc("tokens")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"_rank": F.row_number().over(worse), "_common": F.min("_n").over(worse)})
    all_ = Window.partitionBy("utt")
    kept = r.withColumn("_of", F.count("*").over(all_)).where((F.col("waited") > limit) & (F.col("_common") > 0) | (F.col("waited") <= limit) & (F.col("_rank") == F.col("_of")) | (F.col("_rank") == 1))
    last = kept.groupBy("utt").agg(F.max(F.struct("_rank", "_common", "_best")).alias("x"))
    return last.select("utt", F.col("x._rank").alias("n_kept"), F.col("x._common").alias("n_prefix"), F.slice("x._best", 1, F.col("x._common")).alias("prefix"))


def common_prefix(nbest: DataFrame) -> DataFrame:
    """utt, n_prefix, prefix: the tokens that all of an utterance's hypotheses (tokens) begin with: those of the least and the greatest."""
    ends = nbest.groupBy("utt").agg(F.min("tokens").alias("_a"), F.max("tokens").alias("_z"))
    differ = F.expr("filter(sequence(0, least(size(_a), size(_z))), i -> i >= least(size(_a), size(_z)) or not get(_a, i) <=> get(_z, i))")
    return ends.select("utt", F.array_min(differ).alias("n_prefix"), "_a").select("utt", "n_prefix", F.expr("slice(_a, 1, n_prefix)").alias("prefix"))
