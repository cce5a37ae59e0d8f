"""License scans with a positional rare-token index (native).

TEMPLATES are whole licence texts and short notices. Their words are the vocabulary; its document frequency is counted over all
documents of the corpus. The index has postings (template, position) of the rare words: those in at most RARE_SHARE of the documents
(and RARE_DOCS more, so that small corpora have some).

A file looks up its words of highest inverse document frequency, TOP_WORDS of each template. A file word at place p and a posting at place q
vote for the alignment p - q; a template is a candidate if MIN_VOTES of its rare words (all, if it has fewer) agree on one alignment. The best alignment of a candidate is verified over the whole template: its coverage is the share of the template's words
that stand within SLACK words of their place. A template is reported if the coverage is MIN_COVERAGE or more and its mandatory key
phrase stands in the file. With exact=True common words are looked up too, all of a file's words vote, and every alignment with enough votes is
verified; the query keeps to the rare words, as its SQL does. The score is the best coverage of a template with its phrase, and 1 where a base phrase stands.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Nulls: a null text is empty, null ids are kept. Repeated
rows are judged alike, each counts for the document frequency. Empty tables give empty results; other columns are ignored. Texts
with fewer than MIN_VOTES words of the vocabulary and no base phrase leave the scan with their count of words only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.llm.common import cut
from sonolake.llm.licence_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
RARE_SHARE = 0.1
RARE_DOCS = 5
TOP_WORDS = 16
MIN_VOTES = 3
SLACK = 3
MIN_COVERAGE = 0.6


def template_words() -> list[list[str]]:
    return [re.findall(WORD, text.lower()) for *_, text in TEMPLATES]


def postings() -> list[tuple[str, int, int]]:
    """(word, template, position) of all words of the templates."""
    return [(w, t, q) for t, words in enumerate(template_words()) for q, w in enumerate(words)]


def file_words(text: Column) -> Column:
    """The lower-cased words. lower() makes ASCII letters of two characters outside ASCII only; texts with those go by A-Z alone."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(text.rlike("[İK]"), F.translate(text, upper, low)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _cells(line: Column, phrase: str) -> Column:
    """The parts of a space-led, space-ended line of words between the places of a phrase; the space before each place is gone."""
    return F.split(line, f" (?={phrase} )", -1)


def _spaces(x: Column) -> Column:
    return (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def base_places(line: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels (array) of a line of words."""
    cells = [(label, _cells(line, phrase)) for phrase, label in BASE]
    count = [F.size(c) - 1 for _, c in cells]
    first = [F.when(F.size(c) > 1, _spaces(F.get(c, F.lit(0)))) for _, c in cells]
    last = [F.when(F.size(c) > 1, _spaces(line) - _spaces(F.element_at(c, -1)) - 1) for _, c in cells]
    labels = F.filter(F.array(*[F.when(n > 0, F.lit(label)) for (label, _), n in zip(cells, count, strict=True)]), lambda x: x.isNotNull())
    return {"n_base": sum(count[1:], count[0]).cast("long"), "first_word": F.least(*first), "last_word": F.greatest(*last), "base_labels": labels}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, hits (distinct words of the vocabulary), line: line has the words of texts that may match, or is null."""
    vocabulary = F.array(*[F.lit(x) for x in sorted({w for w, *_ in postings()})])
    w = docs.select("doc_id", file_words(F.col("text")).alias("w"))
    d = w.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), F.array_intersect(vocabulary, "w").alias("hits"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"))
    may = F.size("hits") >= MIN_VOTES
    for phrase, _ in BASE:
        may |= F.contains("line", F.lit(f" {phrase} "))
    return d.withColumn("line", F.when(may, F.col("line")))


def rare_index(rows: DataFrame, exact: bool = False) -> DataFrame:
    """word, template, q, df, needed (votes) of the rare words, or if exact of all words, at most as many rows as the templates have words."""
    df = rows.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("n"))
    rare = df if exact else df.join(F.broadcast(total), F.col("df") <= RARE_SHARE * F.col("n") + RARE_DOCS).select("word", "df")
    post = rows.sparkSession.createDataFrame(postings(), "word string, template int, q int").join(F.broadcast(rare), "word")
    needed = post.groupBy("template").agg(F.least(F.lit(MIN_VOTES).cast("long"), F.countDistinct("word")).alias("needed"))
    return post.join(F.broadcast(needed), "template").select("word", "template", "q", "df", "needed")


def aligned(rows: DataFrame, index: DataFrame, exact: bool = False) -> DataFrame:
    """row, found (labels), score from rows (row, hits, line), line not null. If exact, a file looks up all of its words that the index has, and every
    alignment with enough votes is verified, not the one of most votes alone."""
    labels = F.array(*[F.lit(label) for label, *_ in TEMPLATES])
    phrases = F.array(*[F.lit(f" {phrase} ") for _, phrase, _ in TEMPLATES])
    texts = F.array(*[F.array(*[F.lit(w) for w in words]) for words in template_words()])
    # rows with fewer rare words than any template needs go no further, before a line is moved
    bound = index.agg(F.collect_set("word").alias("rare"), F.min("needed").alias("least"))
    rows = rows.withColumns({"rare": bound.select("rare").scalar(), "least": bound.select("least").scalar()}).where(F.size(F.array_intersect("hits", "rare")) >= F.col("least")).select("row", "hits", "line")
    # a template without its key phrase in the file is never reported, whatever its coverage: its votes are not counted
    may = F.filter(F.array(*[F.when(F.contains("line", F.lit(f" {phrase} ")), F.lit(t)) for t, (_, phrase, _) in enumerate(TEMPLATES)]), lambda x: x.isNotNull())
    rows = rows.withColumn("may", may).where(F.size("may") > 0)
    words = index.select("word", "template", "df").distinct()
    rarest = Window.partitionBy("row", "template").orderBy("df", "word")
    looked = rows.select("row", F.explode("hits").alias("word")).join(F.broadcast(words), "word")
    looked = looked if exact else looked.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= TOP_WORDS)
    looked = looked.groupBy("row").agg(F.collect_set("word").alias("looked"))
    lines = rows.join(looked, "row").select("row", "may", "looked", F.split(F.trim("line"), " ").alias("w"), "line")
    at = lines.select("row", "may", "looked", F.posexplode("w").alias("p", "word")).where(F.array_contains("looked", F.col("word"))).select("row", "may", "p", "word")
    votes = at.join(F.broadcast(index), "word").where(F.array_contains("may", F.col("template"))).groupBy("row", "template", (F.col("p") - F.col("q")).alias("shift")).agg(F.countDistinct("word").alias("votes"), F.first("needed").alias("needed"))
    enough = votes.where("votes >= needed").select("row", "template", F.struct("votes", (-F.col("shift")).alias("back")).alias("b"))
    best = enough if exact else enough.groupBy("row", "template").agg(F.max("b").alias("b"))
    best = best.groupBy("row").agg(F.collect_list(F.struct("template", (-F.col("b.back")).alias("shift"))).alias("cells"))
    near = f"aggregate(transform(get(texts, c.template), (x, q) -> int(array_contains(slice(w, greatest(c.shift + q + 1 - {SLACK}, 1), greatest(least(2 * {SLACK} + 1, c.shift + q + 1 + {SLACK}), 0)), x))), 0, (a, x) -> a + x)"
    judged = lines.join(best, "row").withColumns({"texts": texts, "labels": labels, "phrases": phrases})
    judged = judged.withColumn("cells", F.expr(f"transform(filter(cells, c -> contains(line, get(phrases, c.template))), c -> struct(get(labels, c.template) as label, {near} / double(size(get(texts, c.template))) as share))"))
    found = F.expr(f"array_sort(array_distinct(transform(filter(cells, c -> c.share >= {MIN_COVERAGE}), c -> c.label)))")
    return judged.select("row", found.alias("found"), F.expr("array_max(transform(cells, c -> c.share))").alias("score"))


def scan_licenses(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score of every row of docs. If exact, no word is left
    out for being common and no alignment for another with more votes: a template is found wherever MIN_VOTES of its words agree and it is covered."""
    rows = cut(scan(docs), "lines")  # written, so that row numbers stay and the scan runs once
    index = cut(rare_index(rows, exact), "licence-index")
    hits = rows.where("line is not null").select("row", "hits", "line")
    base = hits.select("row", *[c.alias(n) for n, c in base_places(F.col("line")).items()]).where("n_base > 0")
    found = base.join(aligned(hits, index, exact), "row", "full")
    none = F.array().cast("array<string>")
    own = F.array_sort(F.array_distinct(F.coalesce("base_labels", none)))
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("base_labels", none), F.coalesce("found", none))))
    n_base = F.coalesce("n_base", F.lit(0).cast("long"))
    score = F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    return rows.select("doc_id", "row", "n_words").join(found, "row", "left").select("doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word", own.alias("base_labels"), every.alias("labels"), score.alias("score"))


def digest(docs: DataFrame, exact: bool = False) -> DataFrame:
    return scan_licenses(docs, exact).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
