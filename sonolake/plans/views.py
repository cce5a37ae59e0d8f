"""Speech-corpus entities as views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.tables import spread, table


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fname, transcript, duration (s), num_samples, manifest (name), utt: an utterance per document."""
    duration = F.col("n_chars") / F.lit(15.0)
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".flac"))).alias("fname"),
        F.col("text").alias("transcript"),
        duration.alias("duration"),
        F.floor(duration * 16000).alias("num_samples"),
        F.col("source").alias("manifest"),
        F.col("doc_id").alias("utt"),
    )


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \n\t\r]+"), "")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, lang, source, ref_words, hyp_words: in the hypothesis every 7th word is replaced, every 10th dropped, every 13th doubled."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("utt"), "lang", "source", split_words(F.col("text")).alias("ref_words"))
    place = lambda i: i + 1
    heard = F.flatten(F.transform("ref_words", lambda x, i: F.when(place(i) % 10 == 0, F.array().cast("array<string>")).when(place(i) % 7 == 0, F.array(F.lit("zz"))).when(place(i) % 13 == 0, F.array(x, x)).otherwise(F.array(x))))
    return d.withColumn("hyp_words", heard)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, ref (user), hyp (the next turn, by the assistant)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"hyp": F.lead("text").over(w), "next": F.lead("role").over(w)})
    return c.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("ref"), "hyp")


def ref_ctm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, start, duration, word: words of all documents, 0.3 s apart."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("file"), F.posexplode(split_words(F.col("text"))).alias("seq", "word"))
    return d.select("file", "seq", (F.col("seq") * 0.3).alias("start"), F.lit(0.25).alias("duration"), "word")


def hyp_ctm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_ctm, each word late by 0.05 s and a hundredth for each unit of its MD5 bucket of 16."""
    late = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("file").cast("string"), F.col("seq").cast("string")).cast("binary")), 1, 1), 16, 10).cast("int")
    return ref_ctm(spark, sf_dir).withColumn("start", F.col("start") + 0.05 + late / 100.0)


def _kind() -> Column:
    return F.when(F.col("event_type").isin("view", "click"), "partial").when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "signup", "session_start").otherwise("session_end")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, ts (s), kind, text: the events of a user as a recogniser's session."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), _kind().alias("kind"), F.get_json_object("props", "$.k").alias("text"))


def hypotheses(events: DataFrame) -> DataFrame:
    """session, seq, event_time, kind, hyps of a table or stream of events: three readings of an event's number k, its digits as tokens."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    digits = lambda x: F.array_remove(F.split(x.cast("string"), ""), "")
    reading = lambda score, x: F.struct(F.lit(score).alias("score"), digits(x).alias("tokens"))
    hyps = F.array(reading(3.0, k), reading(2.0, k - k % 10 + F.col("event_id") % 10), reading(1.0, k * 7 % 100))
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), _kind().alias("kind"), hyps.alias("hyps"))


def spoken(events: DataFrame) -> DataFrame:
    """utt, seq, event_time, token of a table or stream of events: a token per event, its value in whole tens."""
    return events.select(F.col("user_id").alias("utt"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), (F.floor(F.col("value") / 10) % 6).cast("int").alias("token"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, frame, features: the vectors of a label are the frames of an utterance."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("utt"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("features"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrase, weight: the first two words of each benchmark item; an item_id's remainder by 5, plus 1."""
    w = F.split(F.lower("text"), "[^a-z]+")
    items = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("phrase"), (F.col("item_id") % 5 + 1).cast("double").alias("weight"))
    return items.groupBy("phrase").agg(F.max("weight").alias("weight"))
