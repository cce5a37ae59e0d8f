"""Sources: manifests, transcripts, timing files, session logs, archives, audio headers, vocabularies."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.sources import archives

MANIFEST = """transcript string,
    files array<struct<fname: string, channels: int, sample_rate: double, bitdepth: int, bitrate: double, duration: double,
        num_samples: bigint, encoding: string, silent: boolean, speed: double>>,
    original_duration double, original_num_samples bigint"""
ALTERNATIVES = "struct<start: double, end: double, is_provisional: boolean, alternatives: array<struct<transcript: string, confidence: double>>>"


def manifests(spark: SparkSession, paths: str | list[str], root: str = "", only: Column | None = None) -> DataFrame:
    """Utterances of JSON manifests (whole-file arrays), with manifest (path), fname (of the last file, under root unless absolute), duration;
    those that a user's predicate holds for."""
    d = spark.read.schema(MANIFEST).option("multiLine", True).json(paths).withColumn("manifest", F.input_file_name())
    fname = F.element_at("files", -1)["fname"]
    d = d.where(only) if only is not None else d
    return d.withColumns({"fname": F.when(fname.startswith("/") | F.lit(not root), fname).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), fname)), "duration": F.col("original_duration")})


def transcript_files(spark: SparkSession, path: str, glob: str = "*.trans.txt") -> DataFrame:
    """utt, transcript of files with a line per utterance: an id, white space, the text."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).where("trim(value) <> ''")
    cells = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(F.get(cells, F.lit(0)).alias("utt"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("transcript"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def directory_pairs(spark: SparkSession, audio: str, text: str, audio_glob: str = "*.wav", text_glob: str = "*.txt") -> DataFrame:
    """stem, audio, text_path, transcript, side: files of two folders matched by stem; side names the one that is missing, or is null."""
    a = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", audio_glob).load(audio).select(stem(F.col("path")).alias("stem"), F.col("path").alias("audio"))
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", text_glob).load(text).select(stem(F.col("path")).alias("stem"), F.col("path").alias("text_path"), F.decode("content", "UTF-8").alias("transcript"))
    side = F.when(F.col("audio").isNull(), "audio").when(F.col("text_path").isNull(), "text")
    return a.join(t, "stem", "full_outer").withColumn("side", side)


def archive_members(spark: SparkSession, path: str, only: tuple[str, ...] = (), opener: archives.Opener = archives.open_path) -> DataFrame:
    """shard, pos, key, ext, content of the members of tar and zip shards of any size; a stem's periods become underscores; content of
    members outside only (extensions, if any are given) is left out, and its bytes are not read. archives.listing() and contents() have
    the parts of this, with filters between them."""
    wanted = F.col("ext").isin(*only) if only else None
    return archives.contents(archives.listing(spark, path, opener=opener), wanted, opener=opener).select("shard", "pos", "key", "ext", "content")


def archive_names(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("wav", "flac"), opener: archives.Opener = archives.open_path) -> DataFrame:
    """shard, pos, name of the members with these extensions, in the order of each shard (pos counts them alone); only headers are read."""
    return archives.listing(spark, path, extensions, opener).select("shard", "pos", "name")


def samples(members: DataFrame, audio: tuple[str, ...] = ("wav", "flac")) -> DataFrame:
    """shard, key, transcript, audio of archive members; complete is whether both sides are there, known whether all extensions are."""
    text = F.max(F.when(F.col("ext") == "txt", F.decode("content", "UTF-8")))
    sound = F.max(F.when(F.col("ext").isin(*audio), F.col("content")))
    there = F.bool_or(F.col("ext") == "txt") & F.bool_or(F.col("ext").isin(*audio))
    return members.groupBy("shard", "key").agg(text.alias("transcript"), sound.alias("audio"), there.alias("complete"), F.bool_and(F.col("ext").isin("txt", *audio)).alias("known"))


def known_samples(found: DataFrame) -> DataFrame:
    """samples() of shards whose members all have known extensions; any other member is an error."""
    checked = F.when(F.col("known"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("a member of an unknown kind: "), F.col("key"))))
    return found.withColumn("key", checked)


def rejected_samples(found: DataFrame) -> DataFrame:
    """shard, key, reason of the samples that known_samples() or a pairing would stop at."""
    reason = F.when(~F.col("known"), "unknown kind").when(~F.col("complete"), "one side missing")
    return found.withColumn("reason", reason).where("reason is not null").select("shard", "key", "reason")


def model_file(spark: SparkSession, folder: str) -> str:
    """The path of a folder's n-gram model: the binary one before the text form; none is an error."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{binary,arpa}").load(folder).select("path")
    found = d.orderBy(F.desc(F.col("path").endswith(".binary")), "path").first()
    if found is None:
        raise FileNotFoundError(f"no n-gram model in {folder}")
    return found.path


def wav_header(f: BinaryIO) -> tuple[int, int, int, int] | None:
    """channels, rate, bits, samples of a RIFF file, or None; chunks before the samples are stepped over."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    form = None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"data" and form:
            _, channels, rate, _, align, bits = form
            return channels, rate, bits, size // align
        after = f.tell() + size + size % 2
        if name == b"fmt " and len(block := f.read(16)) == 16:
            form = struct.unpack("<HHIIHH", block)
        f.seek(after)
    return None


def flac_header(f: BinaryIO) -> tuple[int, int, int, int] | None:
    """channels, rate, bits, samples of a FLAC file, from the stream information that its first block holds, or None."""
    raw = f.read(26)
    if raw[:4] != b"fLaC" or len(raw) < 26 or raw[4] & 127:
        return None
    packed = int.from_bytes(raw[18:26], "big")  # 20 bits rate, 3 channels - 1, 5 bits - 1, 36 samples
    return (packed >> 41 & 7) + 1, packed >> 44, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1


def audio_metadata(spark: SparkSession, path: str, glob: str = "*.{wav,flac}", opener: archives.Opener = archives.open_path) -> DataFrame:
    """fname, channels, sample_rate, bitdepth, num_samples, duration of WAV and FLAC files; null where there is no header. Only headers
    are read, whatever the size of a file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for name in b["path"]:
                with opener(name) as f:
                    got = wav_header(f)
                    if got is None:
                        f.seek(0)
                        got = flac_header(f)
                    found.append(got or (None,) * 4)
            d = pd.DataFrame(found, columns=["channels", "sample_rate", "bitdepth", "num_samples"]).astype("Int64")
            d.insert(0, "fname", b["path"].to_numpy())
            yield d

    d = archives.files(spark, path, glob).mapInPandas(read, "fname string, channels long, sample_rate long, bitdepth long, num_samples long")
    return d.withColumn("duration", F.col("num_samples") / F.col("sample_rate"))


def hub_manifest(df: DataFrame, text: str, dataset: str, leaf: int, branch: int, chunk: int, order: list[str]) -> DataFrame:
    """idx, fname, transcript, chunk of a columnar dataset; a missing text column is an error."""
    from sonolake.tables import indexed

    if text not in df.columns:
        raise ValueError(f"no column {text}; there are {df.columns}")
    d = indexed(df, order).withColumnRenamed(text, "transcript")
    fname = F.concat_ws("/", F.lit(dataset), F.expr(f"cast(idx div {leaf * branch} as string)"), F.expr(f"cast((idx div {leaf}) % {branch} as string)"), F.concat(F.col("idx").cast("string"), F.lit(".flac")))
    return d.withColumns({"fname": fname, "chunk": F.expr(f"idx div {chunk}")})


def ctm(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """file, channel, start, duration, word, confidence, error of timing files. Strict lines have six fields between single spaces,
    lenient ones five or more between any white space; lines that do not fit carry an error and no values."""
    cells = F.split("value", " ") if strict else F.split(F.trim("value"), r"\s+")
    fits = F.size(cells) == 6 if strict else F.size(cells) >= 5
    d = spark.read.text(paths).where("value <> ''").select("value", cells.alias("c"), fits.alias("fits"))
    cell = lambda i, kind: F.when(F.col("fits"), F.get("c", F.lit(i)).try_cast(kind))
    d = d.select("value", "fits", *[cell(i, k).alias(n) for i, (n, k) in enumerate((("file", "string"), ("channel", "int"), ("start", "double"), ("duration", "double"), ("word", "string"), ("confidence", "double")))])
    bad = ~F.col("fits") | F.col("start").isNull() | F.col("duration").isNull()
    return d.withColumn("error", F.when(bad, F.col("value"))).drop("value", "fits")


def session_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, kind, ts, seconds since the session's start, text of session logs: kind;time;payload;tail. The payload is a list of objects
    with a text, or of texts; its first counts."""
    cells = F.split("value", ";")
    d = spark.read.text(paths).where("value <> ''").select(F.input_file_name().alias("file"), F.get(cells, F.lit(0)).alias("kind"), F.try_to_timestamp(F.get(cells, F.lit(1)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"), F.get(cells, F.lit(2)).alias("payload"))
    start = d.where("kind = 'session_start'").groupBy("file").agg(F.min("ts").alias("_t0"))
    text = F.coalesce(F.get(F.from_json("payload", "array<struct<text: string>>"), F.lit(0))["text"], F.get(F.from_json("payload", "array<string>"), F.lit(0)))
    return d.join(start, "file", "left").select("file", "kind", "ts", ((F.unix_micros("ts") - F.unix_micros("_t0")) / 1e6).alias("seconds"), text.alias("text"))


def server_responses(messages: DataFrame, column: str = "value") -> DataFrame:
    """messages with text, ts, kind of a server's JSON; empty transcripts are left out."""
    r = F.from_json(column, ALTERNATIVES)
    d = messages.withColumn("_r", r).withColumns({"text": F.get("_r.alternatives", F.lit(0))["transcript"], "ts": F.col("_r.end"), "kind": F.when(F.col("_r.is_provisional"), "partial").otherwise("final")})
    return d.where("text <> ''").drop("_r")


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """phrase, weight of a JSON object of phrases; weights that are no numbers are an error; spaces become word marks."""
    d = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, string>")).alias("phrase", "raw")).withColumn("weight", F.col("raw").try_cast("double"))
    checked = F.when(F.col("weight").isNull(), F.raise_error(F.lit("a keyword's weight must be a number"))).otherwise(F.col("weight"))
    return d.select(F.replace("phrase", F.lit(" "), F.lit("▁")).alias("phrase"), checked.alias("weight"))


def mix_table(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """name, manifest, weight of a mix: weights default to 1 and may not be negative, unknown keys are left out."""
    rows = [(name, str(x["manifest"]), float(x.get("weight", 1.0))) for name, x in config.items()]
    if any(w < 0 for *_, w in rows):
        raise ValueError("weights may not be negative")
    return spark.createDataFrame(rows, "name string, manifest string, weight double")


def mix_file(spark: SparkSession, path: str) -> DataFrame:
    """mix_table() of a configuration file under the key datasets: JSON, or YAML where a parser for it is installed."""
    raw = spark.read.option("wholetext", True).text(path).first().value
    try:
        config = json.loads(raw)
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError as error:
            raise ValueError(f"{path} is no JSON, and no YAML parser is installed") from error
        config = yaml.safe_load(raw)
    return mix_table(spark, config["datasets"])


def shifted(ts: Column, seconds: Column) -> Column:
    """A time some seconds (to the microsecond) later."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("long"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("piece string, score double").option("sep", "\t").option("quote", "").csv(path)


def checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """name, md5, ok of the files of a folder against expected (name, md5)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", r"^.*/", "").alias("name"), F.md5("content").alias("found"))
    return expected.join(found, "name", "left").select("name", "md5", F.coalesce(F.col("md5") == F.col("found"), F.lit(False)).alias("ok"))


def reference_timings(manifest_paths: DataFrame, timing_paths: DataFrame) -> DataFrame:
    """path, ctm of manifests: the timing file with the manifest's stem, or null."""
    return manifest_paths.withColumn("_c", F.regexp_replace("path", r"\.json$", ".ctm")).join(timing_paths.select(F.col("path").alias("ctm")), F.col("_c") == F.col("ctm"), "left").drop("_c")
