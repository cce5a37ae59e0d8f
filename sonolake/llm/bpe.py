"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

Texts are split into pre-tokens. Rather than one row per pre-token of the corpus, a chunk of documents (CHUNK_BYTES of UTF-8 text, or one
longer document) is pre-aggregated: it keeps one row with each pre-token's place as the number of its word in the chunk, and sends
each of its distinct words once to the word's bucket. A bucket gets its words from all chunks, encodes each distinct word once,
and sends the ids back to the chunks that asked. There the documents are put together again by position.

Decoding joins the token-byte table (id, bytes), which has a row per token of the vocabulary: as one row of all of them, so that a
document's ids are looked up in place and no token is shuffled. Ids outside the table give no bytes.

The rank file's path is a parameter; special tokens are never produced. A null text is empty: no tokens, and digests of nothing.
Null ids and repeated rows are kept as they are; other columns are ignored by encode() and carried on by decode(); an empty table gives
an empty result. A chunk's rows are bounded by CHUNK_BYTES and the longest document, a bucket is streamed in batches and remembers
KNOWN_WORDS words at most (beyond, a word may be encoded again).
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_BYTES = 24_000_000
KNOWN_WORDS = 2_000_000
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """id, bytes: the token-byte table."""
    return spark.createDataFrame([(i, bytearray(token)) for token, i in ranks(path).items()], "id int, bytes binary")


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[offsets[i]:offsets[i + 1]] for each i of at, one after another."""
    lens = offsets[at + 1] - offsets[at]
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(offsets[at] - (ends - lens), lens) + np.arange(ends[-1])]


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(x, 5))


def _unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _chunk(name: str, ids: list, texts: list[str], buckets: int) -> list[tuple]:
    """The rows of a chunk. Words are numbered by falling frequency, so that most places are small numbers and pack well."""
    vocabulary: dict[str, int] = {}
    number = vocabulary.setdefault
    places = [np.array([number(w, len(vocabulary)) for w in _SPLIT.findall(x)], np.uint32) for x in texts]
    counts = np.array([len(x) for x in places], np.int64)
    flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    flat = rank[flat]
    planes = [(flat >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(max(1, (len(vocabulary).bit_length() + 7) // 8))]
    out = [(name, -1, _pack((ids, counts, planes)), None)]
    words = list(vocabulary)
    own = [words[i].encode() for i in order]
    bucket = np.array([zlib.crc32(w) % buckets for w in own], np.int64)
    by = np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        out.append((name, int(bucket[part[0]]), None, _pack((_narrow(part), [own[i] for i in part]))))
    return out


def chunk_table(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, bucket, docs, words: a row per chunk with its documents (bucket -1), and a row per chunk and bucket with words of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, held, n = TaskContext.get().partitionId(), [], [], 0, 0
        schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("docs", pa.binary()), ("words", pa.binary())])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_chunk(f"{part}-{n}", ids, texts, buckets), strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for i, x, size in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                texts.append(x)
                held += size
                if held >= chunk_bytes:
                    yield flush()
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield flush()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("size")).mapInArrow(scan, "chunk string, bucket int, docs binary, words binary")


def encode_words(chunks: DataFrame, path: str) -> DataFrame:
    """chunk, ids: for each row of words, the ids of its words in their order. Each distinct word is encoded once in its bucket."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        bucket, known = None, {}
        for b in batches:
            packed = []
            for own, words in zip(b["bucket"], b["words"], strict=True):
                if own != bucket or len(known) > KNOWN_WORDS:
                    bucket, known = own, {}
                number, listed = _unpack(words)
                ids = []
                for w in listed:
                    if (x := known.get(w)) is None:
                        x = known[w] = enc.encode_ordinary(w.decode())
                    ids.append(x)
                lens = np.array([len(x) for x in ids], np.int64)
                packed.append(_pack((number, _narrow(lens), _narrow(np.array([i for x in ids for i in x], np.uint32)))))
            yield pd.DataFrame({"chunk": b["chunk"], "ids": packed})

    rows = chunks.where("bucket >= 0").select("chunk", "bucket", "words")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(encode, "chunk string, ids binary")


def encode(docs: DataFrame, path: str, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array), ids_sha256 (of the ids as little-endian unsigned 32-bit integers) of every row."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    # bucketed by chunk: the documents stay where they are when their words' ids come back
    chunk_table(docs, buckets, chunk_bytes).write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name)
    chunks = spark.table(name)
    words = encode_words(chunks, path).groupBy("chunk").agg(F.collect_list("ids").alias("ids"))
    joined = chunks.where("bucket = -1").select("chunk", "docs").join(words, "chunk", "left").select("docs", "ids")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, parts in zip(b.column(0), b.column(1), strict=True):
                ids, counts, planes = _unpack(doc.as_py())
                places = sum((np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes)), np.zeros(len(planes[0]), np.uint32))
                found = [_unpack(p.as_py()) for p in parts.values] if parts.is_valid else []
                number = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint32)
                lens = np.concatenate([x[1] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
                flat = np.concatenate([x[2].astype(np.uint32) for x in found]) if found else np.zeros(0, np.uint32)
                at = np.argsort(number)
                starts = np.concatenate(([0], np.cumsum(lens)))
                own = gather(flat, starts, at)
                offsets = np.concatenate(([0], np.cumsum(lens[at])))
                end = np.concatenate(([0], np.cumsum(counts)))
                for lo in range(0, len(ids), 64):
                    rows = [gather(own, offsets, places[end[i] : end[i + 1]].astype(np.int64)) for i in range(lo, min(lo + 64, len(ids)))]
                    sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]
                    cells = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rows]))), pa.int32()), pa.array(np.concatenate(rows).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 64], pa.int64()), cells, pa.array(sha, pa.string())], ["doc_id", "ids", "ids_sha256"])

    return joined.mapInArrow(restore, "doc_id long, ids array<int>, ids_sha256 string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (ids: array<int>, other columns) with bytes, by a join with the token-byte table; null ids give null bytes."""
    listed = F.array_sort(F.collect_list(F.struct("id", F.hex("bytes").alias("hex"))))
    # an array by id; a subquery of one row, bounded by the vocabulary, is this join's other side
    table = token_table(tokens.sparkSession, path).agg(listed.alias("t")).select(F.expr("transform(sequence(0, element_at(t, -1).id), i -> if(t[i].id = i, t[i].hex, element_at(filter(t, x -> x.id = i), 1).hex))").alias("t"))
    joined = tokens.select(F.struct(*[F.col(f"`{c}`") for c in tokens.columns]).alias("row"), F.col("ids"), table.scalar().alias("t"))
    return joined.select("row", F.unhex(F.array_join(F.transform("ids", lambda i: F.get("t", i)), "")).alias("bytes")).select("row.*", "bytes")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(RANKS)
    return decode(encode(docs, path), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
