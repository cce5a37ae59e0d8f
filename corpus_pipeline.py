"""Documents to token ids in five stages, each a whole-table job of one training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Rejected documents go,
lines above their host's limit leave the text, one document of each near-duplicate class stays, secrets are replaced by a mark,
sources are mixed to target weights (a document may come more than once), and the texts are encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonolake.llm import bpe, mixing, neardup, quality, secrets
from sonolake.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe", byte_level_bpe),
]
#: SimHash classes and BPE have no SQL form: tests/llm/test_pipeline.py compares each stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
