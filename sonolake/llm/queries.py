"""Queries of the training-data operators, over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonolake.llm import bpe, fmindex, interactions, licenses, mixing, pieces, quality, secrets, sharding, simhash, spelling, suffixes, vectors
from sonolake.llm.common import table
from sonolake.llm.oracles import ORACLES


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classes(table(spark, sf_dir, "embeddings"))


def op5_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(table(spark, sf_dir, "documents"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_quality": op2_quality, "op3_secrets": op3_secrets, "op4_embeddings": op4_embeddings, "op5_fmindex": op5_fmindex, "op6_mixing": op6_mixing, "op7_suffixes": op7_suffixes, "op8_bpe": op8_bpe, "op9_licenses": op9_licenses, "op10_sharding": op10_sharding, "op11_spelling": op11_spelling, "op12_sentencepiece": op12_sentencepiece, "op13_interactions": op13_interactions}
ORACLE_SQL: dict[str, str] = dict(ORACLES)
