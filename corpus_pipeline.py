"""Corpus pipeline: from documents to token ids. Each stage takes all documents that its predecessor kept, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, langid, mixing, secrets, simhash
from pagemill.llm.store import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without letters, and texts that no language explains."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets and access identifiers are replaced by their kind; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated, or left out, so that the sources' tokens meet their target weights."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with whether they decode to its text."""
    return bpe.encode(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("bpe_encode", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pagemill-stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
