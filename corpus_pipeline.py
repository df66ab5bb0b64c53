"""The corpus pipeline: five stages from raw documents to encoded ones, and ``publish`` to leave them as training files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import bpe_stream, decontam, pii, quality_crf, shingle_dedup, shuffle_shards, token_files
from scoreloom.llm.shared import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Words that ``encode`` remembers: its workers live on and keep them through the other stages.
WORDS = 60_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    field = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.accepted(docs, field)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more stays."""
    return shingle_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, their count, and digests of the ids and of what they decode to."""
    return bpe_stream.round_trip_digest(docs, WORD_BPE, keep_ids=True, words=WORDS).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]
#: No SQL can express the line field or the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs


def publish(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes what ``run`` returns, shuffled, as token-id files whose ids are the places in the shuffled order; returns the manifest."""
    table = bpe_stream.tokenizer_at(WORD_BPE).table
    placed = shuffle_shards.external_shuffle(encoded.select("doc_id", "ids"))
    return token_files.write_ids(placed, max(table.tokens) + 1, table.special["<|endoftext|>"], folder, placed.columns[-1])
