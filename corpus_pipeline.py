"""The corpus pipeline: documents pass the stages one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet in the shared folder and read back as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralake.llm import decontam, language, minhash, pieces, secrets
from agoralake.llm.frames import checkpoint_dir
from agoralake.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose best mixture of the learned languages explains them hardly better than noise; mixtures stay, whatever their shares."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.filter_language(docs, model, least_share=0.0, least_plausibility=0.25)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles the one with the smallest id stays."""
    return minhash.deduplicate(docs, minhash.plan(words=5, above=80, of=100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of ten words of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents", n=10)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ids, the token ids of the text."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is kept under its own path in the shared folder."""
    where = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express the language, MinHash and subword stages; tests use brute force instead.
ORACLE_SQL: str | None = None
