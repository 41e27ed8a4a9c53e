"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, secrets are masked, and the rest becomes tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Nulls: a null text is an empty one to the
classifier, has no words for the two middle stages and no tokens at the end, so such rows are kept throughout; rows without a doc_id
are kept as well.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import bpe, chosen_path, secret_scan, suffixes, toxicity
from pairwright.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids`` (little-endian unsigned 32-bit) and ``decoded``, the text read back from the ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, keep=("doc_id", "source", "lang"), decoded="decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe_encoding", encode_tokens),
]

#: The classifier is learned and the join is verified exactly; SQL cannot express the run, so tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
