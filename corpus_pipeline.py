"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Every stage is one operator of ``longloom.llm``.  ``run`` writes the result of a stage as Parquet in
the shared checkpoint folder and rereads it as the next stage's documents; all stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longloom.llm import decontam, minhash_dedup, mixing, quality_rules, token_binary
from longloom.llm.common import cut_lineage, read

# the mix may read a source at most a quarter more often than the one it reads once, so every
# document that got here stays in the corpus
MAX_REPETITION = 1.25


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one stays."""
    return minhash_dedup.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them."""
    return mixing.mix(docs, max_repetition=MAX_REPETITION).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: one row for each document."""
    return token_binary.token_table(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token_ids", token_ids),
]

# byte-pair encoding has no SQL form: tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
