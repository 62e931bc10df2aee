"""Corpus pipeline: the stages a text corpus passes, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes each stage's rows as Parquet under the shared folder and hands the re-read table on.

Defined results for odd rows: texts that are null, empty or fail the quality rules go in the first stage; of rows
that share a near-duplicate component one stays; columns beyond those of ``documents`` travel along unchanged; the last
stage replaces columns named n_tokens or token_ids. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import op2_pii, op3_minhash, op6_quality, op7_bpe, op10_mixing
from cartlens.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules."""
    return op6_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8."""
    return op3_minhash.one_of_each(docs, shingle=5, percent=80, rows=4, bands=30)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and the terms that disclose it replaced."""
    return op2_pii.sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice."""
    return op10_mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_tokens and token_ids."""
    return op7_bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: No stage's result can be stated in SQL as a whole: suffix arrays, confirmed near copies, merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
