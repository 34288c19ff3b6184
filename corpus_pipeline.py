"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scans, packing.

Each stage works on all rows that the one before kept and returns the columns of documents; the last returns the pieces
of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import bpe, exact_dedup, near_dedup, packing, quality, secrets
from murmuration.llm.common import read_table, small_batches, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail a rule or that the boosted trees, fitted on labels, reject."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs, "largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id stays."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(staged(packing.cut(docs, bpe.default_path()), "pieces"))


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", no_copies),
    ("near-dedup", no_near_copies),
    ("secret scans", no_secrets),
    ("best-fit packing", packed),
]

#: Boosted trees, sketches and byte-pair encoding aren't expressible in SQL. Tests hold near-dedup against brute force and the
#: other stages' operators against small cases; none runs the whole pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
