"""The corpus pipeline: stages that each call one operator of ``rerunlab.llm``.

Toxic documents go, then exact copies, then near copies (one document of each group
stays), personal data is blanked out, and what is left is packed into sequences.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rerunlab.llm import exact_dedup, packing, pii, simhash, toxicity
from rerunlab.llm.common import Table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the smallest id stays.
    SimHash proposes, the shingles decide, and what its radius misses is searched exactly."""
    return simhash.drop_similar(docs)


def blank_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens with their sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("simhash", drop_near),
    ("pii", blank_pii),
    ("packing", pack),
]

#: Several stages (a classifier, fingerprints, a tokenizer) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
