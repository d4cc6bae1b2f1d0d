"""From raw documents to packed training sequences, stage by stage.

Each stage gets the documents that the one before it kept, as written to the shared folder, and works on all of
them. The first four return the columns of documents; the last returns the pieces and their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm import packing, quality, secrets, shingle_join, toxicity
from lumenreel.llm.common import read, stored
from lumenreel.llm.queries import WORD_VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 8) rejects go."""
    return quality.kept_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 10) rejects go."""
    return toxicity.clean_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (operator 1) the document with the smallest id stays; those without id stay too."""
    return shingle_join.one_of_each(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found (operator 7) are masked."""
    return secrets.masked_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens (operator 6)."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("shingle_jaccard_join", no_copies),
    ("secret_scans", no_secrets),
    ("best_fit_packing", packed),
]
#: The classifiers can't be said in SQL. tests/llm compare the join with brute force; the whole run has no independent version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
