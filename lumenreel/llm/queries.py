"""The queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm import (
    best_position, bpe, harmonic, nearest, oracles, packing, pii, prefix_trie, quality, secrets, shingle_join, token_files, toxicity, vector_links,
)
from lumenreel.llm.common import read, scratch_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(read(spark, sf_dir, "documents"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_links(read(spark, sf_dir, "embeddings"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), path)
    return token_files.document_digests(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), capacity=1024)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES = (
    op1_shingle_join, op2_private_data, op3_nearest, op4_vector_links, op5_token_files, op6_packing, op7_secrets, op8_quality, op9_bpe, op10_toxicity,
    op11_harmonic_packing, op12_prefix_trie, op13_ranked_search,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": oracles.PREFIX_TRIE, "op13_ranked_search": oracles.RANKED_SEARCH}
