"""The queries of this subpackage, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, html_extract, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts
from .common import read
from .oracles import ORACLES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), width=100))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=1))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"), limit=0.9)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality_classifier.classify(documents, quality_classifier.fit(documents, read(spark, sf_dir, "labels")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digests(simhash_dedup.simhash_dedup(read(spark, sf_dir, "documents"), limit=4, shingle=4))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode_decode(read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), width=20))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_suffix_dedup, op4_packing, op5_embedding_dedup, op6_quality_classifier, op7_simhash_dedup, op8_html_extract, op9_byte_bpe, op10_substring_dedup)}

__all__ = ["ORACLES", "QUERIES"]
