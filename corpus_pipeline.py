"""The corpus pipeline: documents in, packed training sequences out.

Stages run in order, each on all that the one before kept; results are written
as Parquet to the cluster's shared folder and read again, so a lost executor
never costs more than a stage. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup
from tessera.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.quality_rules(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Rows that share an id, or have none, go only if they are near copies."""
    return simhash_dedup.one_of_each(docs.select(*COLUMNS), similarity=(4, 5), shingle=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; characters that a cut leaves incomplete go too.

    A document of which nothing is left goes.
    """
    cut = suffix_dedup.suffix_dedup(docs, width=100, keep=COLUMNS[2:])
    text = F.when(F.size("spans") == 0, F.col("kept").cast("string")).otherwise(suffix_dedup.readable(F.col("kept")))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.where("text <> ''").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1, cache=100_000))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("SimHash near-dedup", near_dedup), ("suffix dedup", repeats), ("packing", pack)]

#: The learned scores and the tokenizer have no SQL counterpart; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
