"""Eligible chunks of a corpus, and its fingerprint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..functions.text import normalize, strip

PAGE = ["doc_id", "document_version"]
SCAN_COLUMNS = [*PAGE, "category", "source_last_updated", "source_content_hash", "chunk_id", "position", "chunk_text", "heading_path", "source_title", "source_url"]


def active_chunks(documents: DataFrame, chunks: DataFrame, active: str = formats.ACTIVE) -> DataFrame:
    """Chunks of active documents of the same version; order them by SCAN_ORDER where order matters."""
    return chunks.join(documents.where(F.col("status") == active), PAGE).select(SCAN_COLUMNS)


def scan_order() -> list:
    return [F.col(c) for c in (*PAGE, "position", "chunk_id")]


def eligible_chunks(rows: DataFrame, min_chars: int = formats.LEAST_CHUNK_CHARS) -> DataFrame:
    """Stripped chunks of at least min_chars, the first of each normalised text in scan order.

    The length filter comes first, so a short duplicate never stands for a long
    one. The key of the window is a digest, so that the shuffle moves 32 bytes
    of it and not the text twice. Rows that are alike in scan order go by their
    text, so that each reading keeps the same.
    """
    rows = rows.withColumn("chunk_text", strip(F.coalesce("chunk_text", F.lit("")))).where((F.length("chunk_text") >= min_chars) & (F.col("chunk_text") != ""))
    first = Window.partitionBy("_digest").orderBy(*scan_order(), "chunk_text")
    rows = rows.withColumn("_digest", F.unhex(F.sha2(normalize(F.col("chunk_text")), 256)))
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_digest")


IDENTITY = [*PAGE, "chunk_id", "source_content_hash"]


def source_identity(rows: DataFrame) -> DataFrame:
    return rows.select(IDENTITY)


def source_manifest(rows: DataFrame) -> DataFrame:
    """One row: documents, chunks, and a digest over the identity of every row in scan order.

    Rows are digested on their own, then folded by page and over pages in order,
    so no list holds more than a page's rows or one digest for each page.
    """
    row = F.sha2(F.to_json(F.struct(IDENTITY), {"ignoreNullFields": "false"}), 256)
    ordered = lambda value, *order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("digest")))), lambda x: x["digest"]), ""), 256)
    pages = rows.groupBy(PAGE).agg(ordered(row, "position", "chunk_id").alias("digest"), F.count("*").alias("chunks"))
    # Pages are folded in 4096 ranges (three digits of a digest), then those in order.
    ranges = pages.groupBy(F.substring(F.sha2(F.concat_ws(":", *PAGE), 256), 1, 3).alias("range")).agg(ordered(F.col("digest"), *PAGE).alias("digest"), F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    return ranges.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("document_count"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"), ordered(F.col("digest"), "range").alias("manifest_sha256"))


def portable_digest(rows: DataFrame) -> str:
    """The digest that a JSON list of all identities has, keys sorted, as other tools compute it.

    One hash over all rows in order can't be split; rows stream through the
    driver one by one, so use it for corpora of that size, and source_manifest
    for others.
    """
    digest, joint = hashlib.sha256(b"["), b""
    for row in rows.select(*IDENTITY, "position").orderBy(*scan_order()).select(IDENTITY).toLocalIterator():
        digest.update(joint + json.dumps(row.asDict(), sort_keys=True).encode())
        joint = b", "
    digest.update(b"]")
    return digest.hexdigest()
