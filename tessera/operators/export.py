"""Immutable exports: JSONL files with fingerprints, and what goes into them."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.files import exists
from .checks import valid_messages


#: Bytes that the driver moves at once when it joins a file's parts.
COPY_BYTES = 1 << 20


def revalidated(saved: DataFrame, current: DataFrame, context: str = "context", key: str = "context_id") -> DataFrame:
    """Adds `kept`: whether a saved context still reads as the current one of its id."""
    now = current.select(key, F.sha2(normalize(F.col(context)), 256).alias("_now"))
    same = F.sha2(normalize(F.coalesce(context, F.lit(""))), 256) == F.col("_now")
    return saved.join(now, key, "left").withColumn("kept", F.coalesce(same, F.lit(False))).drop("_now")


def training_rows(examples: DataFrame, kind: str, database: str) -> DataFrame:
    """Export rows of kept examples: id, kind, example, and provenance that names both."""
    identifier = F.concat_ws(":", F.lit(database), "question_id")
    provenance = F.col("payload.provenance").withField("training_example_id", identifier).withField("dataset_kind", F.lit(kind))
    return examples.select(identifier.alias("training_example_id"), F.lit(kind).alias("dataset_kind"), F.col("payload.example").alias("example"), provenance.alias("provenance"))


def prompt_completion(rows: DataFrame) -> DataFrame:
    """The first message as prompt, the second as completion, and nothing else."""
    return rows.where(valid_messages()).select(F.array(F.col("messages")[0]).alias("prompt"), F.array(F.col("messages")[1]).alias("completion"))


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side document, written once; an existing one is refused."""
    fs, place = _fs(spark, path)
    out = fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def refuse_existing(spark: SparkSession, directory: str, names: list[str]) -> None:
    if any(exists(spark, f"{directory}/{name}") for name in names):
        raise FileExistsError(f"an export already lies in {directory}")


def write_jsonl(rows: DataFrame, path: str, field: str | None = None, order: list[str] | None = None) -> None:
    """One JSON object a line, of one column or of the whole row, as a single file that must not exist.

    Tasks write parts of it, each its own rows, in order; the driver's JVM then
    streams the parts one after another into a file aside, with a fixed buffer,
    and renames it, so readers never see half of it.
    """
    spark = rows.sparkSession
    fs, place = _fs(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    rows = rows.orderBy(order) if order else rows
    value = F.col(field) if field else F.struct(*rows.columns)
    aside = f"{path}.{uuid.uuid4().hex}"
    rows.select(F.to_json(value).alias("value")).write.mode("errorifexists").option("compression", "none").text(aside)
    parts = [s.getPath() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(aside)) if s.getPath().getName().startswith("part-")]
    # part-00007-...: the number of its task; names of one task's files go by their ends.
    parts.sort(key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
    whole = parts[0] if len(parts) == 1 else spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/whole")
    if len(parts) != 1:
        out = fs.create(whole, False)
        try:
            for part in parts:
                source = fs.open(part)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES)
                finally:
                    source.close()
        finally:
            out.close()
    if not fs.rename(whole, place):
        raise FileExistsError(path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)


def file_metadata(spark: SparkSession, path: str) -> dict:
    """Path, lines that aren't blank, and SHA-256 of the bytes."""
    fs, place = _fs(spark, path)
    # Bytes of one file have one order: the driver's JVM streams them, and holds a buffer only.
    source = fs.open(place)
    try:
        digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(source)
    finally:
        source.close()
    return {"path": path, "rows": spark.read.text(path).where(F.trim("value") != "").count(), "sha256": digest}


def verify_files(spark: SparkSession, expected: dict[str, str]) -> None:
    """Raises if a file's digest isn't the one that a manifest has."""
    for path, digest in expected.items():
        if file_metadata(spark, path)["sha256"] != digest:
            raise ValueError(f"{path} differs from its manifest")


def dataset_manifest(spark: SparkSession, version: str, source_digest: str, sources: dict, sizes: dict[str, int], files: list[str]) -> dict:
    return {"dataset_version": version, "created_at": datetime.now(UTC).isoformat(), "source_manifest_sha256": source_digest, "training_sources": sources, **sizes} | {p.rsplit("/", 1)[-1]: file_metadata(spark, p) for p in files}
