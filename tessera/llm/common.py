"""Helpers that the operators of this subpackage share.

Batches, chunks and buckets bound what a Python worker holds; nothing here
collects rows to the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch, and bytes where the Spark version has that bound.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Bytes of a group above which a worker gives memory back when it has done with it.
LARGE_GROUP = 1 << 20
SHUFFLE_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Buckets for each shuffle partition, so that hashing deals them evenly.
BUCKETS_PER_PARTITION = 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what crosses to Python at once, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets(spark: SparkSession, per_partition: int = BUCKETS_PER_PARTITION) -> int:
    """Buckets follow spark.sql.shuffle.partitions, which a cluster sizes by its input."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns what allocators of this process keep of freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow; whatever ends it, the worker gives back its free memory.

    Workers outlive tasks, and an executor may have more of them than cores;
    else each keeps the peak of the largest task that it ever had.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_groups(run: Callable) -> Callable:
    """The same for applyInArrow, after each large group: small ones keep little."""

    def tidied(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            if sum(t.nbytes for t in tables) >= LARGE_GROUP:
                give_back()

    # Spark takes functions of one more argument for those that ask for the key.
    return (lambda a: tidied(a)) if run.__code__.co_argcount == 1 else (lambda a, b: tidied(a, b))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named and the session is local, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = sc._conf.get("tessera.local.checkpoint", "") or tempfile.mkdtemp(prefix="tessera-")
        sc._conf.set("tessera.local.checkpoint", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends (Spark 4.1), not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_FILES_GO, None)
    spark.conf.set(SHUFFLE_FILES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_FILES_GO)
        else:
            spark.conf.set(SHUFFLE_FILES_GO, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them again."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    with shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize has written for df, which must not be read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[0].endswith(f"/tessera-{spark.sparkContext.applicationId}"):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has materialized; call it when its results are written elsewhere."""
    place = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns don't matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def blob_rows(bucket: np.ndarray, kind: int, records: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Packs records into one row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts]) if len(bucket) else []
    return [(int(bucket[a]), kind, records[a:b].tobytes()) for a, b in zip(starts, [*cuts, len(bucket)])]


BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
BLOB_DDL = "bucket int, kind int, data binary"


def blob_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], schema=BLOB_SCHEMA)


def joined(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=dtype)


def hash_bucket(values: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit hashes, by their high bits."""
    return ((values >> np.uint64(33)) % np.uint64(n)).astype(np.int32)
