"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MissingInput(FileNotFoundError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise MissingInput(path)
    return path


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(require(spark, path))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, optional: bool = True) -> DataFrame:
    """Rows of line-delimited JSON; blank lines are skipped, a malformed line fails.

    A missing file has no rows if it is optional.
    """
    if not exists(spark, path):
        if optional:
            return spark.createDataFrame([], schema)
        raise MissingInput(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_numbered_jsonl(spark: SparkSession, path: str, schema: StructType, limit: int | None = None, index: str = "benchmark_index") -> DataFrame:
    """Rows of one JSONL file with their place in it, from 0 (blank lines don't count); the first `limit` of them.

    Lines are numbered by the position of each file's row, so that no driver
    loop is needed; a benchmark has few lines, which one task orders.
    """
    lines = spark.read.text(require(spark, path)).select("value", F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
    rows = lines.select((F.row_number().over(Window.orderBy("_at")) - 1).alias(index), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_row"))
    if limit is not None:
        rows = rows.where(F.col(index) < limit)
    return rows.select(index, "_row.*")


def read_json_documents(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """One row for each JSON file of a pattern, with its path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    return rows.withColumn("report", F.col("_metadata.file_path"))


def union_of(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """All tables with the key of each in the column `name`."""
    if not tables:
        raise ValueError("at least one table has to be named")
    out = None
    for key, rows in tables.items():
        rows = rows.withColumn(name, F.lit(key))
        out = rows if out is None else out.unionByName(rows)
    return out
