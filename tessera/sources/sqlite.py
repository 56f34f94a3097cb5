"""A read-only data source for tables of SQLite files.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("tessera_sqlite").option("path", file).option("table", name).schema(s).load()

Ranges of rowid are read in parallel; the file has to be where executors can
open it. Equality and range filters and the columns asked for go to SQLite.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.corpus import active_chunks

OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.n = int(options.get("partitions", "4"))
        self.schema, self.filters = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.filters.append((f.attribute[0], OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(f"{quoted(c)} {op} ?" for c, op, _ in self.filters)])
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        with opened(self.path) as db:
            yield from db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE {where}", (partition.first, partition.last, *(v for *_, v in self.filters)))


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def schema(self) -> str:
        raise ValueError("name the schema of the table")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SQLiteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType, partitions: int = 4) -> DataFrame:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(SQLiteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tessera_sqlite").option("path", path).option("table", table).option("partitions", partitions).schema(schema).load()


def load_corpus(spark: SparkSession, path: str, documents: str, chunks: str) -> DataFrame:
    """Active chunks of a corpus file."""
    from .. import schemas

    return active_chunks(read_sqlite(spark, path, documents, schemas.DOCUMENTS), read_sqlite(spark, path, chunks, schemas.CHUNKS))
