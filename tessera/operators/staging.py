"""A staging store on plain files: append-only logs, and views of the latest row of each key.

A batch is written once and read by everything that follows, so calls that
can't be repeated (a model's answers) aren't. One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import formats, schemas


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old doesn't have, one for each key (the least row, whatever the order of arrival)."""
    others = [c for c in new.columns if c not in keys]
    fresh = new.join(old.select(keys).distinct(), keys, "left_anti")
    if not others:
        return fresh.distinct()
    return fresh.groupBy(keys).agg(F.min(F.struct(others)).alias("_row")).select(*keys, "_row.*").select(new.columns)


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row of each key that was written last."""
    last = Window.partitionBy(keys).orderBy(F.col(order).desc())
    return log.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, replaced by new ones of equal keys."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new)


def latest_status(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, order).alias(status))


def pending(rows: DataFrame, status: str, order: str) -> DataFrame:
    return rows.where(F.col(status) == formats.PENDING).orderBy(order)


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def in_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return rows.join(scope.select(key).distinct(), key, "left_semi")


def pilot_scope(contexts: DataFrame, questions: DataFrame, size: int) -> DataFrame:
    """The first contexts that are pending themselves or have a pending answer."""
    waiting = questions.where(F.col("answer_status") == formats.PENDING).select("context_id").distinct().withColumn("_waiting", F.lit(True))
    rows = contexts.join(waiting, "context_id", "left").where((F.col("question_status") == formats.PENDING) | F.col("_waiting"))
    return rows.select("context_id").orderBy("context_id").limit(size)


def status_histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.desc("n"), status)


def key_histogram(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each key, the greatest key first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc(key))


def progress(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys in all, those done, and how many are left, in one row."""
    marked = rows.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    counts = marked.agg(F.count("*").alias("total"), F.count("_done").alias("done"))
    return counts.withColumn("remaining", F.col("total") - F.col("done"))


def question_id(context_id: str = "context_id", question: str = "question"):
    """An identity that doesn't depend on the order of arrival."""
    return F.xxhash64(context_id, question)


@dataclass
class Store:
    """Tables of one generation run below a directory."""

    spark: SparkSession
    root: str

    TABLES = {"contexts": (schemas.CONTEXTS, ["context_id"]), "questions": (schemas.QUESTIONS, ["question_id"]), "examples": (schemas.EXAMPLES, ["question_id"]), "evaluation_candidates": (schemas.EVALUATION_CANDIDATES, ["training_example_id"]), "evaluation_examples": (schemas.EVALUATION_EXAMPLES, ["training_example_id"])}
    STATUS = {"contexts": "question_status", "questions": "answer_status", "evaluation_candidates": "evaluation_status"}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def logged(self, name: str) -> StructType:
        return StructType([*self.TABLES[name][0].fields, StructField("seq", LongType())])

    def create(self) -> None:
        """Makes the tables that aren't there yet."""
        for name in self.TABLES:
            if not self.exists(name):
                self.spark.createDataFrame([], self.logged(name)).write.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def log(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.logged(name)).parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        """The current rows."""
        return latest(self.log(name), self.TABLES[name][1]).drop("seq")

    def append(self, name: str, rows: DataFrame) -> None:
        seq = (self.log(name).agg(F.max("seq").alias("seq")).first().seq or 0) + 1
        columns = self.TABLES[name][0]
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in columns), F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path(name))

    def insert(self, name: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Adds rows of keys that aren't there; a replay adds nothing. Missing status columns are pending."""
        if (status := self.STATUS.get(name)) and status not in rows.columns:
            rows = rows.withColumn(status, F.lit(formats.PENDING))
        if name == "questions" and "question_id" not in rows.columns:
            rows = rows.withColumn("question_id", question_id())
        self.append(name, insert_if_absent(self.table(name), rows, keys or self.TABLES[name][1]))

    def put(self, name: str, rows: DataFrame) -> None:
        """Inserts or replaces by key."""
        self.append(name, rows)

    def mark(self, name: str, statuses: DataFrame) -> None:
        """statuses: the table's key and its new status."""
        keys, status = self.TABLES[name][1], self.STATUS[name]
        rows = self.table(name).drop(status).join(statuses.select(*keys, status), keys)
        self.append(name, rows)

    def compact(self, name: str) -> None:
        """Rewrites a log as its current rows."""
        side = f"{self.path(name)}.compact"
        self.table(name).withColumn("seq", F.lit(1).cast("long")).write.mode("overwrite").parquet(side)
        self.spark.read.schema(self.logged(name)).parquet(side).write.mode("overwrite").parquet(self.path(name))

    def freeze(self, name: str, rows: DataFrame) -> DataFrame:
        """Inserts rows only into an empty table; what was frozen before is used again."""
        if self.log(name).isEmpty():
            self.insert(name, rows)
        return self.table(name)
