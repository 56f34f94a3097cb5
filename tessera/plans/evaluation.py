"""Answers of candidates to a frozen benchmark, their scores and ranking; resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats, schemas
from ..functions.prompts import judge_messages
from ..operators.checks import CheckFailed, not_empty, require_prefix, require_saved_subset, require_single
from ..operators.evaluation import judged, metrics, ranking, report
from ..operators.staging import todo
from ..sources.files import exists, read_numbered_jsonl
from ..sources.services import Client, batched_answers, called

BATCH = 512


def benchmark_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = read_numbered_jsonl(spark, path, schemas.BENCHMARK_LINE, limit)
    return not_empty(rows.select("benchmark_index", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("reference")), "benchmark")


def saved(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def answer_in_order(benchmark: DataFrame, load: Callable, candidate: str, path: str, batch: int = 4) -> DataFrame:
    """Answers by a local model, in order; goes on after the last index that is saved."""
    spark = benchmark.sparkSession
    done = require_prefix(saved(spark, path, schemas.ANSWER), benchmark)
    rest = benchmark.where(F.col("benchmark_index") >= done)
    while not rest.isEmpty():
        part = rest.where(F.col("benchmark_index") < done + BATCH)
        rows = batched_answers(part.orderBy("benchmark_index").coalesce(1), load, batch=batch)
        _append(rows.withColumn("candidate", F.lit(candidate)), schemas.ANSWER, path)
        done += BATCH
        rest = benchmark.where(F.col("benchmark_index") >= done)
    return saved(spark, path, schemas.ANSWER).orderBy("benchmark_index")


def answer_by_service(benchmark: DataFrame, client: Client, candidate: str, path: str, workers: int = 6, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """Answers by a service, in any order; what is saved isn't asked again, successes are kept, failures raise at the end."""
    spark = benchmark.sparkSession
    before = saved(spark, path, schemas.ANSWER)
    require_saved_subset(before, benchmark)
    rest = todo(benchmark, before, "benchmark_index")
    if not rest.isEmpty():
        rows = _kept(called(rest, client, workers=workers, retries=retries, wait_s=wait_s), f"{path}.replies")
        rows = rows.withColumn("answer", F.get_json_object("reply", "$.answer")).withColumn("candidate", F.lit(candidate))
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("answer").isNull(), formats.ERROR + "the reply has no answer")))
        _append(rows.where("error IS NULL"), schemas.ANSWER, path)
        _raise_failures(rows.where("error IS NOT NULL"))
    return saved(spark, path, schemas.ANSWER).orderBy("benchmark_index")


def judge(answers: DataFrame, client: Client, path: str, workers: int = 6, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """Judges the answers that aren't judged yet."""
    spark = answers.sparkSession
    require_single(answers, "candidate", "answers")
    rest = todo(not_empty(answers, "answers"), saved(spark, path, schemas.SCORED), "benchmark_index")
    if not rest.isEmpty():
        prompt = judge_messages(F.col("question"), F.col("reference"), F.col("answer"))
        requests = rest.withColumnRenamed("latency_ms", "answer_ms").withColumn("messages", F.to_json(prompt))
        rows = judged(_kept(called(requests, client, workers=workers, retries=retries, wait_s=wait_s), f"{path}.replies"))
        good = rows.where("judge IS NOT NULL").drop("latency_ms").withColumnRenamed("answer_ms", "latency_ms")
        _append(good, schemas.SCORED, path)
        _raise_failures(rows.where("judge IS NULL").withColumn("error", F.coalesce("error", F.lit(formats.ERROR + "the reply doesn't fit the schema"))))
    return saved(spark, path, schemas.SCORED)


def compare(scores: DataFrame) -> DataFrame:
    return ranking(metrics(not_empty(scores, "scores")))


def complete(answers: DataFrame, size: int) -> bool:
    return answers.count() == size


def _append(rows: DataFrame, schema, path: str) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).write.mode("append").parquet(path)


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _raise_failures(bad: DataFrame) -> None:
    if n := bad.count():
        first = [f"{r.benchmark_index}: {r.error}" for r in bad.orderBy("benchmark_index").limit(3).collect()]
        raise CheckFailed(f"{n} calls failed; first: {'; '.join(first)}")


__all__ = ["answer_by_service", "answer_in_order", "benchmark_questions", "compare", "complete", "judge", "report"]
