"""Scores of answers, and the ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .checks import not_empty, valid_judgement


def judged(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies of a judge parsed into `judge`; what doesn't fit the schema and its ranges has none."""
    rows = rows.withColumn("judge", F.from_json(reply, schemas.JUDGEMENT))
    return rows.withColumn("judge", F.when(valid_judgement(), F.col("judge")))


def metrics(rows: DataFrame, by: str = "candidate") -> DataFrame:
    """Means and totals of each candidate."""
    return rows.groupBy(by).agg(F.avg("judge.correctness").alias("correctness_mean"), F.avg("judge.completeness").alias("completeness_mean"), F.sum("judge.unsupported_claims").cast("long").alias("unsupported_claims_total"), F.avg("latency_ms").alias("latency_ms_mean"))


RANK_ORDER = ("correctness_mean", False), ("completeness_mean", False), ("unsupported_claims_total", True), ("latency_ms_mean", True)


def ranking(reports: DataFrame, tie: str = "candidate") -> DataFrame:
    """Best candidate first; `rank` from 1. One row for each candidate, so one task may order them."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in RANK_ORDER]
    return reports.withColumn("rank", F.row_number().over(Window.orderBy(*order, tie))).orderBy("rank")


def winner(reports: DataFrame) -> DataFrame:
    return ranking(not_empty(reports, "score reports")).limit(1)


def report(rows: DataFrame) -> DataFrame:
    """One nested row for each candidate: its metrics and its judged answers in order."""
    columns = F.struct("benchmark_index", *(c for c in rows.columns if c not in ("candidate", "benchmark_index")))
    lists = rows.groupBy("candidate").agg(F.sort_array(F.collect_list(columns)).alias("rows"))
    names = [c for c, _ in RANK_ORDER]
    return metrics(rows).select("candidate", F.struct(names).alias("metrics")).join(lists, "candidate")


def source_tag(candidate: str = "candidate"):
    """What a candidate's answers come from."""
    return F.when(F.col(candidate) == "rag", "retrieval").when(F.col(candidate) == "base", "base").otherwise("adapter")
