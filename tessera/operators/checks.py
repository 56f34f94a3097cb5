"""Data-quality checks: each raises CheckFailed with what it found, or lets the rows through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import formats


class CheckFailed(RuntimeError):
    pass


def positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def one_of(name: str, value: str, allowed: Iterable[str]) -> None:
    if value not in (allowed := sorted(allowed)):
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise CheckFailed(f"{what} has no rows")
    return rows


def pending_counts(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """Pending contexts and answers in one row; error statuses don't block."""
    return contexts.agg(F.count_if(F.col("question_status") == formats.PENDING).alias("pending_contexts")).crossJoin(questions.agg(F.count_if(F.col("answer_status") == formats.PENDING).alias("pending_answers")))


def require_finished(contexts: DataFrame, questions: DataFrame, label: str) -> None:
    found = pending_counts(contexts, questions).first()
    if found.pending_contexts or found.pending_answers:
        raise CheckFailed(f"{label} is unfinished: {found.pending_contexts} contexts and {found.pending_answers} answers are pending")


def require_size(rows: DataFrame, size: int, what: str) -> None:
    if (n := rows.count()) != size:
        raise CheckFailed(f"{what}: expected {size} rows, found {n}")


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return rows.groupBy(columns).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, columns: list[str], what: str) -> None:
    if not duplicates(rows, columns).isEmpty():
        raise CheckFailed(f"{what}: {', '.join(columns)} isn't unique")


def require_single(rows: DataFrame, column: str, what: str) -> None:
    if rows.select(column).distinct().limit(2).count() > 1:
        raise CheckFailed(f"{what}: more than one {column}")


def missing_keys(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that the reference lacks."""
    return rows.select(key).distinct().join(reference, key, "left_anti")


def require_subset(rows: DataFrame, reference: DataFrame, key: str, what: str) -> None:
    if n := missing_keys(rows, reference, key).count():
        raise CheckFailed(f"{what}: {n} values of {key} have no counterpart")


def valid_messages(messages: str = "messages") -> Column:
    """Exactly a user's and an assistant's message, neither blank."""
    from ..functions.text import strip

    first, second = F.get(messages, 0), F.get(messages, 1)
    filled = lambda m: F.coalesce(strip(m["content"]) != "", F.lit(False))
    return F.coalesce((F.size(messages) == 2) & (first["role"] == "user") & (second["role"] == "assistant"), F.lit(False)) & filled(first) & filled(second)


def require_valid_messages(rows: DataFrame, messages: str = "messages") -> DataFrame:
    if n := rows.where(~valid_messages(messages)).count():
        raise CheckFailed(f"{n} rows have invalid messages")
    return rows


def valid_judgement(judge: str = "judge") -> Column:
    at = lambda name: F.col(f"{judge}.{name}")
    return F.coalesce(at("correctness").between(1, 5) & at("completeness").between(1, 5) & (at("unsupported_claims") >= 0) & at("rationale").isNotNull(), F.lit(False))


def require_benchmark(benchmark: DataFrame, training: DataFrame, size: int) -> DataFrame:
    """Exact size, unique ids kept in the training set, one item for each page."""
    require_size(benchmark, size, "benchmark")
    require_unique(benchmark, ["training_example_id"], "benchmark")
    require_subset(benchmark, training, "training_example_id", "benchmark")
    require_unique(benchmark, ["source_page_id"], "benchmark")
    return benchmark


def require_prefix(saved: DataFrame, benchmark: DataFrame) -> int:
    """Rows saved so far have to be the benchmark's first ones, without gaps; gives their number."""
    joined = saved.select("benchmark_index", "question").join(benchmark.select("benchmark_index", F.col("question").alias("expected")), "benchmark_index", "left")
    found = joined.agg(F.count("*").alias("n"), F.countDistinct("benchmark_index").alias("keys"), F.max("benchmark_index").alias("last"), F.count_if(~F.col("question").eqNullSafe(F.col("expected"))).alias("other")).first()
    if found.n and (found.other or found.keys != found.n or found.last != found.n - 1):
        raise CheckFailed("saved answers aren't a prefix of the benchmark")
    return found.n


def require_saved_subset(saved: DataFrame, benchmark: DataFrame) -> int:
    """Rows saved in any order: unique indexes, all of the benchmark; gives their number."""
    require_unique(saved, ["benchmark_index"], "saved answers")
    require_subset(saved, benchmark, "benchmark_index", "saved answers")
    return saved.count()
