"""Reproducible selection: an order by digest, balanced over categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..functions.text import or_default, stable_rank, stripped_texts, strip
from .checks import CheckFailed, positive


def candidates(examples: DataFrame, questions: DataFrame, database: str) -> DataFrame:
    """Accepted and complete examples as benchmark candidates; payload is parsed already.

    Rows without exactly two messages or without evidence are left out.
    """
    done = questions.where(F.col("answer_status") == formats.COMPLETE).select("question_id")
    rows = examples.where(F.col("accepted") == 1).join(done, "question_id")
    context, messages = "payload.provenance.context", F.col("payload.example.messages")
    rows = rows.withColumn("_evidence", stripped_texts(F.coalesce("payload.provenance.evidence", F.array().cast("array<string>"))))
    rows = rows.where((F.size(messages) == 2) & (F.size("_evidence") > 0))
    return rows.select(
        F.concat_ws(":", F.lit(database), "question_id").alias("training_example_id"), F.col("question_id").alias("training_question_id"), F.lit(database).alias("training_database"),
        F.concat_ws(":", F.col(f"{context}.doc_id"), F.col(f"{context}.document_version")).alias("source_page_id"), or_default(F.col(f"{context}.category"), formats.NO_CATEGORY).alias("category"),
        strip(messages[0]["content"]).alias("training_question"), strip(messages[1]["content"]).alias("training_answer"), F.col("_evidence").alias("evidence"),
        *(F.coalesce(F.col(f"{context}.{c}"), F.lit("")).alias(name) for c, name in (("source_title", "source_title"), ("source_url", "source_url"), ("context_id", "source_context_id"))),
    )


def one_per_page(rows: DataFrame, page: str = "source_page_id", key: str = "training_example_id") -> DataFrame:
    """The row of least digest of each page."""
    least = Window.partitionBy(page).orderBy(stable_rank(F.col(key)), key)
    return rows.withColumn("_nth", F.row_number().over(least)).where("_nth = 1").drop("_nth")


def round_robin(rows: DataFrame, size: int, key: str, category: str = "category") -> DataFrame:
    """The first `size` rows taken in turn from each category, by digest of the key within one.

    Adds selection_index, from 0. No category gives more than `size` rows, so
    that many of each are enough before the final order.
    """
    positive(size=size)
    order = Window.partitionBy(category).orderBy(stable_rank(F.col(key)), key)
    turn = rows.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= size)
    first = turn.orderBy("_turn", category).limit(size)
    return first.withColumn("selection_index", F.row_number().over(Window.orderBy("_turn", category)) - 1).drop("_turn")


def benchmark_selection(rows: DataFrame, size: int = formats.BENCHMARK_SIZE) -> DataFrame:
    """One candidate for each page, then balanced over categories; raises if there are too few."""
    chosen = round_robin(one_per_page(rows), size, "source_page_id")
    return _of_size(chosen, size)


def checkpoint_selection(rows: DataFrame, size: int = formats.SELECTION_SIZE) -> DataFrame:
    """Balanced subset of a benchmark; here only a missing category is the default one."""
    rows = rows.withColumn("category", or_default(F.col("category"), formats.NO_CATEGORY, empty_too=False))
    return _of_size(round_robin(rows, size, "training_example_id"), size)


def _of_size(rows: DataFrame, size: int) -> DataFrame:
    if (n := rows.count()) < size:
        raise CheckFailed(f"need {size} rows, found {n}")
    return rows


def seeded_subset(rows: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """`size` rows in an order by seed, all of them if there are fewer."""
    positive(size=size)
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(size)
