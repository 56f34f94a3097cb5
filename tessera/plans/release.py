"""The final, immutable datasets: kept training rows, the benchmark and its selection subset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats
from ..operators.checks import CheckFailed, require_benchmark, require_finished
from ..operators.corpus import source_manifest
from ..operators.export import dataset_manifest, refuse_existing, revalidated, training_rows, write_json, write_jsonl
from ..operators.sampling import checkpoint_selection
from ..operators.staging import Store
from ..sources.config import Settings
from .generation import CANDIDATE, build_contexts, parsed_examples

BENCHMARK_PAYLOAD = f"example struct<messages:array<struct<role:string,content:string>>>, provenance struct<{', '.join(c.replace(' ', ':', 1) for c in CANDIDATE.split(', '))},evaluation_question:string,evaluation_evidence:array<string>,model:string,prompt_revision:string>"


def kept_examples(store: Store, current: DataFrame, kind: str, database: str) -> tuple[DataFrame, int]:
    """Accepted, complete examples whose context still stands, and how many others there were."""
    require_finished(store.table("contexts"), store.table("questions"), kind)
    done = store.table("questions").where(F.col("answer_status") == formats.COMPLETE).select("question_id")
    rows = parsed_examples(store).where("accepted = 1").join(done, "question_id")
    rows = rows.withColumn("context_id", F.col("payload.provenance.context.context_id")).withColumn("context", F.col("payload.provenance.context.context"))
    checked = revalidated(rows, current)
    return training_rows(checked.where("kept"), kind, database), checked.where(~F.col("kept")).count()


def accepted_benchmark(store: Store) -> DataFrame:
    done = store.table("evaluation_candidates").where(F.col("evaluation_status") == formats.COMPLETE).select("training_example_id")
    rows = store.table("evaluation_examples").where("accepted = 1").join(done, "training_example_id")
    rows = rows.withColumn("_p", F.from_json("payload", BENCHMARK_PAYLOAD, {"mode": "FAILFAST"}))
    return rows.select("training_example_id", F.col("_p.example").alias("example"), F.col("_p.provenance").alias("provenance"), F.col("_p.provenance.source_page_id").alias("source_page_id"), F.col("_p.provenance.category").alias("category"))


def shortfall(store: Store) -> DataFrame:
    """Candidates that gave no accepted item, with the reason: they block a benchmark of their number."""
    rows = store.table("evaluation_candidates").join(store.table("evaluation_examples").select("training_example_id", "accepted", "rejection_reason"), "training_example_id", "left")
    return rows.where(F.coalesce("accepted", F.lit(0)) == 0).select("training_example_id", "evaluation_status", "rejection_reason")


def export(chunks: DataFrame, stores: dict[str, Store], benchmark_store: Store, directory: str, version: str, settings: Settings) -> dict:
    """Writes six JSONL files and a manifest into a directory that has none of them."""
    spark = chunks.sparkSession
    benchmark_name, selection_name = f"benchmark_{settings.benchmark_size}", f"benchmark_selection_{settings.selection_size}"
    names = [f"{n}{suffix}" for n in ("training", benchmark_name, selection_name) for suffix in (".jsonl", ".provenance.jsonl")]
    refuse_existing(spark, directory, [*names, "dataset_manifest.json"])
    parts, sources = [], {}
    for kind, store in stores.items():
        rows, excluded = kept_examples(store, build_contexts(chunks, kind, settings), kind, kind)
        parts.append(rows)
        sources[kind] = {"database": store.root, "exported": rows.count(), "excluded_context_mismatch": excluded}
    training = reduce(DataFrame.unionByName, parts)
    benchmark = accepted_benchmark(benchmark_store)
    try:
        require_benchmark(benchmark, training, settings.benchmark_size)
    except CheckFailed as failed:
        lacking = [r.training_example_id for r in shortfall(benchmark_store).orderBy("training_example_id").limit(3).collect()]
        raise CheckFailed(f"{failed}; without an accepted item: {lacking}") from failed
    selection = checkpoint_selection(benchmark, settings.selection_size)
    for name, rows, order in (("training", training, "training_example_id"), (benchmark_name, benchmark, "training_example_id"), (selection_name, selection, "selection_index")):
        for suffix, field in ((".jsonl", "example"), (".provenance.jsonl", "provenance")):
            write_jsonl(rows, f"{directory}/{name}{suffix}", field, [order])
    manifest = dataset_manifest(spark, version, source_manifest(chunks).first().manifest_sha256, sources, {"benchmark_size": settings.benchmark_size, "checkpoint_selection_size": settings.selection_size}, [f"{directory}/{n}" for n in names])
    write_json(spark, f"{directory}/dataset_manifest.json", manifest)
    return manifest
