"""Questions, answers and benchmark items: resumable steps over a staging store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats, schemas
from ..functions.prompts import answer_messages, evaluation_messages, page_question_messages, question_messages
from ..functions.similarity import too_similar
from ..functions.text import strip, stripped_texts
from ..operators.contexts import adjacent_contexts, page_contexts
from ..operators.corpus import eligible_chunks, source_manifest
from ..operators.sampling import benchmark_selection
from ..operators.staging import Store, in_scope, pending, pilot_scope
from ..sources.config import Settings
from ..sources.services import Client, called


def _payload(rows: DataFrame) -> DataFrame:
    return rows.select("context_id", F.to_json(F.struct(*rows.columns)).alias("payload"))


def build_contexts(chunks: DataFrame, kind: str, settings: Settings) -> DataFrame:
    rows = eligible_chunks(chunks, settings.min_chars)
    if kind == "page_aware":
        return page_contexts(rows, settings.page_tokens, settings.chars_per_token)
    if kind == "independent":
        return adjacent_contexts(rows, settings.adjacent_chars)
    raise ValueError("kind must be page_aware or independent")


def stage_contexts(store: Store, chunks: DataFrame, kind: str, settings: Settings) -> dict:
    """Adds the contexts that aren't staged yet; gives the source manifest (over all rows, eligible or not)."""
    store.create()
    store.insert("contexts", _payload(build_contexts(chunks, kind, settings)))
    return source_manifest(chunks).first().asDict()


def _written(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """Replies are kept before anything reads them: calls aren't repeatable."""
    at = f"{store.root}/replies/{name}-{store.spark.sparkContext.applicationId}-{store.spark._jvm.java.lang.System.nanoTime()}"
    rows.write.parquet(at)
    return store.spark.read.schema(rows.schema).parquet(at)


def ask_questions(store: Store, client: Client, kind: str, settings: Settings, pilot: bool = False) -> None:
    """Calls the generator for pending contexts. Errors are final: they aren't asked again, and don't block an export."""
    contexts = store.table("contexts")
    waiting = pending(contexts, "question_status", "context_id")
    if pilot:
        waiting = in_scope(waiting, pilot_scope(contexts, store.table("questions"), settings.pilot_size), "context_id")
    text = F.get_json_object("payload", "$.context")
    prompt = page_question_messages(text) if kind == "page_aware" else question_messages(text)
    requests = waiting.select("context_id", F.to_json(prompt).alias("messages"))
    replies = _written(store, "questions", called(requests, client, workers=settings.workers, retries=1))
    parsed = replies.withColumn("_texts", F.from_json("reply", "questions array<string>")["questions"])
    valid = (F.size("_texts") > 0) & F.forall("_texts", lambda q: F.coalesce(q != "", F.lit(False)))
    parsed = parsed.withColumn("_status", F.coalesce("error", F.when(F.coalesce(valid, F.lit(False)), formats.COMPLETE).otherwise(formats.ERROR + "the reply doesn't fit the schema")))
    good = parsed.where(F.col("_status") == formats.COMPLETE).select("context_id", F.explode(stripped_texts(F.col("_texts"))).alias("question"))
    store.insert("questions", good.withColumn("payload", F.to_json(F.struct("question"))), ["context_id", "question"])
    store.mark("contexts", parsed.select("context_id", F.col("_status").alias("question_status")))


def answer_questions(store: Store, client: Client, model: str, revision: str, manifest_sha256: str, settings: Settings) -> None:
    waiting = pending(store.table("questions"), "answer_status", "question_id").select("question_id", "question", "context_id")
    joined = waiting.join(store.table("contexts").select("context_id", F.col("payload").alias("_payload")), "context_id")
    joined = joined.withColumn("_context", F.from_json("_payload", schemas.STORED_CONTEXT, {"mode": "FAILFAST"}))
    requests = joined.select("question_id", "question", "_payload", F.to_json(answer_messages(F.col("question"), F.col("_context.context"))).alias("messages"))
    replies = _written(store, "answers", called(requests, client, workers=settings.workers, retries=1))
    parsed = replies.withColumn("_reply", F.from_json("reply", "answer string, evidence array<string>"))
    fits = F.coalesce((F.col("_reply.answer") != "") & (F.size("_reply.evidence") > 0) & F.forall("_reply.evidence", lambda e: F.coalesce(e != "", F.lit(False))), F.lit(False))
    parsed = parsed.withColumn("_status", F.coalesce("error", F.when(fits, formats.COMPLETE).otherwise(formats.ERROR + "the reply doesn't fit the schema")))
    answer, evidence = strip(F.col("_reply.answer")), stripped_texts(F.col("_reply.evidence"))
    accepted = (answer != "") & (F.size(evidence) > 0)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    example = F.struct(F.array(turn("user", F.col("question")), turn("assistant", answer)).alias("messages"))
    provenance = F.struct("question_id", "question", evidence.alias("evidence"), F.lit(model).alias("model"), F.lit(revision).alias("prompt_revision"), F.lit(manifest_sha256).alias("source_manifest_sha256"), F.from_json("_payload", schemas.STORED_CONTEXT).alias("context"))
    good = parsed.where(F.col("_status") == formats.COMPLETE)
    store.put("examples", good.select("question_id", F.to_json(F.struct(example.alias("example"), provenance.alias("provenance"))).alias("payload"), accepted.cast("int").alias("accepted"), F.when(~accepted, formats.EMPTY_ANSWER).alias("rejection_reason")))
    store.mark("questions", parsed.select("question_id", F.col("_status").alias("answer_status")))


def parsed_examples(store: Store) -> DataFrame:
    return store.table("examples").withColumn("payload", F.from_json("payload", schemas.EXAMPLE_PAYLOAD, {"mode": "FAILFAST"}))


def freeze_benchmark(store: Store, rows: DataFrame, size: int) -> DataFrame:
    """Selects the benchmark once; later calls use the frozen one."""
    store.create()
    if not store.log("evaluation_candidates").isEmpty():
        return store.table("evaluation_candidates")
    chosen = benchmark_selection(rows, size).drop("selection_index")
    return store.freeze("evaluation_candidates", chosen.select("training_example_id", "category", F.to_json(F.struct(*chosen.columns)).alias("payload")))


CANDIDATE = "training_example_id string, training_question_id long, training_database string, source_page_id string, category string, training_question string, training_answer string, evidence array<string>, source_title string, source_url string, source_context_id string"


def generate_benchmark(store: Store, client: Client, model: str, revision: str, settings: Settings) -> None:
    """Asks for a paired item for each pending candidate; wording too close to the training question is rejected for good."""
    rows = pending(store.table("evaluation_candidates"), "evaluation_status", "training_example_id")
    rows = rows.withColumn("_c", F.from_json("payload", CANDIDATE, {"mode": "FAILFAST"}))
    prompt = evaluation_messages(*(F.col(f"_c.{c}") for c in ("source_title", "training_question", "training_answer", "evidence")))
    replies = _written(store, "benchmark", called(rows.select("training_example_id", "payload", F.to_json(prompt).alias("messages")), client, workers=settings.workers, retries=1))
    parsed = replies.withColumn("_c", F.from_json("payload", CANDIDATE)).withColumn("_reply", F.from_json("reply", "question string, answer string, evidence array<string>"))
    fits = F.coalesce((F.col("_reply.question") != "") & (F.col("_reply.answer") != "") & (F.size("_reply.evidence") > 0) & F.forall("_reply.evidence", lambda e: F.coalesce(e != "", F.lit(False))), F.lit(False))
    parsed = parsed.withColumn("_status", F.coalesce("error", F.when(fits, formats.COMPLETE).otherwise(formats.ERROR + "the reply doesn't fit the schema")))
    good = parsed.where(F.col("_status") == formats.COMPLETE).withColumn("question", strip(F.col("_reply.question"))).withColumn("answer", strip(F.col("_reply.answer"))).withColumn("evidence", stripped_texts(F.col("_reply.evidence")))
    good = good.withColumn("_near", too_similar(F.col("_c.training_question"), F.col("question")))
    reason = F.when(F.col("_near"), formats.TOO_SIMILAR).when((F.col("answer") == "") | (F.size("evidence") == 0), formats.EMPTY_ANSWER)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    example = F.struct(F.array(turn("user", "question"), turn("assistant", "answer")).alias("messages"))
    provenance = F.struct("_c.*", F.col("question").alias("evaluation_question"), F.col("evidence").alias("evaluation_evidence"), F.lit(model).alias("model"), F.lit(revision).alias("prompt_revision"))
    good = good.withColumn("rejection_reason", reason).withColumn("_payload", F.to_json(F.struct(example.alias("example"), provenance.alias("provenance"))))
    store.put("evaluation_examples", good.select("training_example_id", F.when(F.col("rejection_reason").isNull(), F.col("_payload")).otherwise("{}").alias("payload"), F.col("rejection_reason").isNull().cast("int").alias("accepted"), "rejection_reason"))
    store.mark("evaluation_candidates", parsed.select("training_example_id", F.col("_status").alias("evaluation_status")))
