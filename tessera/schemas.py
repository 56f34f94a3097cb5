"""Explicit schemas of every table the engine reads or keeps."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


TEXT, INT, LONG = StringType(), IntegerType(), LongType()
TEXTS = ArrayType(TEXT)
MESSAGES = ArrayType(table(role=TEXT, content=TEXT))

DOCUMENTS = table(doc_id=TEXT, document_version=TEXT, category=TEXT, source_last_updated=TEXT, source_content_hash=TEXT, status=TEXT)
CHUNKS = table(doc_id=TEXT, document_version=TEXT, chunk_id=TEXT, position=INT, chunk_text=TEXT, heading_path=TEXT, source_title=TEXT, source_url=TEXT)
CONTEXTS = table(context_id=TEXT, payload=TEXT, question_status=TEXT)
QUESTIONS = table(question_id=LONG, context_id=TEXT, question=TEXT, payload=TEXT, answer_status=TEXT)
EXAMPLES = table(question_id=LONG, payload=TEXT, accepted=INT, rejection_reason=TEXT)
EVALUATION_CANDIDATES = table(training_example_id=TEXT, category=TEXT, payload=TEXT, evaluation_status=TEXT)
EVALUATION_EXAMPLES = table(training_example_id=TEXT, payload=TEXT, accepted=INT, rejection_reason=TEXT)

ADJACENT_CONTEXT = table(context_id=TEXT, doc_id=TEXT, document_version=TEXT, category=TEXT, chunk_ids=TEXTS, source_url=TEXT, source_title=TEXT, heading_paths=TEXTS, context=TEXT)
PAGE_CONTEXT = table(context_id=TEXT, generation_strategy=TEXT, context_kind=TEXT, window_index=INT, doc_id=TEXT, document_version=TEXT, category=TEXT, source_url=TEXT, source_title=TEXT, page_chunk_count=INT, chunk_ids=TEXTS, heading_paths=TEXTS, estimated_context_tokens=INT, context=TEXT)
#: A stored context of either kind; columns that a kind lacks are null.
STORED_CONTEXT = PAGE_CONTEXT
EXAMPLE = table(messages=MESSAGES)
PROVENANCE = StructType([*table(question_id=LONG, question=TEXT, evidence=TEXTS, model=TEXT, prompt_revision=TEXT, source_manifest_sha256=TEXT).fields, StructField("context", STORED_CONTEXT)])
EXAMPLE_PAYLOAD = StructType([StructField("example", EXAMPLE), StructField("provenance", PROVENANCE)])

BENCHMARK_LINE = table(messages=MESSAGES)
ANSWER = table(candidate=TEXT, benchmark_index=INT, question=TEXT, reference=TEXT, answer=TEXT, latency_ms=LONG)
JUDGEMENT = table(correctness=INT, completeness=INT, unsupported_claims=INT, rationale=TEXT)
SCORED = StructType([*ANSWER.fields, StructField("judge", JUDGEMENT)])
