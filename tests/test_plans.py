from __future__ import annotations

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import evaluation
from tessera.operators.checks import CheckFailed
from tessera.operators.export import file_metadata, revalidated, write_jsonl
from tessera.operators.staging import Store
from tessera.plans import evaluation as scoring
from tessera.plans import generation, release
from tessera.plans.training import RunLog, training_data
from tessera.sources.config import Settings, candidates, experiment_name, flatten, load_config, simple_yaml
from tessera.sources.files import MissingInput, read_jsonl, read_numbered_jsonl, union_of
from tessera.sources.services import called, preflight, with_retries
from tessera.sources.sqlite import load_corpus, read_sqlite
from tessera.streaming.work_queue import stage_stream


def corpus_rows(spark, pages=6):
    columns = "doc_id string, document_version string, category string, source_last_updated string, source_content_hash string, chunk_id string, position int, chunk_text string, heading_path string, source_title string, source_url string"
    rows = [(f"d{d}", "v1", "ab"[d % 2], None, f"h{d}", f"d{d}-{p}", p, f"Page {d} chunk {p} " + "words that fill it " * 14, None, f"Title {d}", "u") for d in range(pages) for p in range(3)]
    return spark.createDataFrame(rows, columns)


def questions(request):
    text = json.loads(request["messages"])[1]["content"]
    if "Page 5" in text:
        raise RuntimeError("down")
    return {"questions": [f"What does {text.split(chr(10))[3][:30]} say?", " "]} if "Page 4" not in text else {"questions": []}


def answers(request):
    return {"answer": f"It says: {request['question']}", "evidence": ["words that fill it"]}


def paired(request):
    text = json.loads(request["messages"])[1]["content"]
    return {"question": f"In other words, {abs(hash(text)) % 7} of what matters here?", "answer": "An answer.", "evidence": ["words"]}


@pytest.fixture
def finished(spark, root):
    rows, settings = corpus_rows(spark), Settings(workers=2, benchmark_size=4, selection_size=2)
    store = Store(spark, f"{root}/page")
    manifest = generation.stage_contexts(store, rows, "page_aware", settings)
    generation.ask_questions(store, questions, "page_aware", settings)
    generation.answer_questions(store, answers, "m", "r", manifest["manifest_sha256"], settings)
    return rows, settings, store


def test_generation_is_resumable(spark, root, finished):
    rows, settings, store = finished
    status = {r.context_id: r.question_status for r in store.table("contexts").collect()}
    assert status["d0:v1:page-aware-v2"] == "complete" and status["d5:v1:page-aware-v2"] == "error:down" and status["d4:v1:page-aware-v2"].startswith("error:")
    before = store.table("examples").count()
    assert before == 4
    refuse = lambda request: (_ for _ in ()).throw(AssertionError("asked again"))
    generation.stage_contexts(store, rows, "page_aware", settings)
    generation.ask_questions(store, refuse, "page_aware", settings)
    generation.answer_questions(store, refuse, "m", "r", "", settings)
    assert store.table("examples").count() == before and store.table("contexts").count() == 6


def test_export(spark, root, finished):
    from tessera.operators.sampling import candidates as benchmark_candidates

    rows, settings, store = finished
    bench = Store(spark, f"{root}/bench")
    chosen = benchmark_candidates(generation.parsed_examples(store), store.table("questions"), "page_aware")
    generation.freeze_benchmark(bench, chosen, settings.benchmark_size)
    generation.generate_benchmark(bench, paired, "m", "r", settings)
    out = f"{root}/export"
    manifest = release.export(rows, {"page_aware": store}, bench, out, "v1", settings)
    assert manifest["training.jsonl"]["rows"] == 4 and manifest["benchmark_selection_2.jsonl"]["rows"] == 2
    assert manifest["training_sources"]["page_aware"]["excluded_context_mismatch"] == 0
    with pytest.raises(FileExistsError):
        release.export(rows, {"page_aware": store}, bench, out, "v1", settings)
    train, selection = training_data(spark, out, "benchmark_selection_2", limit=3)
    assert train.count() == 3 and selection.count() == 2 and train.columns == ["prompt", "completion"]
    os.remove(f"{out}/.training.jsonl.crc")
    with open(f"{out}/training.jsonl", "a") as file:
        file.write("\n")
    with pytest.raises(ValueError, match="differs"):
        training_data(spark, out, "benchmark_selection_2")
    with pytest.raises(CheckFailed, match="expected 9"):
        release.export(rows, {"page_aware": store}, bench, f"{root}/other", "v1", Settings(benchmark_size=9, selection_size=2))


def test_rejected_benchmark_item_is_final(spark, root, finished):
    from tessera.operators.sampling import candidates as benchmark_candidates

    _, settings, store = finished
    bench = Store(spark, f"{root}/near")
    chosen = benchmark_candidates(generation.parsed_examples(store), store.table("questions"), "page_aware")
    generation.freeze_benchmark(bench, chosen, 2)
    copy = lambda request: {"question": json.loads(request["payload"])["training_question"].upper(), "answer": "a", "evidence": ["e"]}
    generation.generate_benchmark(bench, copy, "m", "r", settings)
    assert {r.rejection_reason for r in release.shortfall(bench).collect()} == {"evaluation question is too similar to its training question"}
    assert bench.table("evaluation_candidates").where("evaluation_status = 'complete'").count() == 2


def test_pilot_asks_only_its_scope(spark, root):
    settings = Settings(workers=1, pilot_size=2)
    store = Store(spark, f"{root}/pilot")
    generation.stage_contexts(store, corpus_rows(spark), "independent", settings)
    generation.ask_questions(store, questions, "independent", settings, pilot=True)
    assert store.table("contexts").where("question_status <> 'pending'").count() == 2


def test_revalidation(spark):
    saved = spark.createDataFrame([("a", "x  Y "), ("b", "x edited"), ("c", "z"), ("d", None)], "context_id string, context string")
    current = spark.createDataFrame([("a", " X y"), ("b", "x"), ("d", "")], "context_id string, context string")
    assert {r.context_id: r.kept for r in revalidated(saved, current).collect()} == {"a": True, "b": False, "c": False, "d": True}


def benchmark_file(spark, root, n=5):
    rows = spark.createDataFrame([([("user", f"q{k}"), ("assistant", f"r{k}")],) for k in range(n)], schemas.BENCHMARK_LINE)
    path = f"{root}/benchmark.jsonl"
    write_jsonl(rows.coalesce(1), path)
    return path


def test_scoring_and_resume(spark, root):
    benchmark = scoring.benchmark_questions(spark, benchmark_file(spark, root))
    assert [r.question for r in benchmark.orderBy("benchmark_index").collect()] == [f"q{k}" for k in range(5)]

    def flaky(request):
        if request["benchmark_index"] == 3:
            raise RuntimeError("no")
        return {"answer": "A" + request["question"]}

    path = f"{root}/rag"
    with pytest.raises(CheckFailed, match="3: error:no"):
        scoring.answer_by_service(benchmark, flaky, "rag", path, workers=2, retries=2, wait_s=0)
    done = scoring.answer_by_service(benchmark, lambda r: {"answer": "B"}, "rag", path, workers=2, retries=1)
    assert [r.answer for r in done.collect()] == ["Aq0", "Aq1", "Aq2", "B", "Aq4"] and scoring.complete(done, 5)
    local = scoring.answer_in_order(benchmark, lambda: lambda texts: [t.upper() for t in texts], "base", f"{root}/base", batch=2)
    assert [r.answer for r in local.collect()] == [f"Q{k}" for k in range(5)]

    def mark(request):
        return {"correctness": 5 if request["candidate"] == "base" else 3, "completeness": 4, "unsupported_claims": 0, "rationale": "r"}

    scores = scoring.judge(done, mark, f"{root}/s1", wait_s=0).unionByName(scoring.judge(local, mark, f"{root}/s2", wait_s=0))
    ranked = scoring.compare(scores).collect()
    assert [(r.candidate, r.rank, r.correctness_mean) for r in ranked] == [("base", 1, 5.0), ("rag", 2, 3.0)]
    with pytest.raises(CheckFailed, match="schema"):
        scoring.judge(done, lambda r: {"correctness": 9, "completeness": 4, "unsupported_claims": 0, "rationale": "r"}, f"{root}/s3", retries=1)


def test_ranking_ties(spark):
    kind = "candidate string, correctness_mean double, completeness_mean double, unsupported_claims_total long, latency_ms_mean double"
    rows = [("e", 4.0, 3.0, 1, 9.0), ("d", 4.0, 3.0, 1, 9.0), ("c", 4.0, 3.0, 1, 8.0), ("b", 4.0, 3.0, 0, 99.0), ("a", 4.0, 4.0, 5, 99.0), ("z", 5.0, 1.0, 9, 99.0)]
    assert [r.candidate for r in evaluation.ranking(spark.createDataFrame(rows, kind)).collect()] == ["z", "a", "b", "c", "d", "e"]
    with pytest.raises(CheckFailed):
        evaluation.winner(spark.createDataFrame([], kind))


def test_files(spark, root):
    path = benchmark_file(spark, root)
    with pytest.raises(FileExistsError):
        write_jsonl(spark.range(1), path)
    import hashlib

    meta = file_metadata(spark, path)
    assert meta["rows"] == 5 and meta["sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert read_jsonl(spark, f"{root}/none", schemas.ANSWER).count() == 0
    with pytest.raises(MissingInput):
        read_jsonl(spark, f"{root}/none", schemas.ANSWER, optional=False)
    with open(f"{root}/bad.jsonl", "w") as file:
        file.write('{"messages": []}\n\n   \n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        read_jsonl(spark, f"{root}/bad.jsonl", schemas.BENCHMARK_LINE).collect()
    assert read_numbered_jsonl(spark, path, schemas.BENCHMARK_LINE, 2).count() == 2
    assert union_of({"x": spark.range(2), "y": spark.range(3)}, "db").groupBy("db").count().count() == 2
    with pytest.raises(ValueError):
        union_of({}, "db")


def test_sqlite_source(spark, root):
    path = f"{root}/corpus.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE docs (doc_id TEXT, document_version TEXT, category TEXT, source_last_updated TEXT, source_content_hash TEXT, status TEXT)")
        db.execute("CREATE TABLE parts (doc_id TEXT, document_version TEXT, chunk_id TEXT, position INTEGER, chunk_text TEXT, heading_path TEXT, source_title TEXT, source_url TEXT)")
        db.executemany("INSERT INTO docs VALUES (?, 'v', 'c', NULL, 'h', ?)", [(f"d{k}", "ok" if k % 2 else "gone") for k in range(10)])
        db.executemany("INSERT INTO parts VALUES (?, 'v', ?, ?, 't', NULL, 'T', 'u')", [(f"d{k}", f"d{k}-{p}", p) for k in range(10) for p in range(3)])
    rows = load_corpus(spark, path, "docs", "parts")
    assert rows.count() == 15
    assert read_sqlite(spark, path, "parts", schemas.CHUNKS).where("position = 1").count() == 10
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, f"{root}/none", "parts", schemas.CHUNKS)


def test_config(root, tmp_path):
    text = "experiment_name: e\nrun_name: r\ndataset_version: v001\nbase_model: m\nseed: 7\nlora:\n  rank: 16\n  drop: 0.05\n  fast: true\n  none: null\n# note\nevaluation_experiment_name: ev\n"
    path = tmp_path / "c.yaml"
    path.write_text(text)
    assert simple_yaml(text)["lora"] == {"rank": 16, "drop": 0.05, "fast": True, "none": None}
    config = load_config(path)
    assert flatten(config)["lora.rank"] == 16 and "lora.none" not in flatten(config)
    assert experiment_name(config, "evaluation") == "ev" and experiment_name(config, "training") == "e"
    path.write_text("run_name: r\n")
    with pytest.raises(ValueError, match="lacks"):
        load_config(path)
    (tmp_path / "run/adapter").mkdir(parents=True)
    (tmp_path / "run/adapter/adapter_config.json").write_text("{}")
    (tmp_path / "run/checkpoints/checkpoint-5").mkdir(parents=True)
    assert [n for n, _ in candidates(tmp_path / "run", "m")] == ["base", "adapter"]
    own = Settings.from_env({"TESSERA_WORKERS": "3", "TESSERA_DATABASES": "a, b", "TESSERA_CHARS_PER_TOKEN": "3.5"})
    assert (own.workers, own.databases, own.chars_per_token) == (3, ["a", "b"], 3.5)


def test_services(spark):
    calls = []

    def third(request):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("later")
        return {"ok": 1}

    assert with_retries(third, 3, 0)({}) == {"ok": 1}
    with pytest.raises(RuntimeError, match="doesn't answer"):
        preflight(lambda r: 1 / 0, {})
    assert called(spark.createDataFrame([], "a int"), third).count() == 0


def test_run_log(spark, root):
    log = RunLog(spark, f"{root}/runs", {"experiment_name": "e", "run_name": "r", "dataset_version": "v", "base_model": "m", "seed": 1, "x": {"y": 2.5}})
    log.start()
    log.metrics({"loss": 0.5, "note": "text", "flag": True}, 3)
    log.finish(dataset="d.json")
    rows = spark.read.parquet(f"{root}/runs").collect()
    assert {(r.name, r.value) for r in rows if r.kind == "metric"} == {("loss", "0.5")}
    assert ("x.y", "2.5") in {(r.name, r.value) for r in rows if r.kind == "param"}


def test_stream_into_the_store(spark, root):
    spark.createDataFrame([("c1", "{}"), ("c2", "{}")], "context_id string, payload string").write.parquet(f"{root}/in")
    store = Store(spark, f"{root}/store")
    read = lambda: spark.readStream.schema("context_id string, payload string").parquet(f"{root}/in")
    stage_stream(read(), store, "contexts", f"{root}/cp").awaitTermination()
    spark.createDataFrame([("c2", "{}"), ("c3", "{}")], "context_id string, payload string").write.mode("append").parquet(f"{root}/in")
    stage_stream(read(), store, "contexts", f"{root}/cp").awaitTermination()
    assert sorted(r.context_id for r in store.table("contexts").collect()) == ["c1", "c2", "c3"]


@pytest.mark.parametrize("order", [["id"], None])
def test_no_task_reads_a_whole_export(spark, root, order):
    """Parts are written by many tasks, and the one file has them in order."""
    rows = spark.range(0, 20_000, 1, 13).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"))
    tracker, group = spark.sparkContext.statusTracker(), f"export-{order}"
    spark.sparkContext.setJobGroup(group, group)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        write_jsonl(rows.repartition(7) if order else rows, f"{root}/export.jsonl", order=order)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext._jsc.clearJobGroup()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    last = max(s for j in jobs for s in j.stageIds)
    assert tracker.getStageInfo(last).numTasks > 1
    lines = [json.loads(line) for line in open(f"{root}/export.jsonl")]
    assert [r["id"] for r in lines] == list(range(20_000))
    assert [n for n in os.listdir(root) if not n.startswith(".")] == ["export.jsonl"]


def test_empty_exports_are_empty_files(spark, root):
    write_jsonl(spark.range(0), f"{root}/empty.jsonl", order=["id"])
    meta = file_metadata(spark, f"{root}/empty.jsonl")
    assert meta["rows"] == 0 and os.path.getsize(f"{root}/empty.jsonl") == 0
