from __future__ import annotations

import hashlib
import random

import pytest

from tessera.operators import checks, sampling, staging
from tessera.operators.staging import Store


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_store_replays_and_replaces(spark, root):
    store = Store(spark, root)
    store.create()
    store.create()
    rows = spark.createDataFrame([("c1", "{}"), ("c2", "{}"), ("c1", "{}")], "context_id string, payload string")
    store.insert("contexts", rows)
    store.insert("contexts", rows)
    assert sorted(r.context_id for r in store.table("contexts").collect()) == ["c1", "c2"]
    store.mark("contexts", spark.createDataFrame([("c1", "complete"), ("zz", "complete")], "context_id string, question_status string"))
    store.mark("contexts", spark.createDataFrame([("c1", "error:x")], "context_id string, question_status string"))
    assert {r.context_id: r.question_status for r in store.table("contexts").collect()} == {"c1": "error:x", "c2": "pending"}
    questions = spark.createDataFrame([("c1", "q", "{}"), ("c1", "q", "{}"), ("c2", "q", "{}")], "context_id string, question string, payload string")
    store.insert("questions", questions, ["context_id", "question"])
    store.insert("questions", questions, ["context_id", "question"])
    assert store.table("questions").count() == 2
    for payload in ("one", "two"):
        store.put("examples", spark.createDataFrame([(1, payload, 1, None)], "question_id long, payload string, accepted int, rejection_reason string"))
    assert [r.payload for r in store.table("examples").collect()] == ["two"]
    store.compact("examples")
    assert store.log("examples").count() == 1 and store.table("examples").first().payload == "two"


def test_freeze_once(spark, root):
    store = Store(spark, root)
    store.create()
    make = lambda k: spark.createDataFrame([(f"t{k}", "c", "{}")], "training_example_id string, category string, payload string")
    store.freeze("evaluation_candidates", make(1))
    assert [r.training_example_id for r in store.freeze("evaluation_candidates", make(2)).collect()] == ["t1"]


def test_pilot_scope(spark):
    contexts = spark.createDataFrame([("a", "complete"), ("b", "pending"), ("c", "complete"), ("d", "error:x")], "context_id string, question_status string")
    questions = spark.createDataFrame([("a", "complete"), ("c", "pending"), ("c", "pending"), ("d", "error:y")], "context_id string, answer_status string")
    assert [r.context_id for r in staging.pilot_scope(contexts, questions, 5).collect()] == ["b", "c"]


def test_round_robin_equals_the_loop(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(f"p{k}", rng.choice("aaabc")) for k in range(40)]
        size = rng.randint(1, 40)
        groups = {c: sorted((p for p, x in rows if x == c), key=sha) for c in sorted({x for _, x in rows})}
        expected = []
        while len(expected) < size:
            for own in groups.values():
                if own and len(expected) < size:
                    expected.append(own.pop(0))
        found = sampling.round_robin(spark.createDataFrame(rows, "page string, category string"), size, "page").orderBy("selection_index").collect()
        assert [r.page for r in found] == expected


def test_benchmark_selection(spark):
    rows = spark.createDataFrame([(f"t{k}", f"p{k % 6}", "c") for k in range(30)], "training_example_id string, source_page_id string, category string")
    chosen = sampling.benchmark_selection(rows, 6).collect()
    assert {r.source_page_id for r in chosen} == {f"p{k}" for k in range(6)}
    assert all(r.training_example_id == min((f"t{k}" for k in range(30) if k % 6 == int(r.source_page_id[1])), key=sha) for r in chosen)
    with pytest.raises(checks.CheckFailed):
        sampling.benchmark_selection(rows, 7)
    with pytest.raises(ValueError):
        sampling.benchmark_selection(rows, 0)
    assert sampling.seeded_subset(rows, 100, 1, "training_example_id").count() == 30


def test_checks(spark):
    training = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "training_example_id string")
    make = lambda *rows: spark.createDataFrame(rows, "training_example_id string, source_page_id string")
    checks.require_benchmark(make(("t1", "p1"), ("t2", "p2")), training, 2)
    for rows in ([("t1", "p1")], [("t1", "p1"), ("t1", "p2")], [("t1", "p1"), ("tx", "p2")], [("t1", "p1"), ("t2", "p1")]):
        with pytest.raises(checks.CheckFailed):
            checks.require_benchmark(make(*rows), training, 2)
    contexts = lambda s: spark.createDataFrame([(s,)], "question_status string")
    answers = lambda s: spark.createDataFrame([(s,)], "answer_status string")
    checks.require_finished(contexts("error:x"), answers("complete"), "x")
    for c, a in (("pending", "complete"), ("complete", "pending")):
        with pytest.raises(checks.CheckFailed):
            checks.require_finished(contexts(c), answers(a), "x")
    with pytest.raises(ValueError):
        checks.one_of("mode", "x", {"full", "pilot"})
    with pytest.raises(ValueError):
        checks.positive(size=0)
    with pytest.raises(checks.CheckFailed):
        checks.not_empty(training.where("false"), "rows")


def test_message_validity(spark):
    kind = "k int, messages array<struct<role:string,content:string>>"
    rows = [(0, [("user", "q"), ("assistant", "a")]), (1, [("user", "q")]), (2, [("user", "q"), ("assistant", "a"), ("user", "b")]), (3, [("assistant", "q"), ("user", "a")]), (4, [("user", "  "), ("assistant", "a")]), (5, None), (6, [("user", "q"), ("assistant", None)])]
    frame = spark.createDataFrame(rows, kind)
    assert [r.k for r in frame.where(checks.valid_messages()).collect()] == [0]
    with pytest.raises(checks.CheckFailed):
        checks.require_valid_messages(frame)


def test_resume_prefix(spark):
    benchmark = spark.createDataFrame([(k, f"q{k}") for k in range(4)], "benchmark_index int, question string")
    make = lambda *rows: spark.createDataFrame(rows, benchmark.schema)
    assert checks.require_prefix(make((0, "q0"), (1, "q1")), benchmark) == 2
    assert checks.require_prefix(benchmark.where("false"), benchmark) == 0
    for rows in ([(0, "q0"), (2, "q2")], [(0, "q0"), (1, "other")], [(0, "q0"), (0, "q0")], [(k, f"q{k}") for k in range(5)]):
        with pytest.raises(checks.CheckFailed):
            checks.require_prefix(make(*rows), benchmark)
    assert checks.require_saved_subset(make((3, "q3"), (1, "q1")), benchmark) == 2
