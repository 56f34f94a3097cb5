from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import BLOB_SCHEMA
from tessera.llm import dedup_docs, rolling, substring_dedup, suffix_dedup

from .helpers import EDGES, corpus, empty, frame, passage, with_null_id


def brute(items, width, join):
    """(length, removed, kept) of each sequence; windows are judged on the input, in order."""
    seen, out = set(), []
    for item in items:
        gone = [False] * len(item)
        for k in range(len(item) - width + 1):
            window = tuple(item[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out.append((len(item), sum(gone), join([x for x, g in zip(item, gone) if not g]), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize(("seed", "width"), [(1, 100), (2, 100), (3, 64), (4, 131)])
def test_suffixes(spark, seed, width):
    texts = EDGES + corpus(seed)
    expected = brute([list((t or "").encode()) for t in texts], width, bytes)
    rows = suffix_dedup.digests(suffix_dedup.suffix_dedup(frame(spark, texts), width=width)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.kept_sha256, r.n_spans) for r in rows] == [(n, gone, sha(kept), spans) for n, gone, kept, spans in expected]


def test_suffixes_over_chunks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    texts = corpus(5) + ["ab" * 900, "q" * 2000]
    expected = brute([list(t.encode()) for t in texts], 100, bytes)
    # In this process, so that the small limits hold: what is settled early has to be right.
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["doc", "version", "text"])
    rows = [r for b in suffix_dedup.first_digit([batch], 100, 4, 4) for r in pa.Table.from_batches([b]).to_pylist()]
    rows.sort(key=lambda r: (r["kind"], r["bucket"]))
    rows = [r for b in suffix_dedup.first_groups([pa.RecordBatch.from_pylist(rows)], 4) for r in pa.Table.from_batches([b]).to_pylist()]
    marks = [dedup_docs.unpack_all([r["data"] for r in rows if r["kind"] == k], dedup_docs.MARK) for k in (suffix_dedup.COVERED, suffix_dedup.OPEN)]
    gone = {}
    for m in marks[0]:
        gone.setdefault(int(m["doc"]), set()).update(range(int(m["start"]), int(m["start"]) + int(m["n"]) + 99))
    assert sum(map(len, marks)) and all(len(v) <= expected[k][1] for k, v in gone.items())


def test_windows_are_taken_in_turns(spark, monkeypatch):
    width, texts = 64, corpus(8)
    docs = pa.table({"bucket": pa.array([0] * len(texts), pa.int32()), "doc": pa.array(range(len(texts))), "version": pa.array([0] * len(texts)), "text": texts})

    def removed(windows, size):
        monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
        monkeypatch.setattr(suffix_dedup, "TEXTS", size)
        table = lambda found: pa.Table.from_batches(list(found), schema=BLOB_SCHEMA).sort_by([("kind", "ascending"), ("bucket", "ascending")])
        rows = table(suffix_dedup.first_digit(docs.to_batches(), width, 3, 1))
        rows = table(suffix_dedup.first_groups(rows.to_batches(), 1))
        rows = suffix_dedup.second_digit(docs, rows, width, 3).sort_by([("kind", "ascending"), ("bucket", "ascending")])
        rows = table(suffix_dedup.last_groups(rows.to_batches(), width, 1))
        bucket = dedup_docs.Bucket(docs)
        runs = dedup_docs.covered_runs(bucket, dedup_docs.unpack_all(rows["data"].to_pylist(), dedup_docs.MARK), width)
        return [sum(b - a for a, b in runs.get(k, [])) for k in range(len(texts))]

    expected = [e[1] for e in brute([list(t.encode()) for t in texts], width, bytes)]
    assert removed(1 << 20, 4 << 20) == expected and removed(50, 100) == expected


@pytest.mark.parametrize("seed", [6, 7])
def test_words(spark, seed):
    texts = EDGES + corpus(seed)
    expected = brute([(t or "").encode().split() for t in texts], 20, b" ".join)
    rows = substring_dedup.digests(substring_dedup.substring_dedup(frame(spark, texts))).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == [(n, gone, sha(kept)) for n, gone, kept, _ in expected]


@pytest.mark.parametrize("run", [lambda d: suffix_dedup.digests(suffix_dedup.suffix_dedup(d)), lambda d: substring_dedup.digests(substring_dedup.substring_dedup(d))])
def test_ids_that_are_null_or_shared(spark, run):
    assert run(empty(spark)).count() == 0
    rows = run(with_null_id(spark)).collect()
    assert len(rows) == 4
    null = next(r for r in rows if r.doc_id is None)
    twins = [r for r in rows if r.doc_id == 1 and r.n_removed]
    # The null id comes first and keeps its first period; the equal rows are one document and lose all.
    assert len(twins) == 2 and twins[0] == twins[1] and null.n_removed < twins[0].n_removed


@pytest.mark.parametrize("parts", [1, 4])
def test_equal_rows_keep_their_first_copy(spark, parts):
    """Twins without an earlier copy, in one chunk and in several, alone and with documents that share a part."""
    import random

    rng = random.Random(11)
    a, b, c = (passage(rng, 60) for _ in range(3))
    texts = {1: a, 2: a[:200] + b, 3: c[:150] + a[100:], 4: "loop " * 60}
    rows = [(k, texts[k]) for k in (1, 2, 3, 4, 1, 2, 3, 4, 2)]
    expected = dict(zip(texts, brute([list(t.encode()) for t in texts.values()], 100, bytes)))
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert len(found) == len(rows) and expected[1][1] == 0
    assert all(bytes(r.kept) == expected[r.doc_id][2] for r in found)


def test_extra_columns_come_along(spark):
    rows = spark.createDataFrame([(0, "t" * 150, "en", 5), (1, "t" * 150, None, None)], "doc_id long, text string, lang string, n_chars long")
    found = suffix_dedup.suffix_dedup(rows, keep=("lang", "n_chars")).orderBy("doc_id").collect()
    assert [(r.lang, r.n_chars) for r in found] == [("en", 5), (None, None)]
    assert bytes(found[1].kept) == b"" and [tuple(s) for s in found[1].spans] == [(0, 150)]
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(rows, width=20)


def test_cut_characters_are_left_out(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(bytearray("aé".encode()[:2] + b"b\xa9c"),)], "kept binary")
    assert rows.select(suffix_dedup.readable(F.col("kept")).alias("t")).first().t == "abc"


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=60), st.integers(1, 9))
def test_span_hashes(data, length):
    array = np.frombuffer(data, np.uint8)
    if len(array) < length:
        return
    hashes = rolling.byte_spans(array).all(length)
    first = {}
    for k, h in enumerate(hashes.tolist()):
        assert first.setdefault(data[k : k + length], h) == h
    assert len(set(first.values())) == len(first)


def test_long_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, 12345]
    found = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v").alias("h")).collect()]
    assert rolling.long_hash(np.array(values)).tolist() == found


def test_columns_pack(spark):
    marks = np.zeros(5, dedup_docs.MARK)
    marks["doc"], marks["start"], marks["n"] = [5, -3, 2**62, 0, 7], [1, 2, 3, 4, 5], 9
    assert (rolling.unpack_columns(rolling.pack_columns(marks), dedup_docs.MARK)[0] == marks).all()


def test_merged_sketches_find_every_repeat():
    """Sketches of buckets, added up segment by segment: each window that occurs twice is estimated again, few others are."""
    rng = random.Random(4)
    texts = [" ".join(str(rng.randint(0, 9)) for _ in range(300)) for _ in range(6)]
    texts[5] += " " + texts[0][:200]
    buckets = [pa.table({"bucket": [b, b], "doc": [2 * b, 2 * b + 1], "version": [0, 0], "text": texts[2 * b : 2 * b + 2]}) for b in range(3)]
    sent = [r for b in buckets for r in substring_dedup.sketch(b, 8, 2).to_pylist()]
    sent.sort(key=lambda r: r["bucket"])
    merged = substring_dedup.merge_sketches(iter(substring_dedup.blob_table([(r["bucket"], 0, r["data"]) for r in sent]).to_batches()))
    replies = [r for batch in merged for r in batch.to_pylist()]
    windows = [substring_dedup.Windows(dedup_docs.Bucket(b), 8) for b in buckets]
    every = [(int(h), int(w)) for k in windows for h, w in zip(k.high, k.low)]
    for number, k in enumerate(windows):
        found = set(substring_dedup.estimated_again(k, [r["data"] for r in replies if r["bucket"] == number], 2).tolist())
        true = {j for j, d in enumerate(zip(k.high.tolist(), k.low.tolist())) if every.count(d) > 1}
        assert true <= found and len(found) <= len(true) + 5


def test_count_min_never_underestimates():
    rng = np.random.default_rng(1)
    counters = substring_dedup.CountMin(width_bits=6)
    digests = rng.integers(0, 1 << 28, 500).astype(np.uint32)
    values, counts = np.unique(digests, return_counts=True)
    counters.merge(values, counts > 1)
    counters.merge(values[:50], np.zeros(50))
    true = np.minimum(counts, 2)
    true[:50] += 1
    assert (counters.estimate(values) >= true).all()
