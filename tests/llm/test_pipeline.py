from __future__ import annotations

import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import public_tokenizers

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_near import plain_fingerprint, reachable  # noqa: E402
from .test_quality import junk, prose  # noqa: E402
from .test_repeats import brute  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    texts = [junk(rng, k % 4, rng.randint(60, 120)) if k % 6 == 0 else prose(rng, rng.randint(60, 160)) for k in range(150)]
    texts += [texts[1], texts[2] + " end", prose(rng, 80) + " " + texts[3][:400], None, "", "short"]
    rows = [(k, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, tables))
        results.append(docs)
    for rows in results[:-1]:
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    judged = {r.doc_id for r in results[0].collect()}
    clean = {k for k in range(150) if k % 6}
    assert len(clean - judged) <= 2 and len(judged & set(range(0, 150, 6))) <= 1
    ruled = {r.doc_id: r.text for r in results[1].collect()}
    assert len(clean & judged - set(ruled)) <= 2 and set(ruled) <= judged and not {153, 154, 155} & set(ruled)
    prints = {k: plain_fingerprint(t) for k, t in ruled.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    group = reachable(links, list(prints))
    single = {r.doc_id: r for r in results[2].collect()}
    assert set(single) == {k for k, first in group.items() if k == first} and 150 not in single
    ids = sorted(single)
    expected = dict(zip(ids, brute([list(texts[k].encode()) for k in ids], 100, bytes)))
    cut = {r.doc_id: r for r in results[3].collect()}
    assert {k: r.text.encode() for k, r in cut.items()} == {k: e[2] for k, e in expected.items() if e[2]}
    assert all(r.n_chars == len(r.text) for r in cut.values())
    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int)
    for r in results[4].collect():
        pieces[r.doc_id] += r.length
    assert pieces == {k: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in cut.items()}


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def near_dedup(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)


def test_near_copies_of_four_fifths_go(spark):
    """Copies at a five-word similarity of just 0.8 and just less, and a chain of which only neighbours are near."""
    rng = random.Random(5)
    texts, expected, k = [], [], 0
    for pair in range(40):
        words = [f"w{pair}x{n}" for n in range(104)]
        # 100 shingles; 4 other words at the end leave 96 of 104, 11 leave 89 of 111 and 12 leave 88 of 112.
        other = {0: 4, 1: 11, 2: 12}[pair % 3]
        texts += [(k, " ".join(words)), (k + 1, " ".join(words[:-other] + [f"v{pair}x{n}" for n in range(other)]))]
        expected += [k] if pair % 3 < 2 else [k, k + 1]
        k += 2
    chain = [f"c{n}" for n in range(240)]
    texts += [(1000 + n, " ".join(chain[8 * n : 8 * n + 104])) for n in range(12)]
    rng.shuffle(texts)
    assert sorted(i for i, _ in near_dedup(spark, texts)) == [*expected, 1000]


def test_rows_that_share_an_id_go_only_as_copies(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (7, a)]
    assert near_dedup(spark, rows) == sorted([(7, a), (None, b), (5, c), (5, d)], key=repr)
