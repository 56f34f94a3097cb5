from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import contexts, corpus

COLUMNS = "doc_id string, document_version string, category string, chunk_id string, position int, chunk_text string, heading_path string, source_title string, source_url string"


def chunk(doc, position, text, heading="H", title="T"):
    return (doc, "v", "c", f"{doc}-{position}", position, text, heading, title, "u")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def random_rows(seed, pages=25):
    rng = random.Random(seed)
    return [chunk(f"d{d}", p, "x" * rng.randint(1, 60), f"h{rng.randint(0, 2)}", "t" * rng.randint(1, 4)) for d in range(pages) for p in range(rng.randint(1, 14))]


def adjacent_model(rows, budget):
    out = {}
    for page in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == page), key=lambda r: r[4])
        for k, r in enumerate(own):
            used, chosen = len(r[5]), {k}
            for n in (k - 1, k + 1):
                if 0 <= n < len(own) and used + 2 + len(own[n][5]) <= budget:
                    used += 2 + len(own[n][5])
                    chosen.add(n)
            out[f"{r[0]}:v:{r[3]}"] = [own[n][3] for n in sorted(chosen)]
    return out


def windows_model(rows, budget):
    """Sections first, then windows: a plain statement of the packing rule."""
    out = {}
    cost = lambda part: len("PAGE TITLE: ") + len(part[0][7]) + 2 + sum(len(f"SECTION: {r[6]}\n{r[5]}") for r in part) + 2 * (len(part) - 1)
    for page in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == page), key=lambda r: r[4])
        if cost(own) <= budget:
            out[f"{page}:v:page-aware-v2"] = [r[3] for r in own]
            continue
        sections = []
        for r in own:
            if sections and sections[-1][-1][6] == r[6]:
                sections[-1].append(r)
            else:
                sections.append([r])
        windows, open_ = [], []
        for section in sections:
            if open_ and cost(open_ + section) > budget:
                windows.append(open_)
                open_ = []
            for part in [section] if cost(section) <= budget else [[r] for r in section]:
                if open_ and cost(open_ + part) > budget:
                    windows.append(open_)
                    open_ = []
                open_ = open_ + part
        windows.append(open_)
        out |= {f"{page}:v:page-aware-v2:window-{k:03d}": [r[3] for r in w] for k, w in enumerate(windows, 1)}
    return out


@pytest.mark.parametrize("budget", [40, 90])
def test_adjacent_contexts(spark, budget):
    rows = random_rows(budget)
    found = {r.context_id: r.chunk_ids for r in contexts.adjacent_contexts(frame(spark, rows), budget).collect()}
    assert found == adjacent_model(rows, budget)


@pytest.mark.parametrize("tokens", [25, 40, 70])
def test_page_contexts(spark, tokens):
    rows = random_rows(tokens)
    built = contexts.page_contexts(frame(spark, rows), tokens).collect()
    assert {r.context_id: r.chunk_ids for r in built} == windows_model(rows, 4 * tokens)
    assert all(r.estimated_context_tokens == -(-len(r.context) // 4) <= tokens for r in built)
    assert set(built[0].asDict()) == {f.name for f in schemas.PAGE_CONTEXT.fields}


def test_oversized_chunk_fails(spark):
    rows = [chunk("d", 0, "x" * 500), chunk("d", 1, "y")]
    with pytest.raises(Exception, match="exceeds the budget"):
        contexts.page_contexts(frame(spark, rows), 30).collect()
    with pytest.raises(ValueError):
        contexts.page_contexts(frame(spark, rows), 0)


def test_sections_that_come_again_are_new(spark):
    rows = [chunk("d", k, "t", h) for k, h in enumerate(["a", "a", "b", "a", None, None])]
    numbered = contexts.sections(frame(spark, rows), "heading_path").orderBy("position").collect()
    assert [r.section for r in numbered] == [1, 1, 2, 3, 4, 4]


def test_eligible_chunks(spark):
    long = "Some words " * 30
    rows = [chunk("a", 0, "short"), chunk("a", 1, f"  {long} "), chunk("b", 0, long.upper().replace(" ", " ")), chunk("b", 1, None), chunk("b", 2, "z" * 239), chunk("b", 3, "z" * 240), chunk("c", 0, "short" * 60), chunk("c", 0, "short" * 60)]
    kept = corpus.eligible_chunks(frame(spark, rows)).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position) for r in kept] == [("a", 1), ("b", 3), ("c", 0)]
    assert kept[0].chunk_text == long.strip()


def test_scan_and_manifest(spark):
    documents = spark.createDataFrame([("a", "v", "c", None, "h", "ok"), ("b", "v", "c", None, "h", "gone"), ("a", "w", "c", None, "h2", "ok")], schemas.DOCUMENTS)
    chunks = spark.createDataFrame([(d, v, f"{d}{v}{p}", p, "t", None, "T", "u") for d, v in (("a", "v"), ("a", "w"), ("b", "v"), ("x", "v")) for p in range(2)], schemas.CHUNKS)
    rows = corpus.active_chunks(documents, chunks)
    assert sorted((r.doc_id, r.document_version, r.position) for r in rows.collect()) == [("a", "v", 0), ("a", "v", 1), ("a", "w", 0), ("a", "w", 1)]
    one = corpus.source_manifest(rows).first()
    assert (one.document_count, one.chunk_count) == (2, 4)
    assert corpus.source_manifest(rows.repartition(7)).first() == one
    changed = rows.withColumn("source_content_hash", F.when(F.col("position") == 0, "other").otherwise(F.col("source_content_hash")))
    assert corpus.source_manifest(changed).first().manifest_sha256 != one.manifest_sha256
    assert corpus.source_manifest(rows.where("false")).first().chunk_count == 0
    names = ("doc_id", "document_version", "chunk_id", "source_content_hash")
    plain = [{c: r[c] for c in names} for r in rows.orderBy("doc_id", "document_version", "position").collect()]
    for some, own in ((rows, plain), (rows.where("false"), [])):
        assert corpus.portable_digest(some) == hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


@pytest.mark.parametrize("longest", [40, 400])
def test_a_long_page_waits_in_bounded_state(longest):
    """Rows of a page wait for no more than a budget of characters; windows are those of the whole page."""
    rng = random.Random(longest)
    rows = [chunk("d", p, "x" * rng.randint(1, 60), f"h{p // rng.randint(1, longest)}", "t" * rng.randint(1, 4)) for p in range(3000)]
    packer, most = contexts.Packer(200), 0
    for r in rows:
        packer.add((r[0], r[1]), b"k", 1, r[3], r[6], len("PAGE TITLE: ") + len(r[7]) + 2, len(f"SECTION: {r[6]}\n{r[5]}"))
        most = max(most, len(packer.waiting))
    packer.finish()
    expected = [k for k, (_, chunks) in enumerate(windows_model(rows, 200).items(), 1) for _ in chunks]
    assert [r[2] for r in packer.out[:-1]] == expected and packer.out[-1][-1] == 3000
    assert most <= 200 // len("SECTION: h\nx") + 1


def test_no_task_gathers_the_texts_of_a_page(spark, monkeypatch):
    """Only sizes are brought together by page: no window over a page, no text in what is numbered."""
    numbered = []
    monkeypatch.setattr(contexts, "number_windows", lambda rows, budget, f=contexts.number_windows: numbered.append(rows.columns) or f(rows, budget))
    built = contexts.page_contexts(frame(spark, random_rows(1)), 25)
    assert not {"rendered", "chunk_text", "title", "source_title"} & set(numbered[0])
    for query in (built, contexts.context_summary(built)):
        plan = query._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in plan if "Window [" in line and "[doc_id#" in line]


def test_rows_of_one_key_keep_their_texts(spark):
    """Rows that share their page, place and size, or everything, or have no place at all."""
    rows = [chunk("d", 0, t) for t in ("aa", "bb", "aa")] + [("d", None, "c", None, None, "cc", None, None, None)] * 2 + [(None, None, "c", "k", 1, "dd", "H", "T", "u")]
    built = contexts.page_contexts(frame(spark, rows), 30).collect()
    words = sorted(line for r in built for line in r.context.split("\n") if len(line) == 2)
    assert words == ["aa", "aa", "bb", "cc", "cc", "dd"]
    assert sorted(r.page_chunk_count for r in built) == [1, 2, 3]
