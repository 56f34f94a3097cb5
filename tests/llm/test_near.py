from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from tessera.llm import embedding_dedup, simhash_dedup
from tessera.llm.components import components

from .helpers import EDGES, corpus, empty, frame, with_null_id


def reachable(links, nodes):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 40)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(500, k) for k in range(300, 360)] + [(7, 7)]
    nodes = {x for a, b in links for x in (a, b) if a != b}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == reachable([x for x in links if x[0] != x[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_groups(spark):
    texts = EDGES + corpus(3)
    rows = simhash_dedup.digests(simhash_dedup.simhash_dedup(frame(spark, texts))).orderBy("doc_id").collect()
    prints = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in rows} == reachable(links, range(len(texts)))
    assert simhash_dedup.simhash_dedup(empty(spark)).count() == 0
    odd = simhash_dedup.simhash_dedup(with_null_id(spark)).collect()
    assert len(odd) == 4 and all(r.component_id == 1 for r in odd)


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("large", [512, 4])
def test_no_link_is_lost(spark, monkeypatch, large):
    """Pairs at every distance up to six, in dense clusters and alone; both ways of joining a key's fingerprints."""
    monkeypatch.setattr(simhash_dedup, "LARGE", large)
    rng = random.Random(large)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values |= {x, flipped(rng, x, rng.randint(1, 6))}
    center = rng.getrandbits(64)
    values |= {flipped(rng, center, rng.randint(0, 3)) for _ in range(150)}
    x = np.array(sorted(values), np.uint64)
    records = np.empty(25 * len(x), simhash_dedup.KEYED)
    records["key"] = np.concatenate(list(simhash_dedup.ring_keys(x)))
    records["fingerprint"] = np.tile(x, 25)
    forest = simhash_dedup.Forest()
    simhash_dedup.linked(records, forest, 4)
    assert all((a ^ b).bit_count() <= 64 for a, b in forest.links)
    true = [(int(a), int(b)) for a in x for b in x if a < b and int(a ^ b).bit_count() <= 4]
    nodes = [int(v) for v in x]
    assert reachable(forest.links, nodes) == reachable(true, nodes)


@pytest.mark.parametrize("at_once", [1 << 13, 1 << 16])
def test_passes_over_a_large_key_lose_no_link(at_once):
    rng = random.Random(at_once)
    values = {rng.getrandbits(12) << 26 for _ in range(40)}
    values |= {flipped(rng, x, rng.randint(1, 5)) for x in list(values)}
    x = np.array(sorted(values), np.uint64)
    forest = simhash_dedup.Forest()
    simhash_dedup.link_large(x, forest, at_once)
    true = [(int(a), int(b)) for a in x for b in x if a < b and int(a ^ b).bit_count() <= 4]
    nodes = [int(v) for v in x]
    assert reachable(forest.links, nodes) == reachable(true, nodes)


def test_ring_condition_holds_for_all_near_pairs():
    rng = random.Random(9)
    near = np.array([flipped(rng, 0, rng.randint(0, 4)) for _ in range(4000)], np.uint64)
    assert simhash_dedup.in_ring(near).all()
    far = np.array([flipped(rng, 0, 20) for _ in range(4000)], np.uint64)
    assert simhash_dedup.in_ring(far).mean() < 0.01
    for difference in near[:300]:
        x = np.array([rng.getrandbits(64)], np.uint64)
        keys = [(int(a[0]), int(b[0])) for a, b in zip(simhash_dedup.ring_keys(x), simhash_dedup.ring_keys(x ^ difference))]
        assert any(a == b for a, b in keys)


def clusters(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n // 6, n)] + rng.normal(size=(n, dim)) * 0.06
    rows = np.concatenate([base, near, base[:20], 3 * base[20:30]]).astype(np.float32)
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in r] if r is not None else None, "x") for k, r in enumerate(rows)], "vec_id long, embedding array<float>, node string")


def test_embeddings(spark):
    rows = clusters(1)
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = embedding_dedup.embedding_dedup(vector_frame(spark, rows)).orderBy("vec_id").collect()
    links = np.array([r.n_links for r in found])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum()
    group = reachable(list(zip(*np.nonzero(np.triu(near)))), range(len(rows)))
    assert np.mean([r.component_id == group[r.vec_id] for r in found]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_unusable_vectors(spark):
    good = [1.0, 0.0, 0.0, 0.0]
    rows = [good, [2.0, 0.0, 0.0, 0.0], good, None, [0.0] * 4, [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 0.0], [], [0.0, 1.0, 0.0, 0.0]]
    frame_ = vector_frame(spark, rows).union(spark.createDataFrame([(None, good, "x"), (20, [1.0, None, 0.0, 0.0], "x")], "vec_id long, embedding array<float>, node string"))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(frame_).collect()}
    assert found[0] == (2, 0, True) and found[1] == (2, 0, False) and found[2] == (2, 0, False) and found[9] == (0, 9, True)
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 20)) and found[None] == (0, None, False)
    nothing = vector_frame(spark, [None, [0.0]])
    assert [r.n_links for r in embedding_dedup.embedding_dedup(nothing).collect()] == [0, 0]
    assert embedding_dedup.embedding_dedup(vector_frame(spark, []).where("false")).count() == 0


def test_shared_vector_ids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(rows).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 8)
    rows = clusters(2, 120)
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    found = embedding_dedup.embedding_dedup(vector_frame(spark, rows)).orderBy("vec_id").collect()
    assert sum(r.n_links for r in found) >= 0.9 * (near.sum() - len(rows))


def test_visits_are_nearest_first():
    rng = np.random.default_rng(3)
    x = embedding_dedup.units(rng.normal(size=(200, 8)))
    index = embedding_dedup.MultiIndex(x, 2000, 0.9)
    cost = np.concatenate([[(a + b).ravel()] for a, b in zip(embedding_dedup.distances(x[:, :4], index.words[0])[:, :, None], embedding_dedup.distances(x[:, 4:], index.words[1])[:, None, :])])
    visits = min(6, index.size**2)
    order = index.order(x, visits)
    assert np.allclose(np.take_along_axis(cost, order, 1), np.sort(cost, axis=1)[:, :visits])


def test_visits_hold_for_pairs_at_the_limit():
    """A third of the rows are near copies of one vector; the visits have to find links of small groups at the limit too."""
    rng = np.random.default_rng(4)
    n, dim, limit = 9000, 64, 0.9
    hot = embedding_dedup.units(rng.normal(size=(1, dim)) + 0.001 * rng.normal(size=(n // 3, dim)))
    x = embedding_dedup.units(rng.normal(size=(n // 3, dim)))
    noise = rng.normal(size=x.shape)
    noise = embedding_dedup.units(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    y = 0.903 * x + np.sqrt(1 - 0.903**2) * noise
    rows = np.concatenate([hot, x, y])
    sample = rows[rng.permutation(n)[:2000]]
    index = embedding_dedup.MultiIndex(sample, n, limit)
    one = (index.order(x, index.visits) == index.order(y, 1)).any(axis=1)
    two = (index.order(y, index.visits) == index.order(x, 1)).any(axis=1)
    assert (one | two).mean() >= 0.99


@pytest.mark.parametrize("part", [1024, 8])
def test_passes_over_buckets_lose_no_link(spark, monkeypatch, part):
    """Passes that move little at once give what one pass gives; large cells too."""
    rows = clusters(5, 400)
    plain = embedding_dedup.embedding_dedup(vector_frame(spark, rows)).orderBy("vec_id").collect()
    monkeypatch.setattr(embedding_dedup, "PART", part)
    monkeypatch.setattr(embedding_dedup, "PASS_BYTES", 1)
    written = []
    monkeypatch.setattr(embedding_dedup, "materialize", lambda df, f=embedding_dedup.materialize: written.append(df.columns) or f(df))
    assert embedding_dedup.embedding_dedup(vector_frame(spark, rows)).orderBy("vec_id").collect() == plain
    assert written.count(["a", "b", "n"]) > 1


def test_a_vector_goes_to_a_bucket_once():
    """Thirty-two visits of a vector whose cells share codewords: a third of that in copies at most, each with all that it visits there."""
    rng = np.random.default_rng(6)
    x = embedding_dedup.units(rng.normal(size=(4000, 64)))
    index = embedding_dedup.MultiIndex(x, 50_000, 0.9)
    cells = index.order(x[:500], 32)
    where = embedding_dedup.Buckets(index.size, 24)
    where.split({int(cells[0, 0]): 3})
    row, cell, part, to = where.places(cells)
    copies = set(zip(*(c.tolist() for c in where.copies(cells))))
    assert copies == set(zip(row.tolist(), to.tolist())) and len(copies) <= 500 * 32 // 3
    assert len(row) == 500 * 32 + 2 * int((cells == cells[0, 0]).sum())


def test_visits_take_bounded_memory():
    """Many visits on a large grid are ordered a few rows at a time."""
    rng = np.random.default_rng(7)
    index = embedding_dedup.MultiIndex.__new__(embedding_dedup.MultiIndex)
    index.half, index.size, index.words = 4, 256, [rng.normal(size=(256, 4)) for _ in range(2)]
    x = embedding_dedup.units(rng.normal(size=(1024, 8)))
    tracemalloc.start()
    cells = index.order(x, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20 and (cells[:5] == index.order(x[:5], 1024)).all()


@pytest.mark.parametrize("large", [1, 3])
def test_a_bucket_holds_its_members_only(monkeypatch, large):
    """Memory of a bucket doesn't follow those that visit it, and the links are those of all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(embedding_dedup, "STEP", 1 << 12)
    rng = np.random.default_rng(8)
    where = embedding_dedup.Buckets(4, 1)
    where.split({0: large})
    kind, visitor = (embedding_dedup.record(16, v, "<f4") for v in (8, 0))
    peaks = []
    for n in (2_000, 16_000):
        rows = np.zeros(n + 40, kind)
        rows["vector"] = rng.normal(size=(n + 40, 16))
        rows["vector"][:800] = rows["vector"][n + np.arange(800) % 40] + 0.05 * rows["vector"][:800]
        rows["node"], rows["n"], rows["own"], rows["cells"] = np.arange(n + 40), 1, 1, np.arange(1, 9)
        rows["own"][n:], rows["cells"][:, 0], rows["cells"][n:] = 0, np.where(np.arange(n + 40) < n, 0, 1), np.arange(8)
        # The first n are members elsewhere: of a place that this bucket doesn't hold.
        rows["own"][:n] = 15
        blobs = sorted(embedding_dedup.sent(rows, visitor, where, 1, 0, where.wanted(1, 0)), key=lambda r: r[1])
        tracemalloc.start()
        bucket = embedding_dedup.Bucket(kind, visitor, where.parts, 0.9)
        links = np.zeros(n + 40, np.int64)
        for _, what, data, places in blobs:
            for a, _, count in bucket.add(what, data, places):
                np.add.at(links, a, count)
        for a, _, count in bucket.flush():
            np.add.at(links, a, count)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        x = embedding_dedup.units(rows["vector"].astype(np.float64))
        near = x @ x[n:].T >= 0.9
        near[n + np.arange(40), np.arange(40)] = False
        assert (links[:n] == near[:n].sum(axis=1)).all() and (links[n:] == near.sum(axis=0)).all() and near[:n].sum() >= 800
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 4 << 20
