"""Inputs made to break an operator: ids beyond 2^53, words that fool a polynomial hash, long tokens, mixed languages."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import byte_bpe, common, embedding_dedup, quality_classifier, quality_rules, simhash_dedup, simhash_wide, substring_dedup, units
from tessera.llm.transducer import MergeTransducer

from .helpers import passage
from .test_near import reachable


@pytest.mark.parametrize("first", [0, 1 << 62])
def test_chains_of_vectors_with_large_ids(spark, first):
    """Eighteen vectors 20 degrees apart make a ring; each links with two others only."""
    rng = random.Random(1)
    rows, expected = [], {}
    for plane in range(8):
        ids = [first + 100 * plane + k for k in range(18)]
        rng.shuffle(ids)
        for k, i in enumerate(ids):
            vector = [0.0] * 16
            vector[2 * plane], vector[2 * plane + 1] = math.cos(math.radians(20 * k)), math.sin(math.radians(20 * k))
            rows.append((i, vector))
            expected[i] = (2, min(ids))
    for kind in ("float", "double"):
        found = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors whose cosine is 0.9 less a part in 10^9 don't link."""
    c = 0.9 - 1e-9
    rows = [(1, [1.0, 0.0]), (2, [c, math.sqrt(1 - c * c)]), (3, [-1.0, 0.0]), (4, [-0.9 - 1e-9, math.sqrt(1 - (0.9 + 1e-9) ** 2)])]
    found = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in found} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_words_that_fool_a_polynomial_hash(spark):
    """Thue-Morse words of 1,024 letters and their complement have equal polynomials modulo 2^64."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([word, *rest])), (2, " ".join([other, *rest])), (3, " ".join([word, *rest]))]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.kept.split()) for r in found} == {1: 20, 2: 20, 3: 0}


def test_both_distances_come_from_one_language(spark):
    """English common words among accented ones: no language allows both."""
    rng = random.Random(2)
    common = quality_rules.COMMON_WORDS["en"].split()
    accented = ["".join(rng.choice("aeioulnrstéèüñ") for _ in range(7)) for _ in range(400)]
    text = " ".join(rng.choice(common) if rng.random() < 0.25 else rng.choice(accented) for _ in range(300)) + "."
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not row.kept


def test_long_tokens_are_not_remembered():
    codec = byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    for _ in range(5):
        codec.encode(" ".join("".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(500)) for _ in range(20)))
    held = [*codec.units.first, *codec.units.spaced, *codec.known]
    assert max(map(len, held)) <= units.LONGEST


def test_generations_are_bounded_by_their_size():
    cache = units.Generations(len, 10)
    for k in range(1000):
        assert cache[f"{k:060d}"] == 60
    assert sum(map(len, cache)) <= units.EACH * 10 + 60 and sum(map(len, cache.older)) <= units.EACH * 10 + 60


def test_one_long_word_makes_few_states(monkeypatch):
    monkeypatch.setattr("tessera.llm.transducer.MAX_STATES", 5)
    merges = {("a", "b"): 0, ("ab", "a"): 1, ("b", "ab"): 2, ("aba", "b"): 3}
    tokens = {s: k for k, s in enumerate(("a", "b", "ab", "aba", "bab", "abab"))}
    machine = MergeTransducer(tokens, lambda a, b: merges.get((a, b)))
    rng = random.Random(4)
    for _ in range(20):
        word = "".join(rng.choice("ab") for _ in range(300))
        assert [machine.names[i] for i in machine.encode(word)] == machine.merged(word)
        assert len(machine.states) <= 7


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_near_copies_against_all_pairs(spark, monkeypatch, seed, small):
    """Families of edited copies at similarities around the limit, in small and in large groups of a key."""
    if small:  # in the workers too: what a bucket does is run here
        for name, value in (("STEPS", 2), ("MATRIX", 8), ("BLOCK", 3)):
            monkeypatch.setattr(simhash_wide, name, value)
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = passage(rng, rng.randint(60, 160)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    expected = {k for k, first in reachable(links, range(len(texts))).items() if k == first}
    assert {r.doc_id for r in simhash_dedup.one_of_each(docs).collect()} == expected


def test_partners_in_steps_and_in_matrices_agree(monkeypatch):
    plan = simhash_wide.Plan(1000, (4, 5))
    rng = np.random.default_rng(5)
    records = np.zeros(400, simhash_wide.KEYED)
    base = rng.integers(0, 1 << 63, (12, simhash_wide.CHECKED), dtype=np.uint64)
    records["key"], records["node"], records["size"] = rng.integers(0, 12, 400), np.arange(400), 100
    records["print"] = base[rng.integers(0, 12, 400)] ^ (rng.integers(0, 1 << 63, (400, simhash_wide.CHECKED), dtype=np.uint64) & rng.integers(0, 1 << 63, (400, simhash_wide.CHECKED), dtype=np.uint64))
    found = []
    for steps in (2, 1000):
        monkeypatch.setattr(simhash_wide, "STEPS", steps)
        found.append(simhash_wide.partners(records, plan))
    assert [sorted(zip(f["key"].tolist(), f["node"].tolist())) for f in found][0] == sorted(zip(found[1]["key"].tolist(), found[1]["node"].tolist()))


def test_near_copies_edges(spark):
    kinds = "doc_id long, text string, lang string"
    assert simhash_dedup.one_of_each(spark.createDataFrame([], kinds)).count() == 0
    rows = [(3, None, "a"), (2, "", "b"), (4, "  ", "c"), (None, "x y", "d"), (5, "X Y", "e"), (6, "one two three four five six", "f"), (6, "one two three four five six", "f")]
    found = simhash_dedup.one_of_each(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((r.doc_id, r.lang) for r in found) == [(2, "b"), (5, "e"), (6, "f")]


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


@pytest.mark.parametrize("wrap", [common.tidy, common.tidy_groups])
def test_workers_give_back_memory(wrap):
    """What a task frees below something that stays goes back to the machine, also if the task is stopped."""
    stays = []

    def batches(own):
        held = [bytes(60_000) for _ in range(4_000)]
        stays.append(bytes(60_000))
        yield len(held)
        yield 0

    def group(own):
        held = [bytes(60_000) for _ in range(4_000)]
        stays.append(bytes(60_000))
        return len(held)

    table = pa.table({"data": [b"x" * common.LARGE_GROUP]})
    before = resident()
    if wrap is common.tidy:
        run = wrap(batches)(iter([]))
        assert next(run) == 4_000
        run.close()
    else:
        assert wrap(group)(table) == 4_000
    assert resident() - before < 60 << 20


def test_the_driver_fits_in_blocks():
    """The whole sample never lies unpacked in the driver."""
    rng = np.random.default_rng(1)
    counts = (rng.integers(0, 400, (1024, quality_classifier.N_FEATURES), np.int16) < 3).astype(np.float32)
    rows = [quality_classifier.packed(c) for c in counts]
    del counts
    tracemalloc.start()
    model = quality_classifier.Model(rows, np.arange(1024) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1024 * quality_classifier.N_FEATURES * 4
    assert model.vectors.shape == (1024, quality_classifier.RANK)
