from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, packing, token_counts, units
from tessera.llm.transducer import MergeTransducer

from .helpers import EDGES, corpus, empty, frame, with_null_id

JSON, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
MORE = ["don't I'LL we've 'S", "1234567 12", "é é", "ΑΣ ΟΔΟΣ İ", "a\x1cb", " nb sp", "ẞ ǅ", "naïve\n\nlines\n"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(spark):
    texts = EDGES + MORE + corpus(1)
    expected = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_counts.token_counts(frame(spark, texts), WORD, limit=50).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == expected
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [n > 50 for n in expected]
    assert token_counts.token_counts(empty(spark), WORD).count() == 0
    assert token_counts.token_counts(with_null_id(spark), WORD).count() == 4


@pytest.mark.parametrize("chunk", [1, 3, 17])
def test_state_maps_compose(monkeypatch, chunk):
    counter = token_counts.WordBPE(WORD)
    texts = [t for t in EDGES + MORE if t] + corpus(2, 12)
    whole = [counter.count(t) for t in texts]
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    assert [counter.count(t[:400]) for t in texts] == [len(e.ids) for e in counter_library([t[:400] for t in texts])]
    monkeypatch.undo()
    assert [counter.count(t) for t in texts] == whole
    maps = [counter.chunk(x) for x in ("ab c", "d e", "", "  ", "f")]
    left = counter.compose(counter.compose(maps[0], maps[1]), counter.compose(maps[2], counter.compose(maps[3], maps[4])))
    assert left == counter.scan(maps)


def counter_library(texts):
    return Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)


def test_codec(spark, library):
    texts = EDGES + MORE + corpus(3)
    rows = byte_bpe.encode_decode(frame(spark, texts), RANKS).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [r.decoded for r in rows] == [t or "" for t in texts]
    digests = byte_bpe.digests(byte_bpe.encode_decode(frame(spark, texts), RANKS)).orderBy("doc_id").collect()
    for t, r in zip(texts, digests):
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.encode_decode(empty(spark), RANKS).count() == 0
    assert byte_bpe.encode_decode(with_null_id(spark), RANKS).count() == 4


def test_decoding_streams_across_blocks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "DECODE_BLOCK", 1)
    codec = byte_bpe.ByteBPE(RANKS)
    text = "日本語 😀 Straße"
    assert codec.decode(codec.encode(text)) == text
    assert codec.decode(codec.encode("😀")[:1]) == "�"


def test_transducer_equals_merging():
    """Random merge lists over two letters, all words up to nine letters long."""
    rng = random.Random(4)
    for _ in range(20):
        tokens, merges = {"a": 0, "b": 1}, {}
        for _ in range(6):
            pair = tuple(rng.choice(sorted(tokens)) for _ in "12")
            if pair not in merges:
                merges[pair] = len(merges)
                tokens.setdefault("".join(pair), len(tokens))
        machine = MergeTransducer(tokens, lambda a, b: merges.get((a, b)))
        for size in range(1, 10):
            for word in {"".join(rng.choice("ab") for _ in range(size)) for _ in range(30)}:
                assert [machine.names[i] for i in machine.encode(word)] == machine.merged(word)


def test_bounded_states_and_caches(monkeypatch, library):
    monkeypatch.setattr("tessera.llm.transducer.MAX_STATES", 5)
    monkeypatch.setattr("tessera.llm.transducer.MAX_PAIRS", 5)
    monkeypatch.setattr(units, "MAX_ENTRIES", 4)
    codec = byte_bpe.ByteBPE(RANKS)
    for t in corpus(5, 20):
        assert codec.encode(t) == library.encode_ordinary(t)
    assert len(codec.known) <= 4 and len(codec.transducer.states) < 60


def packed(spark, texts, **options):
    return packing.pack(frame(spark, texts), JSON, **options).collect()


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_packing(spark, capacity):
    texts = EDGES + corpus(6)
    library = Tokenizer.from_file(JSON)
    expected = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed(spark, texts, capacity=capacity):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and r.doc_tokens == len(expected[r.doc_id])
        pieces[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in pieces.items()} == expected
    assert all(start == sum(len(i) for _, i in sorted(v)[:n]) for v in pieces.values() for n, (start, _) in enumerate(sorted(v)))
    used = 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
        used += end
    # One sequence of a shard may be short; there are at most as many shards as tasks.
    assert len(sequences) * capacity - used < 4 * capacity


def test_packing_balances_cost():
    rng = random.Random(7)
    lengths = np.array([rng.randint(1, 300) for _ in range(400)])
    load, fill = defaultdict(float), defaultdict(int)
    for _, _, n, s, _ in packing.assign(lengths, 1024):
        load[s] += packing.cost(n)
        fill[s] += n
    assert sum(fill.values()) == lengths.sum() and len(fill) == -(-int(lengths.sum()) // 1024)
    full = [load[s] for s in load if fill[s] == 1024]
    assert max(full) < 1.25 * min(full)


def test_packing_edges(spark):
    assert packing.pack(empty(spark), JSON).count() == 0
    rows = packing.digests(packing.pack(with_null_id(spark), JSON)).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {None, 1}
    null = next(r for r in rows if r.doc_tokens == 1)
    assert null.ids_crc32 == zlib.crc32(np.uint32(1).tobytes())


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 50)
    ids = packing.PackedIds(JSON, 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(corpus(8, 30)[:40])], ["doc_id", "text"])
    found = list(packing.shards([batch], ids, np.uint32(1).tobytes()))
    assert sum(len(k) for k, _ in found) == 40 and len(found) > 5


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_counts_of_random_texts(monkeypatch, chunk):
    """Contractions, marks, numbers, odd white space and special strings next to each other, cut anywhere."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    rng = random.Random(chunk)
    letters = [*"aabcdesStTrReEvVmMlLdD''''!!,.<|>123 \n\t\x1c\x85  éÉßİΣσ̈日語😀½²Ⅷ_-", "<|endoftext|>", "'ll", "'re", " '", "'s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    counter = token_counts.WordBPE(WORD)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_a_machine_of_few_states_counts_alike(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    counter = token_counts.WordBPE(WORD)
    texts = corpus(9, 20) + MORE
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert len(counter.values) <= 7


def test_maps_lead_from_state_to_state():
    counter = token_counts.WordBPE(WORD)
    rng = random.Random(3)
    text = " ".join(corpus(4, 6))[:3000].lower()
    maps = [counter.chunk(text[k : k + 7]) for k in range(0, len(text), 7)]
    state, n = counter.start, 0
    for m in maps:  # one after the other, each from the state that the one before gives
        state, more = counter.walk(state, m.head)
        n, state = n + more + (m.count if m.cut else 0), m.right if m.cut else state
    cut = rng.randrange(len(maps))
    joined = counter.compose(counter.scan(maps[:cut] or [counter.chunk("")]), counter.scan(maps[cut:]))
    for whole in (joined, counter.scan(maps)):
        right, head = counter.walk(counter.start, whole.head)
        assert (whole.right if whole.cut else right, head + (whole.count if whole.cut else 0)) == (state, n)
