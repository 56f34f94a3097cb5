"""Cost-balanced packing of documents into sequences of bounded length.

A document is its ids and an end id. What fills whole sequences is cut off
first; the remainders are taken in descending order of their estimated
attention cost (linear plus quadratic in length), and each goes to the
sequence of lowest cost that has room. One that fits nowhere is cut over the
sequences of lowest cost with room left, so only the last sequence of a shard
is padded. A shard is what one task reads, up to SHARD_TOKENS; its sequences
are numbered from the task's partition, so no row is shuffled and a task that
runs again gives the same sequences.

Defined cases: a null or empty text is its end id alone; equal rows are
packed as rows of their own; an empty table gives an empty one; columns other
than the two named ones aren't read.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bounded_batches, texts_of, tidy
from .units import Generations, UnitCache

#: Tokens of a shard: bounds memory and the sequences that a piece chooses from.
SHARD_TOKENS = 1 << 22
#: Units and pieces remembered by default, about 200 bytes each, in each of two generations.
CACHE = 600_000
#: Attention cost of n tokens in one piece: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
FIELDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class PackedIds:
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit numbers.

    A unit seen for the first time is cut by the file's pattern and its pieces
    go to the library's model; texts that aren't regular, or hold a special
    string, go to the library as they are.
    """

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # Letters that stand for bytes: printable ones for themselves, the others from code point 256 on.
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
        self.pieces = Generations(self.piece, cache)
        self.units = UnitCache(self.unit, cache)

    def piece(self, piece: str) -> bytes:
        tokens = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def unit(self, unit: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(unit)))

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        known = None if any(s in text for s in self.special) else self.units.of(text)
        return b"".join(known) if known is not None else self.whole(text)


@functools.lru_cache(2)
def packed_ids(path: str, cache: int) -> PackedIds:
    return PackedIds(path, cache)


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    whole = lengths // capacity
    sequence = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            yield int(d), k * capacity, capacity, sequence, 0
            sequence += 1
    rest = lengths - whole * capacity
    n = -(-int(rest.sum()) // capacity)
    load, room = np.zeros(n), np.full(n, capacity, np.int64)
    order = np.argsort(-cost(rest.astype(float)), kind="stable")
    for d in order[: int((rest > 0).sum())]:
        at, left = int(whole[d]) * capacity, int(rest[d])
        while left:
            fits = np.where(room >= left, load, np.inf)
            s = int(fits.argmin())
            if room[s] < left:
                s = int(np.where(room > 0, load, np.inf).argmin())
            take = min(left, int(room[s]))
            yield int(d), at, take, sequence + s, capacity - int(room[s])
            load[s] += cost(take)
            room[s] -= take
            at, left = at + take, left - take


def shards(batches: Iterable[pa.RecordBatch], ids: PackedIds, end: bytes) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(ids.of(text) + end)
            size += len(texts[-1]) // 4
            if size >= SHARD_TOKENS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (packed as in PackedIds).

    cache: units and pieces that a worker remembers in a generation. It keeps
    them between tasks; take fewer where other steps need its memory after it.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for keys, texts in shards(batches, packed_ids(path, cache), np.uint32(end_id).tobytes()):
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            out, used = [], 0
            for d, start, n, s, offset in assign(lengths, capacity):
                out.append((keys[d], start, n, int(lengths[d]), first + s, offset, texts[d][4 * start : 4 * (start + n)]))
                used = max(used, s + 1)
                if len(out) == BATCH_ROWS:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
            first += used

    return texts_of(df, id_col, text_col).mapInArrow(tidy(run), FIELDS)


def rows(out: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
