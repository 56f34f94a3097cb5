"""Rolling hashes of spans by prefix sums, and packed record columns.

A span's hash is a polynomial over 64-bit values in wrap-around arithmetic
with an odd base, so any span costs two look-ups; values are random numbers
that stand for bytes (or hashes of words), which keeps the low bits mixed.
"""

from __future__ import annotations

import numpy as np

#: Fixed seed of the byte numbers and bases: every task has to use the same.
SEED = 20240229
_rng = np.random.default_rng(SEED)
BYTE_NUMBERS = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (2, 256), dtype=np.uint64)
BASES = [int(x) | 1 for x in _rng.integers(1 << 60, 1 << 62, 2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = BASES[which]
        _powers[which] = have = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Spans:
    """Hashes of spans of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = powers(which, len(values))
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def all(self, length: int) -> np.ndarray:
        """Of each span of this length, by its start."""
        n = len(self.prefix) - length
        return mix((self.prefix[length:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_spans(data: np.ndarray, which: int = 0) -> Spans:
    return Spans(BYTE_NUMBERS[which][data], which)


def long_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a bigint (XXH64 with seed 42; its primes are fixed values)."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.uint64(42) + p5 + np.uint64(8)
    h = turn(h ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs; change[k] tells that k + 1 begins another one."""
    cuts = np.flatnonzero(change) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(change) + 1]])


def pack_columns(records: np.ndarray) -> bytes:
    """Records column by column and byte by byte, so that equal high bytes lie together for the shuffle's compression."""
    out = [np.int64(len(records)).tobytes()]
    for name in records.dtype.names:
        column = np.ascontiguousarray(records[name])
        if name == "doc":
            column = np.diff(column, prepend=column.dtype.type(0))
        out.append(column.view(np.uint8).reshape(len(records), column.itemsize).T.tobytes())
    return b"".join(out)


def unpack_columns(data: bytes, dtype: np.dtype) -> tuple[np.ndarray, int]:
    """The records, and how many bytes of data they took."""
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    out = np.empty(n, dtype)
    for name in dtype.names:
        size = dtype[name].itemsize
        column = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(dtype[name]).ravel()
        out[name] = np.cumsum(column) if name == "doc" else column
        at += n * size
    return out, at


def unpack_all(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.concatenate([unpack_columns(b, dtype)[0] for b in blobs]) if blobs else np.empty(0, dtype)


def packed_rows(bucket: np.ndarray, kind: int, records: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket."""
    if not len(records):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    return [(int(bucket[a]), kind, pack_columns(records[a:b])) for a, b in zip(*runs(bucket[1:] != bucket[:-1]))]
