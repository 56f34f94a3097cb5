"""Removal of repeated word windows behind a count-min prefilter.

1. Each bucket of documents makes a count-min sketch of its windows: DEPTH
   rows of counters, cut into segments, which are sent as the counters that
   aren't zero. A segment merges the sketches of all buckets by addition and
   sends back to each bucket which of its counters came to two or more. A
   window's estimate is the least of its counters. Counts are never
   underestimated, so no repeat is lost.
2. Windows estimated at two or more, and only those, are grouped exactly by a
   96-bit digest, made of two independent halves of the words' 128-bit hashes;
   all but the earliest of a group are covered.

Buckets and segments follow the number of shuffle partitions, so a sketch has
the same load at any size of input. Documents are dealt once by id and that
exchange is used again.

Defined cases: a null or empty text has no words; texts of fewer words than
the window stay; rows that agree in id and text are one document (none of them
removes from the others); rows that share only the id order by a digest of
their text; null ids order first; other columns aren't read; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_DDL, blob_table, bounded_batches, buckets, hash_bucket
from .dedup_docs import MARK, NULL_ID, Bucket, by_kind, covered_runs, dealt, mark_rows, merged
from .rolling import Spans, mix, pack_columns, packed_rows, runs, unpack_all, unpack_columns
from .suffix_dedup import grouped, shared

#: Rows of counters of a sketch, and bits of a counter's number in a row of a segment.
DEPTH, WIDTH_BITS = 2, 23
CELLS, AGAIN, WINDOWS, COVERED = 0, 1, 2, 3
#: Bytes of texts whose words are hashed at once.
STRETCH = 1 << 20
#: "doc" is the column that pack_columns keeps as differences.
CELL = np.dtype([("doc", "<u4"), ("count", "<u1")])
NUMBER = np.dtype([("doc", "<u4")])
WINDOW = np.dtype([("high", "<u8"), ("low", "<u4"), ("doc", "<i8"), ("version", "<u4"), ("start", "<u4")])
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class CountMin:
    """Counters of one segment."""

    def __init__(self, depth: int = DEPTH, width_bits: int = WIDTH_BITS):
        self.bits, self.rows = width_bits, [np.zeros(1 << width_bits, np.int32) for _ in range(depth)]

    def cells(self, row: int, digests: np.ndarray) -> np.ndarray:
        return counter(row, digests.astype(np.uint64), self.bits).astype(np.int64)

    def add(self, row: int, cells: np.ndarray, counts: np.ndarray) -> None:
        """Merges a row of another sketch, given as its counters that aren't zero, each once."""
        self.rows[row][cells] += counts

    def merge(self, digests: np.ndarray, twice: np.ndarray) -> None:
        """Merges the sketch of these digests: a count of one for each, of two where it says so."""
        for k in range(len(self.rows)):
            cells, at = np.unique(self.cells(k, digests), return_inverse=True)
            self.add(k, cells, np.bincount(at, 1 + (twice > 0)).astype(np.int32))

    def estimate(self, digests: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([row[self.cells(k, digests)] for k, row in enumerate(self.rows)])


def counter(row: int, digests: np.ndarray, bits: int = WIDTH_BITS) -> np.ndarray:
    """Number of the digests' counters in a row."""
    return mix(digests + np.uint64((row + 1) << 40)) >> np.uint64(64 - bits)


class Windows:
    """The windows of a bucket's documents: digest, and where each begins."""

    def __init__(self, bucket: Bucket, width: int):
        # Rows that agree in id and text are one document: the first stands for all.
        same = np.concatenate([[False], (bucket.doc[1:] == bucket.doc[:-1]) & (bucket.version[1:] == bucket.version[:-1])])
        parts, texts, first = [self.part([], 0, width)], [], 0
        size = 0
        for k in range(len(bucket.doc)):
            texts.append(b"" if same[k] else bucket.text(k))
            size += len(texts[-1])
            if size >= STRETCH or k == len(bucket.doc) - 1:
                parts.append(self.part(texts, first, width))
                texts, first, size = [], k + 1, 0
        self.owner, self.start, self.high, self.low = map(np.concatenate, zip(*parts))

    @staticmethod
    def part(texts: list[bytes], first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the document, first word, and digest of the windows of a few texts."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = SPACES[data]
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        # 128 bits a word, so the two halves of a window's digest have nothing in common.
        words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data.tobytes().split())), "<u8").reshape(-1, 2)
        n = max(0, len(words) - width + 1)
        good = np.flatnonzero(owner[:n] == owner[width - 1 :][:n])
        place = np.searchsorted(owner, np.arange(len(texts)))
        high, low = (Spans(np.ascontiguousarray(words[:, w]), w).all(width)[good] for w in (0, 1))
        own = owner[good]
        return own + first, good - place[own] if len(own) else good, high, (low >> np.uint64(32)).astype(np.uint32)

    def counters(self, row: int, n_segments: int) -> np.ndarray:
        """Segment in the high bits, number of the counter in the low ones."""
        return (hash_bucket(self.high, n_segments).astype(np.uint64) << np.uint64(WIDTH_BITS)) | counter(row, self.high)


#: Goes before the counters of a sketch's segment: the bucket or segment that sends them, and how many each row has.
HEAD = np.dtype([("sender", "<i4"), ("sizes", "<i8", (DEPTH,))])


def headed(sender: int, rows: list[np.ndarray]) -> bytes:
    """All rows of one segment as one blob: a bucket sends each segment one record."""
    return np.array([(sender, [len(r) for r in rows])], HEAD).tobytes() + pack_columns(np.concatenate(rows))


def unheaded(blob: bytes, dtype: np.dtype) -> tuple[int, list[np.ndarray]]:
    head = np.frombuffer(blob, HEAD, 1)[0]
    return int(head["sender"]), np.split(unpack_columns(blob[HEAD.itemsize :], dtype)[0], np.cumsum(head["sizes"])[:-1])


def sketch(docs: pa.Table, width: int, n: int) -> pa.Table:
    """A bucket's sketch, one record for each segment that it touches. Its own counts end at two: more tells nothing."""
    number, windows, rows = docs["bucket"][0].as_py(), Windows(Bucket(docs), width), []
    for row in range(DEPTH):
        counters, counts = np.unique(windows.counters(row, n), return_counts=True)
        records = np.empty(len(counters), CELL)
        records["doc"], records["count"] = counters & np.uint64((1 << WIDTH_BITS) - 1), np.minimum(counts, 2)
        segments = np.arange(n + 1, dtype=np.uint64) << np.uint64(WIDTH_BITS)
        rows.append(np.split(records, np.searchsorted(counters, segments[1:-1])))
    return blob_table([(segment, CELLS, headed(number, list(of))) for segment, of in enumerate(zip(*rows)) if len(of[0])])


def merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a segment's sketches and tells each bucket which of its counters came to two or more."""
    for _, segment, blobs in grouped(batches):
        merged, parts, rows = CountMin(), [unheaded(b, CELL) for b in blobs], []
        for _, own in parts:
            for row, cells in enumerate(own):
                merged.add(row, cells["doc"], cells["count"])
        for bucket, own in parts:
            again = [cells["doc"][merged.rows[row][cells["doc"]] > 1].astype(NUMBER) for row, cells in enumerate(own)]
            if all(map(len, again)):
                rows.append((bucket, AGAIN, headed(segment, again)))
        if rows:
            yield from blob_table(rows).to_batches()


def estimated_again(windows: Windows, replies: list[bytes], n: int) -> np.ndarray:
    """Which windows have counters of two or more in every row."""
    parts = [unheaded(b, NUMBER) for b in replies]
    out = np.arange(len(windows.high) if parts else 0)
    for row in range(DEPTH if parts else 0):
        again = np.sort(np.concatenate([(np.uint64(segment) << np.uint64(WIDTH_BITS)) | own[row]["doc"].astype(np.uint64) for segment, own in parts]))
        counters = windows.counters(row, n)[out]
        out = out[again[np.minimum(np.searchsorted(again, counters), len(again) - 1)] == counters]
    return out


def candidates(docs: pa.Table, replies: pa.Table, width: int, n: int) -> pa.Table:
    """Windows estimated at two or more; a bucket settles its own repeats."""
    blobs = by_kind(replies, AGAIN)
    if not docs.num_rows or not blobs:
        return blob_table([])
    bucket = Bucket(docs)
    windows = Windows(bucket, width)
    k = estimated_again(windows, blobs, n)
    records = np.empty(len(k), WINDOW)
    records["high"], records["low"], records["start"] = windows.high[k], windows.low[k], windows.start[k]
    records["doc"], records["version"] = bucket.doc[windows.owner[k]], bucket.version[windows.owner[k]]
    first, covered = earliest(records)
    first = first[np.lexsort((first["start"], first["doc"]))]
    return blob_table(packed_rows(hash_bucket(first["high"], n), WINDOWS, first) + mark_rows(merged(marks_of(covered)), COVERED, n))


def earliest(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest window of each digest, and the others."""
    often = shared(records, "high")
    some = records[often]
    some = some[np.lexsort((some["start"], some["version"], some["doc"], some["low"], some["high"]))]
    if not len(some):
        return records, some
    new = np.concatenate([[True], (some["high"][1:] != some["high"][:-1]) | (some["low"][1:] != some["low"][:-1])])
    return np.concatenate([records[~often], some[new]]), some[~new]


def marks_of(windows: np.ndarray) -> np.ndarray:
    marks = np.zeros(len(windows), MARK)
    for name in ("doc", "version", "start"):
        marks[name] = windows[name]
    marks["n"] = 1
    return marks


def exact_groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for kind, bucket, blobs in grouped(batches):
        if kind == COVERED:
            yield from blob_table([(bucket, kind, b) for b in blobs]).to_batches()
            continue
        _, covered = earliest(unpack_all(blobs, WINDOW))
        if len(covered):
            yield from blob_table(mark_rows(merged(marks_of(covered)), COVERED, n)).to_batches()


OUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def removal(docs: pa.Table, rows: pa.Table, width: int) -> pa.Table:
    if not docs.num_rows:
        return OUT.empty_table()
    bucket = Bucket(docs)
    gone = covered_runs(bucket, unpack_all(rows["data"].to_pylist(), MARK), width)
    n_words, spans, kept = [], [], []
    for k in range(docs.num_rows):
        words, cut = bucket.text(k).split(), gone.get(k, [])
        edges = [0, *(x for ab in cut for x in ab), len(words)]
        n_words.append(len(words))
        spans.append([{"start": a, "end": b} for a, b in cut])
        kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]).decode())
    return pa.table([pa.array(bucket.doc), pa.array(n_words, pa.int64()), pa.array(spans, OUT.field(2).type), pa.array(kept, pa.string())], schema=OUT)


def substring_dedup(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans array<struct<start,end>> (words removed), kept (words joined by a space), for each row."""
    spark = df.sparkSession
    bounded_batches(spark)
    n = buckets(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = dealt(df, n, id_col, text_col)
    by_bucket = lambda rows: rows.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    with_docs = lambda rows: docs.groupBy("bucket").cogroup(rows.groupBy("bucket"))
    replies = by_bucket(docs.groupBy("bucket").applyInArrow(lambda a: sketch(a, width, n), BLOB_DDL)).mapInArrow(merge_sketches, BLOB_DDL)
    found = with_docs(replies).applyInArrow(lambda a, b: candidates(a, b, width, n), BLOB_DDL)
    found = by_bucket(found).mapInArrow(lambda it: exact_groups(it, n), BLOB_DDL)
    done = with_docs(found).applyInArrow(lambda a, b: removal(a, b, width), "doc long, n_words long, spans array<struct<start:long,end:long>>, kept string")
    return done.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "spans", "kept")


def digests(deduped: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return deduped.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
