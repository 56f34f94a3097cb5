"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through `width` bytes only, by most-significant-digit
passes; groups that are still equal at that depth are exactly the repeated
windows. So that not every suffix is moved, each window is represented at its
anchor: the least-hashed GRAM-byte string in it (the leftmost, if equal).
Equal windows have equal anchors at equal places, so no repeat is missed.

1. First digit, the anchor's gram. Suffixes whose gram occurs once drop out.
   Suffixes whose whole surroundings (all windows of that anchor) occur before
   are repeats; each chunk settles its own first and sends one record a gram.
2. Where a gram has differing surroundings, the windows on either side of the
   anchor get a second, longer digit (HALF bytes to the left, or all that
   every window on the right holds); what occurs once drops out.
3. Last digit: all `width` bytes of the remaining windows.

Each pass moves packed records in buckets; documents are dealt once by id and
that exchange is used again. Hashes have 64 bits a digit, 128 and more in all.

Defined cases: a null or empty text keeps nothing and loses nothing; texts
shorter than the width stay; rows that agree in id and text are one document
(none of them removes from the others); rows that share only the id order by
a digest of their text; null ids order first; other columns aren't read
unless named in keep; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOB_DDL, blob_table, bounded_batches, buckets, hash_bucket, tidy, tidy_groups
from .dedup_docs import MARK, NULL_ID, Bucket, by_kind, covered_runs, dealt, mark_rows, merged
from .rolling import byte_spans, mix, pack_columns, packed_rows, runs, unpack_all, unpack_columns

#: Bytes of the first digit, and of the second one's reach to the left of an anchor.
GRAM, HALF = 32, 32
#: Bytes whose suffixes are taken at once, and bytes of a chunk that settles its own repeats.
STRETCH, CHUNK = 1 << 19, 16 << 20
#: Bits that number the bytes of a stretch and the piece that ends it.
PLACE_BITS = 21
#: Bytes of documents, and windows, that the later digits take at once.
TEXTS, WINDOWS = 2 << 20, 1 << 19
#: Kinds of rows: first-digit records, covered runs, windows for the second digit, second-digit records.
FIRST, COVERED, OPEN, SECOND = 0, 1, 2, 3
ANCHOR = np.dtype([("gram", "<u8"), ("around", "<u8"), *MARK.descr])
#: Stands for surroundings that differ within a chunk.
MANY = np.uint64(0)
LATER = np.dtype([("key", "<u8"), *MARK.descr])


def anchors(pieces: list[tuple[int, int, int, bytes]], width: int) -> np.ndarray:
    """ANCHOR records of pieces (doc, version, place in the document, bytes), all of `width` bytes or more."""
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    ends = np.cumsum(sizes)
    spans = byte_spans(data)
    gram = spans.all(GRAM)
    # The same bits at any length, or equal windows in stretches of different length could choose different anchors.
    low = np.uint64((1 << PLACE_BITS) - 1)
    if len(data) > low:
        raise ValueError(f"pieces may have {low} bytes together at most")
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    reach, span = width - GRAM + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    place = (least & low).astype(np.int64)
    inside = np.zeros(len(place), bool)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        inside[a : b - width + 1] = True
    first, last = runs((place[1:] != place[:-1]) | (inside[1:] != inside[:-1]))
    good = inside[first]
    first, last = first[good], last[good]
    out = np.empty(len(first), ANCHOR)
    of = np.searchsorted(ends, first, side="right")
    at = place[first]
    out["gram"] = gram[at]
    out["doc"] = np.array([p[0] for p in pieces], np.int64)[of]
    out["version"] = np.array([p[1] for p in pieces], np.uint32)[of]
    out["start"] = first - (ends - sizes)[of] + np.array([p[2] for p in pieces], np.int64)[of]
    out["n"], out["lead"] = last - first, at - first
    out["around"] = np.maximum(mix(spans.of(first, last - 1 + width) + out["lead"].astype(np.uint64)), np.uint64(1))
    return out


def ordered(records: np.ndarray, *digits: str) -> np.ndarray:
    return records[np.lexsort((records["start"], records["version"], records["doc"], *(records[d] for d in reversed(digits))))]


def once(records: np.ndarray) -> np.ndarray:
    """Ordered records without those that equal rows repeat: a window isn't its own earlier copy."""
    if len(records) < 2:
        return records
    same = np.logical_and.reduce([records[c][1:] == records[c][:-1] for c in records.dtype.names])
    return records[np.concatenate([[True], ~same])]


def shared(records: np.ndarray, digit: str) -> np.ndarray:
    """Records whose digit occurs more than once: one radix pass."""
    order = np.argsort(records[digit], kind="stable")
    key = records[digit][order]
    same = key[1:] == key[:-1]
    often = np.zeros(len(records), bool)
    often[:-1] |= same
    often[1:] |= same
    out = np.zeros(len(records), bool)
    out[order[often]] = True
    return out


def settle(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one radix group's records: those to send on, those covered, and those that need the next digit."""
    often = shared(records, "gram")
    alone, some = records[~often], once(ordered(records[often], "gram", "around"))
    if not len(some):
        return alone, some, some
    new_gram = np.concatenate([[True], some["gram"][1:] != some["gram"][:-1]])
    new_class = new_gram | np.concatenate([[True], some["around"][1:] != some["around"][:-1]])
    group = np.cumsum(new_gram) - 1
    classes = np.bincount(group, new_class)
    many = (classes[group] > 1) | (np.bincount(group, some["around"] == MANY)[group] > 0)
    real = some["around"] != MANY
    send = some[new_gram].copy()
    send["around"][many[new_gram]] = MANY
    return np.concatenate([alone, send]), some[~new_class & real], some[new_class & many & real]


def first_digit(batches: Iterator[pa.RecordBatch], width: int, n_keys: int, n_docs: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the documents, settled chunk by chunk."""
    step = STRETCH

    def send(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        on, covered, more = settle(np.concatenate(found))
        rows = packed_rows(hash_bucket(on["gram"], n_keys), FIRST, on)
        rows += mark_rows(merged(covered[list(MARK.names)].astype(MARK)), COVERED, n_docs)
        rows += mark_rows(more[list(MARK.names)].astype(MARK), OPEN, n_docs)
        yield from blob_table(rows).to_batches()

    def stretches() -> Iterator[list]:
        pieces, size = [], 0
        for batch in batches:
            docs, versions, texts = batch.column("doc").to_pylist(), batch.column("version").to_pylist(), batch.column("text")
            for k, (doc, version) in enumerate(zip(docs, versions)):
                text = texts[k].as_buffer().to_pybytes()
                for a in range(0, max(1, len(text) - width + 1), step):
                    piece = text[a : a + step + width - 1]
                    if len(piece) >= width:
                        pieces.append((doc, version, a, piece))
                        size += len(piece)
                    if size >= STRETCH:
                        yield pieces
                        pieces, size = [], 0
        if pieces:
            yield pieces

    found, size = [], 0
    for pieces in stretches():
        found.append(anchors(pieces, width))
        size += sum(len(p[3]) for p in pieces)
        if size >= CHUNK:
            yield from send(found)
            found, size = [], 0
    if found:
        yield from send(found)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(kind, bucket, blobs) of rows that come sorted by kind and bucket."""
    at, blobs = None, []
    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
            if (kind, bucket) != at and blobs:
                yield *at, blobs
                blobs = []
            at = kind, bucket
            blobs.append(data)
    if blobs:
        yield *at, blobs


def first_groups(batches: Iterator[pa.RecordBatch], n_docs: int) -> Iterator[pa.RecordBatch]:
    """Equal first digits over all chunks: what is covered, and what needs the next digit."""
    for kind, bucket, blobs in grouped(batches):
        if kind != FIRST:
            yield from blob_table([(bucket, kind, b) for b in blobs]).to_batches()
            continue
        _, covered, more = settle(unpack_all(blobs, ANCHOR))
        rows = [r for found, k in ((covered, COVERED), (more, OPEN)) for r in mark_rows(found[list(MARK.names)].astype(MARK), k, n_docs)]
        if rows:
            yield from blob_table(rows).to_batches()


def second_digit(docs: pa.Table, rows: pa.Table, width: int, n_keys: int) -> pa.Table:
    """Second-digit records with the bytes of their windows; covered runs pass."""
    covered = merged(unpack_all(by_kind(rows, COVERED), MARK))
    out = [(int(rows["bucket"][0].as_py()), COVERED, pack_columns(covered))] if len(covered) else []
    # All marks of a document meet here, so what equal rows opened in different chunks is made one.
    marks = once(ordered(unpack_all(by_kind(rows, OPEN), MARK)))
    if not len(marks) or not docs.num_rows:
        return blob_table(out)
    bucket = Bucket(docs)
    of = bucket.find(marks)
    order = np.argsort(of, kind="stable")
    of, marks = of[order], marks[order]
    first, last = runs(of[1:] != of[:-1])
    texts, size, begun = [], 0, 0
    for k, (a, b) in enumerate(zip(first, last)):
        texts.append((bucket.text(int(of[a])), int(b - a)))
        size += len(texts[-1][0])
        if size >= TEXTS or k == len(first) - 1:
            out += second_records(texts, marks[begun:b], width, n_keys)
            texts, size, begun = [], 0, b
    return blob_table(out)


def second_records(texts: list[tuple[bytes, int]], marks: np.ndarray, width: int, n_keys: int) -> list[tuple[int, int, bytes]]:
    """Rows of texts, each with the number of its marks, which come in the same order."""
    joined = b"".join(t for t, _ in texts)
    spans = byte_spans(np.frombuffer(joined, np.uint8))
    offset = np.cumsum([0, *(len(t) for t, _ in texts[:-1])])
    begin = np.repeat(offset, [n for _, n in texts]) + marks["start"]
    anchor = begin + marks["lead"]
    # Windows that reach HALF bytes or more to the left of the anchor, and the others.
    n_left = np.clip(marks["lead"].astype(np.int64) - HALF + 1, 0, marks["n"])
    left = n_left, 0 * n_left, lambda r: spans.of(anchor[r] - HALF, anchor[r] + min(GRAM, width - HALF))
    right = marks["n"] - n_left, n_left, lambda r: spans.of(anchor[r], anchor[r] + width - HALF + 1)
    parts = []
    for n, skip, key in (left, right):
        r = np.flatnonzero(n > 0)
        part = np.empty(len(r), LATER)
        part["key"] = mix(key(r) + np.uint64(len(parts)))
        for name in ("doc", "version"):
            part[name] = marks[name][r]
        part["start"], part["n"], part["lead"] = marks["start"][r] + skip[r], n[r], marks["lead"][r] - skip[r]
        parts.append((part, begin[r] + skip[r]))
    records, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    to = hash_bucket(records["key"], n_keys)
    order = np.argsort(to, kind="stable")
    to, records, at = to[order], records[order], at[order]
    out = []
    for a, b in zip(*runs(to[1:] != to[:-1])):
        near = b"".join([joined[s : s + n + width - 1] for s, n in zip(at[a:b].tolist(), records["n"][a:b].tolist())])
        out.append((int(to[a]), SECOND, pack_columns(records[a:b]) + near))
    return out


def last_groups(batches: Iterator[pa.RecordBatch], width: int, n_docs: int) -> Iterator[pa.RecordBatch]:
    """Windows equal through the whole depth: all but the earliest are covered."""
    for kind, bucket, blobs in grouped(batches):
        if kind != SECOND:
            yield from blob_table([(bucket, kind, b) for b in blobs]).to_batches()
            continue
        found = [unpack_columns(b, LATER) for b in blobs]
        records = np.concatenate([f[0] for f in found])
        data = np.frombuffer(b"".join(b[n:] for b, (_, n) in zip(blobs, found)), np.uint8)
        at = np.cumsum(records["n"].astype(np.int64) + width - 1) - (records["n"] + width - 1)
        often = np.flatnonzero(shared(records, "key"))
        # Equal keys stay together; so many windows at once as memory is meant for.
        turns = 1 + int(records["n"][often].sum()) // WINDOWS
        turn = mix(records["key"][often]) % np.uint64(turns)
        marks = [repeated(records[k], at[k], data, width) for k in (often[turn == t] for t in range(turns)) if len(k)]
        if marks:
            yield from blob_table(mark_rows(merged(np.concatenate(marks)), COVERED, n_docs)).to_batches()


def repeated(records: np.ndarray, at: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """Marks of the windows that are equal to an earlier one; at: where each record's bytes begin in data."""
    order = np.lexsort(tuple(records[c] for c in ("start", "version", "doc")))
    records, at = records[order], at[order]
    n = records["n"].astype(np.int64)
    size = n + width - 1
    near = data[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    owner = np.repeat(np.arange(len(records)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(size) - size)[owner] + nth
    digits = [byte_spans(near, w).of(begin, begin + width) for w in (0, 1)]
    order = np.lexsort((np.arange(len(owner)), digits[1], digits[0]))
    again = np.zeros(len(owner), bool)
    again[order[1:]] = (digits[0][order[1:]] == digits[0][order[:-1]]) & (digits[1][order[1:]] == digits[1][order[:-1]])
    k = np.flatnonzero(again)
    marks = np.zeros(len(k), MARK)
    for name in ("doc", "version"):
        marks[name] = records[name][owner[k]]
    marks["start"], marks["n"] = records["start"][owner[k]] + nth[k], 1
    return merged(marks)


def removal(docs: pa.Table, rows: pa.Table, width: int, keep: int, schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    bucket = Bucket(docs)
    gone = covered_runs(bucket, unpack_all(rows["data"].to_pylist(), MARK), width)
    others = docs.select(["doc", *(f"keep_{k}" for k in range(keep))]).take(pa.array(bucket.order)).combine_chunks()
    # Results leave in slices, so that neither side holds a bucket's texts twice as one block.
    parts, spans, kept, size, begun = [], [], [], 0, 0
    for k in range(docs.num_rows):
        text, cut = bucket.text(k), gone.get(k, [])
        spans.append([{"start": a, "end": b} for a, b in cut])
        edges = [0, *(x for ab in cut for x in ab), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        size += len(kept[-1])
        if size >= TEXTS or k == docs.num_rows - 1:
            own = others.slice(begun, len(kept))
            parts.append(pa.table([own["doc"], pa.array(spans, schema.field(1).type), pa.array(kept, pa.binary()), *own.columns[1:]], schema=schema))
            spans, kept, size, begun = [], [], 0, k + 1
    return pa.concat_tables(parts)


def suffix_dedup(df: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans array<struct<start,end>> (bytes removed), kept binary, and the columns of keep, for each row.

    A byte goes if it lies in a string of `width` bytes that also starts
    earlier, as judged on the input.
    """
    if width < max(GRAM, HALF) + HALF or width > 255:
        raise ValueError(f"width must lie between {max(GRAM, HALF) + HALF} and 255")
    spark = df.sparkSession
    bounded_batches(spark)
    # A row is sent from each bucket of documents to each of keys, so their numbers are no larger than memory asks for.
    n_docs, n_keys = buckets(spark, 3), buckets(spark, 2)
    docs = dealt(df, n_docs, id_col, text_col, keep)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = lambda rows: rows.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")

    def digit_1(batches):
        return first_digit(batches, width, n_keys, n_docs)

    def groups_1(batches):
        return first_groups(batches, n_docs)

    def digit_2(own, rows):
        return second_digit(own, rows, width, n_keys)

    def groups_2(batches):
        return last_groups(batches, width, n_docs)

    found = docs.select("doc", "version", "text").mapInArrow(tidy(digit_1), BLOB_DDL)
    found = by_bucket(found).mapInArrow(tidy(groups_1), BLOB_DDL)
    found = docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(tidy_groups(digit_2), BLOB_DDL)
    found = by_bucket(found).mapInArrow(tidy(groups_2), BLOB_DDL)
    kinds = [T.StructField(f"keep_{k}", df.schema[c].dataType) for k, c in enumerate(keep)]
    out = T.StructType([T.StructField("doc", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()), *kinds])
    schema = to_arrow_schema(out)
    done = docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(tidy_groups(lambda a, b: removal(a, b, width, len(keep), schema)), out)
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")
    return done.select(doc_id, "spans", "kept", *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)))


def digests(deduped: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return deduped.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def readable(kept: Column) -> Column:
    """The bytes as text, without what a cut has left of a character (and without replacement characters)."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))
