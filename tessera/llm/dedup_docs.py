"""What both dedup operators on repeated passages share: documents dealt into buckets, and marked runs.

A document is known by (doc_id, version). Version is 0 where ids are unique;
rows that share an id are told apart by a digest of their text, and order by
it. Rows that agree in id and text are one document: each gets its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import long_hash, packed_rows, unpack_all

#: A run of windows: where the first begins in its document, how many there are, and how far the anchor lies behind the first.
MARK = np.dtype([("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("n", "<u4"), ("lead", "<u1")])
#: Stands for a null id; nulls order first.
NULL_ID = -(1 << 63)


def dealt(df: DataFrame, n_buckets: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """bucket, doc (never null), version, text, and the columns to keep as keep_0 and so on."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shared = df.groupBy(F.col(id_col)).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    version = F.lit(0) if shared.isEmpty() else F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int")
    return df.select(F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int").alias("bucket"), key.alias("doc"), version.alias("version"), text.alias("text"), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)))


def doc_bucket(doc: np.ndarray, n_buckets: int) -> np.ndarray:
    return (long_hash(doc) % n_buckets).astype(np.int32)


def mark_rows(marks: np.ndarray, kind: int, n_buckets: int) -> list[tuple[int, int, bytes]]:
    return packed_rows(doc_bucket(marks["doc"], n_buckets), kind, marks)


def merged(marks: np.ndarray) -> np.ndarray:
    """Runs of one document that touch become one."""
    if len(marks) < 2:
        return marks
    marks = marks[np.lexsort((marks["start"], marks["version"], marks["doc"]))]
    end = marks["start"].astype(np.int64) + marks["n"]
    new = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["version"][1:] != marks["version"][:-1]) | (marks["start"][1:] > end[:-1])
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    out = marks[first]
    out["n"] = (np.maximum.reduceat(end, first) - out["start"]).astype(np.uint32)
    return out


class Bucket:
    """The documents of one bucket, in order of (doc, version)."""

    def __init__(self, docs: pa.Table):
        doc, version = docs["doc"].to_numpy(), docs["version"].to_numpy().astype(np.uint32)
        self.order = np.lexsort((version, doc))
        self.doc, self.version = doc[self.order], version[self.order]
        self.texts = docs["text"]

    def text(self, k: int) -> bytes:
        return self.texts[int(self.order[k])].as_buffer().to_pybytes()

    def find(self, marks: np.ndarray) -> np.ndarray:
        """For each mark the number of its document here (the first, if rows are equal)."""
        at = np.searchsorted(self.doc, marks["doc"])
        for _ in range(len(self.doc)):  # rows that share an id lie next to each other; few steps
            off = self.version[at] != marks["version"]
            if not off.any():
                break
            at = at + off
        return at


def by_kind(table: pa.Table, kind: int) -> list[bytes]:
    kinds = table["kind"].to_numpy()
    return [table["data"][int(k)].as_py() for k in np.flatnonzero(kinds == kind)]


def covered_runs(bucket: Bucket, marks: np.ndarray, width: int) -> dict[int, list[tuple[int, int]]]:
    """For each document with marks: the maximal runs [a, b) that windows of this width cover, in order."""
    if not len(marks):
        return {}
    spread = marks.copy()
    spread["n"] += width - 1
    spread = merged(spread)
    out: dict[int, list[tuple[int, int]]] = {}
    for k, a, n in zip(bucket.find(spread).tolist(), spread["start"].tolist(), spread["n"].tolist()):
        out.setdefault(k, []).append((a, a + n))
    for k in list(out):  # equal rows share a result
        j = k + 1
        while j < len(bucket.doc) and bucket.doc[j] == bucket.doc[k] and bucket.version[j] == bucket.version[k]:
            out[j] = out[k]
            j += 1
    return out


__all__ = ["MARK", "Bucket", "by_kind", "covered_runs", "dealt", "doc_bucket", "mark_rows", "merged", "unpack_all"]
