"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into a ring of SEGMENTS segments. If two differ in at
most `limit` bits, then from some segment on the differences of every chain of
consecutive segments stay within the chain's share of that limit (limit /
SEGMENTS for each segment). So the chain's first segment is equal, the first
two differ in one bit at most and the first three in two; cutting the second
and third segment in halves, two halves in one of five choices are equal too.
That gives 25 keys of about 26 bits for a fingerprint. Pairs that share a key
have to pass the chain condition, then the full Hamming check.

Documents with one fingerprint are first made one row. Within a key only the
links that join its fingerprints are passed on, never all pairs; a key with
more than LARGE fingerprints is joined through common neighbours at two bits,
which is linear in their number.

Defined cases: a null or empty text has the fingerprint zero, linked like any
other; equal rows share fingerprint and component; a null id is never the
least of its component unless all ids in it are null; other columns aren't
read; an empty table gives an empty one.

one_of_each drops near copies by the similarity of their shingles instead. It
takes prints and keys as wide as that similarity needs (simhash_wide.py),
prunes by the same ring, and verifies on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_DDL, blob_rows, blob_table, bounded_batches, buckets, hash_bucket, joined, materialize, texts_of
from .components import components
from .rolling import mix, runs
from .simhash_wide import groups, shingle_hashes
from .suffix_dedup import grouped

#: Segments of the ring: (first bit, bits), 64 bits in all.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
LIMIT, SEED, SHINGLE = 4, 42, 4
#: Shingles whose bits are counted at once, and fingerprints of a key above which pairs aren't compared one by one.
BLOCK, LARGE = 1 << 14, 512
#: Numbers that a pass over a large key holds.
AT_ONCE = 1 << 22
KEYED = np.dtype([("key", "<u8"), ("fingerprint", "<u8")])
FLIPS = np.array([0, *(1 << a for a in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is set if it is set in more than half of the shingles' hashes; no words give zero."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a bigint), for each row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def part(x: np.ndarray, first: int, bits: int) -> np.ndarray:
    return (x >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def ring_keys(x: np.ndarray) -> Iterator[np.ndarray]:
    """The 25 keys: an equal segment, and two equal halves of the next two segments in the choices that their budgets leave."""
    for k in range(len(RING)):
        halves = [h for j in (1, 2) for first, bits in [RING[(k + j) % len(RING)]] for h in ((first, bits // 2), (first + bits // 2, bits - bits // 2))]
        for c, (a, b) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))):
            key = np.uint64(8 * k + c)
            for first, bits in (RING[k], halves[a], halves[b]):
                key = (key << np.uint64(bits)) | part(x, first, bits)
            yield key


def in_ring(difference: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Whether some chain around the whole ring keeps within its share of the limit at each step."""
    bits = [np.bitwise_count(part(difference, *s)).astype(np.int64) for s in RING]
    out = np.zeros(len(difference), bool)
    for k in range(len(RING)):
        good, total = np.ones(len(difference), bool), np.zeros(len(difference), np.int64)
        for n in range(1, len(RING) + 1):
            total = total + bits[(k + n - 1) % len(RING)]
            good &= total * len(RING) <= n * limit
        out |= good
    return out


def near(a: np.ndarray, b: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    difference = a ^ b
    k = np.flatnonzero(in_ring(difference, limit))
    return k[np.bitwise_count(difference[k]) <= limit]


class Forest:
    """Union-find that reports the links that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.links.append((min(p, q), max(p, q)))


def parities(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A number of len(masks) bits that is linear: that of x ^ y is the one of x ^ the one of y."""
    out = np.zeros(len(x), np.int64)
    for k, mask in enumerate(masks):
        out |= (np.bitwise_count(x & mask) & 1).astype(np.int64) << k
    return out


def link_large(x: np.ndarray, forest: Forest, at_once: int = AT_ONCE) -> None:
    """Two fingerprints differ in four bits at most exactly if some number lies within two bits of both.

    Numbers are taken in passes by their parities. As these are linear, a pass
    makes its own numbers and no others: each is made once in all.
    """
    passes = max(0, (-(-len(x) * len(FLIPS) // at_once) - 1).bit_length())
    masks = np.random.default_rng(SEED).integers(1, 1 << 63, passes, dtype=np.uint64)
    classes = range(1 << passes)
    by_class = lambda values: [np.flatnonzero(parities(values, masks) == c) for c in classes]
    owners, flips = by_class(x), by_class(FLIPS)
    for r in classes:
        at = [(x[owners[c], None] ^ FLIPS[flips[r ^ c]]).ravel() for c in classes]
        owner = np.concatenate([np.repeat(owners[c], len(flips[r ^ c])) for c in classes])
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        same = np.flatnonzero(at[1:] == at[:-1])
        pairs = np.unique(np.stack([owner[same], owner[same + 1]], 1), axis=0)
        for a, b in x[pairs].tolist():
            forest.join(a, b)


def linked(records: np.ndarray, forest: Forest, limit: int) -> None:
    """Joins the fingerprints of one bucket that share a key and are near."""
    records = np.unique(records)
    key, x = records["key"], records["fingerprint"]
    if len(x) < 2:
        return
    first, last = runs(key[1:] != key[:-1])
    size = last - first
    for a, b in zip(first[size > LARGE].tolist(), last[size > LARGE].tolist()):
        link_large(x[a:b], forest)
    small = np.repeat(size <= LARGE, size)
    for step in range(1, int(min(size.max(), LARGE))):
        k = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        if not len(k):
            break
        for j in k[near(x[k], x[k + step], limit)].tolist():
            forest.join(int(x[j]), int(x[j + step]))


def links(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that join the fingerprints of classes wherever a chain of near ones does."""
    spark = classes.sparkSession
    n, parts = buckets(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            records = np.empty(25 * len(x), KEYED)
            for k, key in enumerate(ring_keys(x)):
                records["key"][k * len(x) : (k + 1) * len(x)] = key
            records["fingerprint"] = np.tile(x, 25)
            yield from blob_table(blob_rows(hash_bucket(mix(records["key"]), n), 0, records)).to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for _, _, blobs in grouped(batches):
            linked(joined(blobs, KEYED), forest, limit)
            found = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
            forest = Forest()
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    if limit != LIMIT:
        raise ValueError(f"the keys are made for a limit of {LIMIT} bits")
    rows = classes.select("fingerprint").mapInArrow(keyed, BLOB_DDL).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return rows.mapInArrow(join, "a long, b long")


def simhash_dedup(df: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (bigint), component_id (the smallest doc_id that links reach), for each row."""
    prints = materialize(fingerprints(df, id_col, text_col, shingle))
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, limit)).select(F.col("node").alias("fingerprint"), "root")
    rooted = classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, similarity: tuple[int, int] = (4, 5), shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of texts whose shingles have at least the similarity (a fraction).

    Kept is the row of the least id (a null one only if all are null), then of
    the least text digest. Rows that share an id, or have none, go only if
    they are near copies. Texts without words (null ones too) are copies of
    each other; words are compared in lower case (ASCII).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in df.columns if c not in (id_col, text_col)]
    least = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others))))
    classes = df.groupBy(F.sha2(text, 256).alias("sha")).agg(least.alias("row"), F.first(text_col, ignorenulls=True).alias("whole"))
    classes = materialize(classes.withColumn("node", F.xxhash64("sha")))
    roots = groups(classes.select("node", F.coalesce("whole", F.lit("")).alias("text")), similarity, shingle)
    named = roots.join(classes.select("node", "sha", "row"), "node")
    first = named.groupBy("root").agg(F.min_by("node", F.struct("row.no_id", "row.id", "sha")).alias("node"))
    gone = roots.join(first.select("node"), "node", "left_anti").select("node")
    columns = {id_col: F.col("row.id"), text_col: F.col("whole")} | {c: F.col(f"row.c{k}") for k, c in enumerate(others)}
    return classes.join(gone, "node", "left_anti").select(*(columns[c].alias(c) for c in df.columns))
