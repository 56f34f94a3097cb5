"""Wide SimHash prints, and the groups of texts that are alike by their shingles.

Two texts of Jaccard similarity s differ in about a share of acos(2s / (1 + s))
/ pi of their prints' bits: 0.15 at s = 0.8, too many for keys cut from 64
bits. So a print is as wide as its keys need. Each key is a run of bits of the
print, long enough to tell the corpus's texts apart (its length grows with
their number), and there are so many keys that a pair at exactly the limit has
none in common with a probability of MISS only.

1. Texts that share a key have to pass the pigeonring condition, then the full
   Hamming check, on the print's first bits. What has no partner is done.
2. Each remaining text is verified against the centre of its key (the text
   nearest to the majority of the key's prints): by exact Jaccard similarity.
3. Groups that still share a key and could have links between them are a
   family; it is compared block by block, so each pair is looked at once and
   only the links that join something are passed on.

Shingles are compared by their XXH64.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_DDL, blob_rows, blob_table, bounded_batches, buckets, hash_bucket, joined, materialize, tidy, tidy_groups
from .components import components
from .rolling import mix, runs
from .suffix_dedup import grouped

SEED = 42
#: Chance that a pair at the limit shares no key, fewest bits of a key, and bits from one key's begin to the next one's.
MISS, LEAST_BITS, STRIDE = 0.001, 16, 12
#: Words of 64 bits of a print that go with each key (a ring of segments of 32 bits), and steps of a chain that are looked at.
CHECKED, CHAIN = 2, 2
#: Standard deviations that a pair at the limit may lie above its mean number of differing bits.
ROOM = 3.5
#: Groups of a key that are compared pair by pair, step by step and in a matrix; larger ones only with their centre.
STEPS, MATRIX = 16, 2048
#: Texts of a block of a family.
BLOCK = 1024
KEYED = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<u4"), ("print", "<u8", (CHECKED,))])


class Plan:
    """Keys and limits for a number of texts and a similarity."""

    def __init__(self, n: int, similarity: tuple[int, int]):
        s = similarity[0] / similarity[1]
        self.similarity = similarity
        self.flip = math.acos(2 * s / (1 + s)) / math.pi
        self.bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n))))
        self.keys = math.ceil(math.log(MISS) / math.log1p(-((1 - self.flip) ** self.bits)))
        self.words = -(-((self.keys - 1) * STRIDE + self.bits) // 64)
        checked = 64 * CHECKED
        self.limit = math.ceil(checked * self.flip + ROOM * math.sqrt(checked * self.flip * (1 - self.flip)))

    def near(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether prints pass the chain condition, then the Hamming check, and sizes allow the similarity."""
        top, bottom = self.similarity
        good = np.minimum(size_a, size_b).astype(np.int64) * bottom >= np.maximum(size_a, size_b).astype(np.int64) * top
        bits = np.bitwise_count((a ^ b).view(np.uint32)).astype(np.int16)
        n = bits.shape[-1]
        chain, total = bits * n <= self.limit, bits
        for step in range(1, CHAIN):
            total = total + np.roll(bits, -step, axis=-1)
            chain &= total * n <= (step + 1) * self.limit
        return good & chain.any(axis=-1) & (bits.sum(axis=-1) <= self.limit)


def shingle_hashes(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle in order, its words (ASCII lower case) joined by a space; fewer words are one shingle, none give nothing."""
    words = text.encode().lower().split()
    joint = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    last = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joint[a : b - 1], seed) for a, b in zip(starts, starts[last:])), np.uint64, len(words) - last + 1 if words else 0)


def shingles(text: str, size: int) -> np.ndarray:
    """Ascending hashes of the text's distinct shingles; a text without words has one of its own."""
    found = shingle_hashes(text, size)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


@functools.lru_cache(4)
def factors(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits that more than half of the hashes have, each hash spread over `words` words."""
    counts = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255):
        x = hashes[k : k + 255, None] * factors(words)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def keys_of(prints: np.ndarray, plan: Plan) -> np.ndarray:
    """The keys of each print, with the key's number in them."""
    wide = np.concatenate([prints, np.zeros((len(prints), 1), np.uint64)], axis=1)
    out = np.empty((len(prints), plan.keys), np.uint64)
    mask = np.uint64((1 << plan.bits) - 1)
    for k in range(plan.keys):
        word, shift = divmod(k * STRIDE, 64)
        key = wide[:, word] >> np.uint64(shift)
        if shift:
            key = key | (wide[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = (key & mask) * np.uint64(1 << 12) + np.uint64(k)
    return mix(out)


def partners(records: np.ndarray, plan: Plan) -> np.ndarray:
    """(record, centre) of the records of a bucket that may be similar to another one of their key."""
    records = records[np.argsort(records["key"], kind="stable")]
    key = records["key"]
    first, last = runs(key[1:] != key[:-1])
    size = np.repeat(last - first, last - first)
    records, size = records[size > 1], size[size > 1]
    if not len(records):
        return np.empty(0, ACTIVE)
    key, x, n = records["key"], records["print"], records["size"]
    active, centre = np.zeros(len(records), bool), np.arange(len(records))
    low = size <= STEPS
    for step in range(1, STEPS):
        k = np.flatnonzero((key[step:] == key[:-step]) & low[step:])
        if not len(k):
            break
        k = k[plan.near(x[k], x[k + step], n[k], n[k + step])]
        active[k] = active[k + step] = True
        np.minimum.at(centre, k + step, k)
    first, last = runs(key[1:] != key[:-1])
    for a, b in zip(*((e[last - first > STEPS]).tolist() for e in (first, last))):
        own, sizes = x[a:b], n[a:b]
        bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > b - a).view(np.uint64)
        c = int(np.bitwise_count(own ^ middle).sum(axis=1).argmin())
        to_centre = plan.near(own, own[c], sizes, sizes[c])
        centre[a:b][to_centre] = a + c
        if b - a > MATRIX:
            active[a:b] = True
            continue
        for k in range(0, b - a, 128):
            near = plan.near(own[k : k + 128, None], own[None], sizes[k : k + 128, None], sizes[None])
            near[np.arange(len(near)), np.arange(k, k + len(near))] = False
            found = near.any(axis=1)
            active[a + k : a + k + len(near)] = found
            lone = np.flatnonzero(found & ~to_centre[k : k + 128])
            centre[a + k + lone] = a + near[lone].argmax(axis=1)
    out = np.empty(len(records), ACTIVE)
    for name in records.dtype.names:
        out[name] = records[name]
    out["centre"] = records["node"][centre]
    return out[active]


ACTIVE = np.dtype([*KEYED.descr, ("centre", "<i8")])
ACTIVE_DDL = "key long, node long, size long, p0 long, p1 long, centre long"


def active_rows(texts: DataFrame, plan: Plan, shingle: int) -> DataFrame:
    """key, node, size, print and centre, for each key that a text (node, text) shares with one that may be similar."""
    spark = texts.sparkSession
    n, parts = buckets(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
            if not found:
                continue
            prints = np.array([wide_print(h, plan.words) for h in found])
            records = np.empty((len(found), plan.keys), KEYED)
            records["key"], records["node"] = keys_of(prints, plan), batch.column("node").to_numpy()[:, None]
            records["size"], records["print"] = np.array([len(h) for h in found])[:, None], prints[:, None, :CHECKED]
            records = records.ravel()
            yield from blob_table(blob_rows(hash_bucket(records["key"], n), 0, records)).to_batches()

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, blobs in grouped(batches):
            own = partners(joined(blobs, KEYED), plan)
            columns = [own["key"].view(np.int64) if len(own) else own["key"].astype(np.int64), own["node"], own["size"].astype(np.int64), *own["print"].T.astype(np.uint64).view(np.int64), own["centre"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], [f.split()[0] for f in ACTIVE_DDL.split(", ")])

    rows = texts.select("node", "text").mapInArrow(tidy(keyed), BLOB_DDL).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return materialize(rows.mapInArrow(tidy(matched), ACTIVE_DDL))


def sets_of(texts: DataFrame, active: DataFrame, shingle: int) -> DataFrame:
    """node, and its shingles packed as binary, for the nodes of active."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    return materialize(texts.select("node", "text").join(active.select("node").distinct(), "node", "left_semi").mapInArrow(tidy(run), "node long, shingles binary"))


def similar(a: np.ndarray, others: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which of the others have at least the similarity with a."""
    sizes = np.array([len(o) for o in others])
    joint = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, joint), len(a) - 1)
    both = np.add.reduceat((a[at] == joint).astype(np.int64), np.cumsum(sizes) - sizes)
    return both * similarity[1] >= (len(a) + sizes - both) * similarity[0]


def hashes(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [bool(similar(hashes(x), [hashes(y)], plan.similarity)[0]) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def bridges(rows: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) between roots of which some texts share a key and pass the checks; enough of them to join what belongs together."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in ("key", "size", "root")}
        prints = np.stack([table[c].to_numpy().view(np.uint64) for c in ("p0", "p1")], axis=1)
        order = np.argsort(columns["key"], kind="stable")
        key, size, root, prints = columns["key"][order], columns["size"][order], columns["root"][order], prints[order]
        edges = []
        for a, b in zip(*runs(key[1:] != key[:-1])):
            names, own, often = np.unique(root[a:b], return_inverse=True, return_counts=True)
            if b - a > MATRIX:  # one family, rather than all pairs
                edges += [(names[0], x) for x in names[1:]]
                continue
            # Texts of the largest root come last: they needn't be compared with each other.
            last = np.argsort(own == often.argmax(), kind="stable")
            own, x, n = own[last], prints[a:b][last], size[a:b][last]
            part = np.arange(len(names))
            for k in range(b - a - int(often.max())):
                near = np.flatnonzero(part[own[k + 1 :]] != part[own[k]]) + k + 1
                near = near[plan.near(x[k], x[near], n[k], n[near])]
                for j in np.unique(own[near]).tolist():
                    if part[own[k]] != part[j]:
                        edges.append((names[own[k]], names[j]))
                        part[part == part[j]] = part[own[k]]
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    n = buckets(rows.sparkSession)
    return rows.join(mixed, "key").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n))).groupBy("bucket").applyInArrow(tidy_groups(run), "a long, b long")


def across(members: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that join the roots of a family; members: node, root, family, size, p0, p1."""
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = members.join(blocks, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "root", "family", "size", "p0", "p1", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        node, root, own, size = (table[c].to_numpy() for c in ("node", "root", "own", "size"))
        prints = np.stack([table[c].to_numpy().view(np.uint64) for c in ("p0", "p1")], axis=1)
        data = [hashes(x) for x in table["shingles"]]
        one_block = table["low"][0].as_py() == table["high"][0].as_py()
        names, of = np.unique(root, return_inverse=True)
        part, links = np.arange(len(names)), []
        for k in np.argsort(node, kind="stable"):
            near = np.flatnonzero((node > node[k]) & (part[of] != part[of[k]]) & (one_block | (own != own[k])))
            near = near[plan.near(prints[k], prints[near], size[k], size[near])]
            if len(near):
                for j in near[similar(data[k], [data[j] for j in near], plan.similarity)].tolist():
                    if part[of[j]] != part[of[k]]:
                        links.append((node[k], node[j]))
                        part[part == part[of[j]]] = part[of[k]]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("family", "low", "high").applyInArrow(tidy_groups(run), "a long, b long")


def groups(texts: DataFrame, similarity: tuple[int, int] = (4, 5), shingle: int = 5) -> DataFrame:
    """node, root (the least node that links reach), for each of texts (node, text) that is similar to another."""
    bounded_batches(texts.sparkSession)
    plan = Plan(texts.count(), similarity)
    active = active_rows(texts, plan, shingle)
    sets = sets_of(texts, active, shingle)
    links = materialize(verified(active.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), sets, plan))
    roots = components(links)
    rooted = materialize(active.drop("centre").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    family = components(bridges(rooted, plan)).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = materialize(rooted.select("node", "root", "size", "p0", "p1").distinct().join(family, "root"))
    more = materialize(across(members, sets, plan))
    return components(links.unionByName(more))
