"""Near-duplicate vectors through an inverted multi-index.

Vectors of unit length are cut in halves, and each half has its own codebook,
so that pairs of codewords form a grid of cells. Every vector is filed in its
cell, and looks through its nearest cells in the order of their summed
distances (the multi-sequence order). How many cells it visits is measured on
a bounded sample so that the target recall is met; all vectors in them are
verified by exact cosine products in double precision.

Equal vectors are first made one row. In a cell only counts and the links
that join its vectors are passed on, never all pairs; cells of many vectors
are split, and what visits them goes to each part.

Cells that share a codeword share a bucket, and a vector goes to each bucket
once, with what it visits there. Members of a bucket's cells come first and are
held; what visits them streams by in blocks, so a worker holds the members of
one bucket and a block, however many visitors there are. Buckets are taken in
passes, each of which moves about twice the vectors' bytes (PASS_BYTES at
least); its shuffle files go before the next.

Only the sample (SAMPLE rows), the codebooks and the sizes of large cells (at
most one number for each of the grid's cells, whose number is bounded) come
to the driver.

Defined cases: vectors that are null, zero, hold null or non-finite
components, have no vec_id or another length than most (the shorter, if
equally many) link with nothing; rows that share a vec_id are vectors of
their own; other columns aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, discard, joined, materialize, tidy
from .components import components
from .rolling import long_hash

#: Rows that codebooks and the number of visits are fitted on, rounds of fitting, and codewords of a half at most.
SAMPLE, ROUNDS, MOST_WORDS = 8000, 8, 512
#: Vectors that a cell should hold, vectors of a part of a large cell, and rows of a block of products.
CELL, PART, BLOCK = 64, 1024, 1024
#: Bytes that a pass may move in any case, and in times the vectors' bytes, before compression.
PASS_BYTES, PASS_SHARE = 256 << 20, 2
#: Numbers that a step of arrays holds at once, bytes of visitors in a block, and bytes of a batch that is sent.
STEP, BLOCK_BYTES, SENT_BYTES = 1 << 18, 8 << 20, 4 << 20
#: Recall to be met on the sample, and pairs of it that are enough to measure it on.
RECALL, PAIRS = 0.99, 200
SEED = 7


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances to codewords, but for the part that is equal for all of them."""
    return (words * words).sum(axis=1) - 2 * (x @ words.T)


@functools.lru_cache(maxsize=4)
def first_ranks(depth: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """Only these pairs of ranks can be among the first visits: all pairs of smaller ranks come before."""
    most = np.minimum(visits // np.arange(1, depth + 1), depth)
    i = np.repeat(np.arange(depth), most)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(most) - most, most)


class MultiIndex:
    """Codebooks of both halves, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, n: int, limit: float):
        rng = np.random.default_rng(SEED)
        x = units(sample.astype(np.float64))
        self.half = x.shape[1] // 2
        size = int(max(1, min(MOST_WORDS, len(x), 1 << round(np.log2(max(1.0, np.sqrt(n / CELL)))))))
        self.words = [self.codebook(part, size, rng) for part in (x[:, : self.half], x[:, self.half :])]
        self.size = size
        self.visits = self.measured(x, limit, rng)

    @staticmethod
    def codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
        words = x[rng.choice(len(x), size, replace=False)]
        for _ in range(ROUNDS):
            nearest = distances(x, words).argmin(axis=1)
            count = np.bincount(nearest, minlength=size)
            total = np.zeros_like(words)
            np.add.at(total, nearest, x)
            words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
        return words

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each row, nearest first."""
        depth = min(visits, self.size)
        i, j = first_ranks(depth, visits)
        step = max(1, STEP // len(i))
        return np.concatenate([self.nearest(x[k : k + step], visits, depth, i, j) for k in range(0, max(1, len(x)), step)])

    def nearest(self, x: np.ndarray, visits: int, depth: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = [distances(part, words) for part, words in zip((x[:, : self.half], x[:, self.half :]), self.words)]
        rank = [np.argsort(d, axis=1, kind="stable")[:, :depth] for d in near]
        sorted_ = [np.take_along_axis(d, r, 1) for d, r in zip(near, rank)]
        cost = sorted_[0][:, i] + sorted_[1][:, j]
        first = np.argsort(cost, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(rank[0][:, i] * self.size + rank[1][:, j], first, 1)

    def measured(self, x: np.ndarray, limit: float, rng: np.random.Generator) -> int:
        """Visits that find the target share of the sample's pairs and, by itself, of pairs made at the limit.

        Sampled pairs may all be closer than the limit, as in a large group of near copies; they can't stand for those at it.
        """
        a, b = [], []
        for k in range(0, len(x), BLOCK):
            i, j = np.nonzero(x[k : k + BLOCK] @ x.T >= limit)
            keep = i + k != j
            pick = np.flatnonzero(keep)
            pick = pick[rng.permutation(len(pick))[:PAIRS]]
            a.append(i[pick] + k)
            b.append(j[pick])
        a, b = np.concatenate(a), np.concatenate(b)
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        made = limit * x + np.sqrt(1 - limit * limit) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        cells = self.size * self.size
        visits = min(cells, 4)
        # Rows of a large group would stand for all others among the made pairs too: the rows that have no pair in the sample count by themselves.
        lone = np.setdiff1d(np.arange(len(x)), a)
        kinds = [(x[a], x[b]), (x, made), (x[lone], made[lone])]
        for left, right in ((p, q) for p, q in kinds if len(p)):
            own = self.order(right, 1)[:, 0]
            while visits < cells:
                found = np.concatenate([(self.order(left[k : k + BLOCK], visits) == own[k : k + BLOCK, None]).any(axis=1) for k in range(0, len(left), BLOCK)])
                if found.mean() >= RECALL:
                    break
                visits = min(cells, visits * 2)
        return visits


class Buckets:
    """Which buckets hold a cell's parts: cells of one first codeword, and of near numbers of the second one, share a bucket.

    So a vector, whose cells share codewords, goes to few buckets, and to each once.
    """

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n
        self.blocks = min(size, -(-n // size))
        self.parts = np.ones(size * size, np.int64)

    def split(self, large: dict[int, int]) -> None:
        """large: the parts of large cells."""
        for cell, times in large.items():
            self.parts[cell] = times

    def wanted(self, passes: int, turn: int) -> np.ndarray:
        """Whether a pass may hold parts of a cell, for all cells."""
        _, _, to = self.parts_of(np.arange(self.size * self.size), np.ones(1, np.int64))
        return (to % passes == turn) | (self.parts > 1)

    def parts_of(self, cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, part, bucket) of each cell's first parts, times of them."""
        times = np.broadcast_to(times, cell.shape)
        cell = np.repeat(cell.astype(np.int64), times)
        part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
        block = (cell // self.size) * self.blocks + cell % self.size * self.blocks // self.size
        return cell, part, long_hash(block * 65_536 + part) % self.n

    def places(self, cells: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, part, bucket) of all parts of the (wanted) cells that each row visits."""
        row, at = np.nonzero(np.ones(cells.shape, bool) if wanted is None else wanted[cells])
        times = self.parts[cells[row, at]]
        return np.repeat(row, times), *self.parts_of(cells[row, at], times)

    def slices(self, cells: np.ndarray) -> Iterator[slice]:
        """Runs of rows that have about STEP places at most, but for rows that have more by themselves."""
        total = np.cumsum(self.parts[cells].sum(axis=1))
        start = 0
        while start < len(cells):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + STEP, "right")))
            yield slice(start, stop)
            start = stop

    def copies(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket), each pair once."""
        row, _, _, to = self.places(cells)
        both = np.unique(row * self.n + to)
        return both // self.n, both % self.n


def record(dim: int, visits: int, number: str) -> np.dtype:
    """A vector with the cells it visits, as members need them; those that only visit go without (visits is 0)."""
    return np.dtype([("node", "<i8"), ("n", "<i8"), ("own", "<i4"), ("cells", "<i4", (visits,)), ("vector", number, (dim,))])


#: What the row of a blob visits in its bucket.
PLACE = np.dtype([("row", "<i4"), ("cell", "<i4"), ("part", "<i4")])
#: kind is 0 for blobs of members, 1 for those of vectors that only visit.
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("places", pa.binary())])
SENT_DDL = "bucket int, kind int, data binary, places binary"
MEMBERS, VISITORS = 0, 1


def sent(records: np.ndarray, visitor: np.dtype, where: Buckets, passes: int, turn: int, wanted: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of SENT: the records by bucket, each once, with the places they visit there."""
    for rows in where.slices(records["cells"]):
        own = records[rows]
        row, cell, part, to = where.places(own["cells"], wanted)
        keep = to % passes == turn
        row, cell, part, to = row[keep], cell[keep], part[keep], to[keep]
        if not len(row):
            continue
        member = (cell == own["own"][row]) & (long_hash(own["node"][row]) % where.parts[cell] == part)
        pairs, pair = np.unique(to * len(own) + row, return_inverse=True)
        kind = np.full(len(pairs), VISITORS)
        kind[pair[member]] = MEMBERS
        groups, group = np.unique(pairs // len(own) * 2 + kind, return_inverse=True)
        order, counts = np.argsort(group, kind="stable"), np.bincount(group)
        nth = np.empty(len(pairs), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = np.empty(len(row), PLACE)
        places["row"], places["cell"], places["part"] = nth[pair], cell, part
        places = np.split(places[np.argsort(group[pair], kind="stable")], np.cumsum(np.bincount(group[pair]))[:-1])
        for key, which, visited in zip(groups.tolist(), np.split(order, np.cumsum(counts)[:-1]), places):
            data = own[pairs[which] % len(own)]
            bucket, what = divmod(key, 2)
            if what == VISITORS:
                slim = np.empty(len(data), visitor)
                for name in ("node", "n", "own", "vector"):
                    slim[name] = data[name]
                data = slim
            yield bucket, what, data.tobytes(), visited.tobytes()


def batched(rows: Iterator[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of SENT of about SENT_BYTES."""
    held, size = [], 0
    for one in rows:
        held.append(one)
        size += len(one[2]) + len(one[3])
        if size >= SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SENT)], schema=SENT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SENT)], schema=SENT)


def spans_of(places: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((cell, part), rows) of each place."""
    order = np.lexsort((places["part"], places["cell"]))
    places = places[order]
    change = np.flatnonzero((np.diff(places["cell"]) != 0) | (np.diff(places["part"]) != 0)) + 1
    for own in np.split(places, change):
        if len(own):
            yield (int(own["cell"][0]), int(own["part"][0])), own["row"]


class Bucket:
    """Members of one bucket's cells; visitors are compared with them block by block."""

    def __init__(self, member: np.dtype, visitor: np.dtype, parts: np.ndarray, limit: float):
        self.kinds, self.parts, self.limit = (member, visitor), parts, limit
        self.blobs, self.size, self.kind, self.members = [], 0, MEMBERS, None

    def add(self, kind: int, data: bytes, places: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if kind != self.kind:
            yield from self.flush()
            self.kind = kind
        self.blobs.append((data, places))
        self.size += len(data) + len(places)
        if kind == VISITORS and self.size >= BLOCK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Compares what is held with the members; members themselves visit their own and other places."""
        blobs, self.blobs, self.size = self.blobs, [], 0
        if not blobs:
            return
        kind = self.kinds[self.kind]
        records = joined([d for d, _ in blobs], kind)
        places = np.frombuffer(b"".join(p for _, p in blobs), PLACE).copy()
        counts = np.array([len(d) // kind.itemsize for d, _ in blobs])
        places["row"] += np.repeat(np.cumsum(counts) - counts, [len(p) // PLACE.itemsize for _, p in blobs]).astype(np.int32)
        del blobs
        if self.kind == MEMBERS:
            own, node = records["own"][places["row"]], records["node"][places["row"]]
            member = (places["cell"] == own) & (long_hash(node) % self.parts[places["cell"]] == places["part"])
            self.members = {place: records[rows] for place, rows in spans_of(places[member])}
        for place, rows in spans_of(places):
            members = (self.members or {}).get(place)
            if members is not None:
                yield from verified(records, rows, members, self.limit)


def unpacked(batch: pa.RecordBatch, visits: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("cells").to_pylist()), "<i4").reshape(-1, visits)


def vectors_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def verified(records: np.ndarray, rows: np.ndarray, members: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) of the records in these rows and a part's members: n links of a (b is 0), or a and b are joined (n is 0)."""
    y = units(members["vector"].astype(np.float64))
    step = max(1, STEP // max(1, members["cells"].shape[1]))
    for k in range(0, len(rows), BLOCK):
        probes = records[rows[k : k + BLOCK]]
        linked = (units(probes["vector"].astype(np.float64)) @ y.T >= limit) & (probes["node"][:, None] != members["node"])
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        # A member that visits the probe's cell itself counts the probe there.
        unseen = np.concatenate([~(members["cells"][j[s : s + step]] == probes["own"][i[s : s + step], None]).any(axis=1) for s in range(0, len(i), step)])
        to_probe = np.bincount(i, members["n"][j], len(probes)).astype(np.int64)
        to_member = np.bincount(j[unseen], probes["n"][i[unseen]], len(members)).astype(np.int64)
        for nodes, n in ((probes["node"], to_probe), (members["node"], to_member)):
            yield nodes[n > 0], np.zeros((n > 0).sum(), np.int64), n[n > 0]
        low_probe, low_member = probes["node"].copy(), members["node"].copy()
        while True:
            before = low_probe.copy(), low_member.copy()
            np.minimum.at(low_probe, i, low_member[j])
            np.minimum.at(low_member, j, low_probe[i])
            if np.array_equal(low_probe, before[0]) and np.array_equal(low_member, before[1]):
                break
        for nodes, low in ((probes["node"], low_probe), (members["node"], low_member)):
            at = nodes != low
            yield nodes[at], low[at], np.zeros(at.sum(), np.int64)


def embedding_dedup(df: DataFrame, limit: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row."""
    spark = df.sparkSession
    bounded_batches(spark)
    number = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))
    length = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not length:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    dim = length[0].d
    usable = usable.where(F.size("embedding") == dim)
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.xxhash64("first", "embedding")))
    if classes.groupBy("first").count().where("count > 1").limit(1).isEmpty():  # ids are their own node, unless rows share one
        classes = classes.withColumn("node", F.col("first"))
    n = classes.count()
    sample = np.array([r.embedding for r in classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()], np.float64)
    index = spark.sparkContext.broadcast(MultiIndex(sample, n, limit))
    n_buckets, parts = buckets(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = index.value.visits
    kind, visitor = (record(dim, v, "<f4" if number == "float" else "<f8") for v in (visits, 0))

    buckets_of = Buckets(index.value.size, n_buckets)

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.value.order(units(vectors_of(batch, dim).astype(np.float64)), visits)
            data = pa.array([row.tobytes() for row in cells.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, "cells"])

    placed = materialize(classes.select("first", "n", "node", "embedding").mapInArrow(tidy(placing), f"first long, n long, node long, embedding array<{number}>, cells binary"))
    discard(classes)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(unpacked(batch, visits)[:, 0]), pa.int32())], ["cell"])

    large = placed.select("cells").mapInArrow(cells_of, "cell int").groupBy("cell").count().where(F.col("count") > PART)
    # One number for each cell of the grid at most; large cells only.
    buckets_of.split({r.cell: -(-r["count"] // PART) for r in large.collect()})
    moves = 0
    for k in range(0, len(sample), BLOCK):
        cells = index.value.order(units(sample[k : k + BLOCK]), visits)
        for rows_of in buckets_of.slices(cells):
            moves += len(buckets_of.copies(cells[rows_of])[0]) * visitor.itemsize + int(buckets_of.parts[cells[rows_of]].sum()) * PLACE.itemsize
    moves = (moves / len(sample) + visits * 4) * n
    passes = min(n_buckets, max(1, math.ceil(moves / max(PASS_BYTES, PASS_SHARE * dim * kind["vector"].base.itemsize * n))))

    def filed(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        wanted = buckets_of.wanted(passes, turn)
        for batch in batches:
            cells = unpacked(batch, visits)
            out = np.zeros(len(cells), kind)
            out["node"], out["n"], out["vector"] = batch.column("node").to_numpy(), batch.column("n").to_numpy(), vectors_of(batch, dim)
            out["own"], out["cells"] = cells[:, 0], cells
            yield from batched(sent(out, visitor, buckets_of, passes, turn, wanted))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for batch in batches:
            for number_, what, data, places in zip(*(batch.column(c) for c in SENT.names)):
                if number_.as_py() != at:
                    if bucket:
                        yield from linked(bucket.flush())
                    at, bucket = number_.as_py(), Bucket(kind, visitor, buckets_of.parts, limit)
                yield from linked(bucket.add(what.as_py(), data.as_py(), places.as_py()))
        if bucket:
            yield from linked(bucket.flush())

    def linked(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for arrays in found:
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["a", "b", "n"])

    found = None
    for turn in range(passes):
        moved = placed.select("node", "n", "embedding", "cells").mapInArrow(tidy(lambda batches, turn=turn: filed(batches, turn)), SENT_DDL)
        moved = moved.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
        part = materialize(moved.mapInArrow(tidy(compare), "a long, b long, n long"))
        found = part if found is None else found.unionByName(part)
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0"))
    named = placed.drop("cells").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = usable.join(named, "embedding").select("vec_id", "n_links", "component_id")
    odd = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim) | ~F.coalesce(finite, F.lit(False)) | ~F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rest = rows.where(odd).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
