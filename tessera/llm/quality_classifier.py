"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted into terms: its words and the three-byte strings in it
(both hashed), its patterns of two letters (letters by kind, marks by
themselves), and its repeats of words at short distances. Terms are weighted
by their share of the text and by how rare they are among the labelled rows
(TF-IDF), and projected on the leading singular vectors of a bounded sample of
them. The sample's vectors are broadcast; every document gets its exact cosine
with each of them, block by block, and its nearest neighbours vote for their
label in proportion to their similarity.

The cosine is that of the whole weighted text, not of its projection alone: a
text whose terms the sample doesn't know is like none of it. Where all votes
together weigh less than FLOOR of what they do for nearly all of the sample
(each row without its own vote), the rest counts for label 0; of a text of
fewer than ENOUGH words less is asked, in proportion.

Only the terms and labels of the sample come to the driver: at most
2 * SAMPLE rows, the first of each label by a hash of doc_id, each with
N_FEATURES numbers at most. Labels, lang, source and doc_id are no inputs of a
score.

Defined cases: a null or empty text has no terms and no neighbours and gets
the sample's share of label 1; without usable labels every score is 0.5; rows
of `labels` that disagree on a document or hold null or other values than 0
and 1 are left out; a null doc_id is not held out and has no label; whole
texts count, however long; equal rows get equal scores; extra columns aren't
read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, give_back, texts_of, tidy
from .rolling import byte_spans

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 1000
#: Rows of the sample that the driver holds unpacked at once while it fits.
ROWS = 256
#: Dimensions of the latent space, neighbours that vote, and documents whose cosines are taken at once.
RANK, NEIGHBOURS, BLOCK = 64, 15, 128
#: Hashed words and hashed three-byte strings, and the parts of the weighted text that patterns, strings and words have.
STRINGS, WORDS = 1 << 13, 1 << 13
PARTS = (0.5, 0.25, 0.25)
#: Power of a similarity that votes, the share of the sample's usual weight below which a text is like none of it, and the words from which that holds in full.
POWER, USUAL, FLOOR, ENOUGH = 4, 0.02, 0.5, 40
#: Kinds of bytes: small letters, capitals, digits, spaces, line feeds, controls, bytes beyond ASCII; each mark is its own.
SMALL, CAPITAL, DIGIT, SPACE, LINE, CONTROL, WIDE = range(7)
#: Distances between equal words that are counted, and the weight of that count.
LAGS, LAG_WEIGHT = (1, 2, 3), 4.0


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, -1)
    kinds[[*range(32), 127]] = CONTROL
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = SMALL, CAPITAL, DIGIT
    kinds[[9, 11, 12, 13, 32]], kinds[10], kinds[128:] = SPACE, LINE, WIDE
    rest = np.flatnonzero(kinds < 0)
    kinds[rest] = WIDE + 1 + np.arange(len(rest))
    return kinds


KINDS = byte_kinds()
N_KINDS = int(KINDS.max()) + 1
N_PATTERNS = N_KINDS * N_KINDS + len(LAGS)
N_FEATURES = N_PATTERNS + STRINGS + WORDS
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def features(text: str) -> np.ndarray:
    """Counts of the text's patterns, repeated words, strings and words."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(N_FEATURES, np.float32)
    if not len(data):
        return out
    kinds = KINDS[data]
    out[: N_KINDS * N_KINDS] = np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    space = SPACES[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    words = byte_spans(data).of(begin, end)
    for k, lag in enumerate(LAGS):
        out[N_KINDS * N_KINDS + k] = LAG_WEIGHT * np.count_nonzero(words[lag:] == words[:-lag])
    wide = data.astype(np.uint32)
    strings = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - STRINGS.bit_length() + 1)
    out[N_PATTERNS : N_PATTERNS + STRINGS] = np.bincount(strings, minlength=STRINGS)
    out[N_PATTERNS + STRINGS :] = np.bincount((words >> np.uint64(33)).astype(np.int64) % WORDS, minlength=WORDS)
    return out


def shares(counts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Square roots of each row's shares in each part, so that frequent terms don't drown rare ones. `out` may be the counts."""
    out = np.empty(counts.shape, np.float32) if out is None else out
    cuts = (0, N_PATTERNS, N_PATTERNS + STRINGS, N_FEATURES)
    for part, a, b in zip(PARTS, cuts, cuts[1:]):
        own = counts[:, a:b]
        np.sqrt(own * (part / np.maximum(own.sum(axis=1, keepdims=True), 1)), out=out[:, a:b])
    return out


def packed(counts: np.ndarray) -> bytes:
    """The counts that aren't zero, after their numbers."""
    some = np.flatnonzero(counts)
    return some.astype("<u4").tobytes() + counts[some].astype("<f4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out, half = np.zeros(N_FEATURES, np.float32), len(data) // 2
    out[np.frombuffer(data[:half], "<u4")] = np.frombuffer(data[half:], "<f4")
    return out


def length(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Model:
    """Latent space and labelled vectors of a bounded sample."""

    def __init__(self, rows: list[bytes], labels: np.ndarray):
        """rows: packed counts, of which ROWS are unpacked at once."""
        seen = np.zeros(N_FEATURES)
        for data in rows:
            seen[np.frombuffer(data[: len(data) // 2], "<u4")] += 1
        self.weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(1)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float64)
        if len(set(labels.tolist())) < 2:
            self.axes, self.vectors = np.zeros((N_FEATURES, 1), np.float32), np.zeros((0, 1))
            return
        cuts = range(0, len(rows), ROWS)
        products = np.empty((len(rows), len(rows)))
        for a in cuts:
            own = self.weighted(rows[a : a + ROWS])
            for b in range(0, a + 1, ROWS):
                product = own @ (own if a == b else self.weighted(rows[b : b + ROWS])).T
                products[a : a + ROWS, b : b + ROWS] = product
                products[b : b + ROWS, a : a + ROWS] = product.T
        values, left = np.linalg.eigh(products)
        del products
        top = np.argsort(-values)[:RANK]
        top = top[values[top] > 1e-9]
        parts = (left[:, top] / np.sqrt(values[top])).astype(np.float32)
        del left
        self.axes = sum(self.weighted(rows[a : a + ROWS]).T @ parts[a : a + ROWS] for a in cuts)
        self.vectors = np.concatenate([self.weighted(rows[a : a + ROWS]) @ self.axes for a in cuts]).astype(np.float64)
        own = self.vectors.copy()
        self.vectors /= length(self.vectors)
        cosine = own @ self.vectors.T
        np.fill_diagonal(cosine, 0)
        self.floor = FLOOR * float(np.quantile(self.votes(cosine)[0].sum(axis=1), USUAL))

    def weighted(self, rows: list[bytes]) -> np.ndarray:
        """Rows of unit length."""
        out = np.array([unpacked(data) for data in rows])
        shares(out, out)
        out *= self.weights
        out /= length(out)
        return out

    def votes(self, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of each row's nearest neighbours, and their labels."""
        n = min(NEIGHBOURS, cosine.shape[1])
        best = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
        return np.maximum(np.take_along_axis(cosine, best, 1), 0) ** POWER + 1e-12, self.labels[best]

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.sum(axis=1) > 0)
        if not len(self.vectors) or not len(some):
            return out
        for a in range(0, len(some), BLOCK):
            k = some[a : a + BLOCK]
            weighted = shares(counts[k]) * self.weights
            weight, label = self.votes((weighted @ self.axes) / length(weighted) @ self.vectors.T)
            asked = self.floor * np.minimum(counts[k, N_PATTERNS + STRINGS :].sum(axis=1) / ENOUGH, 1)
            out[k] = (weight * label).sum(axis=1) / np.maximum(weight.sum(axis=1), asked)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits the model on at most SAMPLE rows of each label that aren't held out."""
    bounded_batches(documents.sparkSession)
    usable = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"), F.count(F.when(F.col(label_col).isNull(), 1)).alias("empty")).where("low = high AND low IN (0, 1) AND empty = 0")
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("low") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", F.col("low").cast("int").alias("label"))
        chosen = part if chosen is None else chosen.unionByName(part)
    # The sample has 2 * SAMPLE rows at most, so it may be broadcast.
    rows = texts_of(documents, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [packed(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.binary()), batch.column("label")], ["doc_id", "counts", "label"])

    # Rows that share an id give one row of the sample.
    found = rows.mapInArrow(tidy(run), "doc_id long, counts binary, label int").groupBy("doc_id").agg(F.min("counts").alias("counts"), F.first("label").alias("label")).orderBy("doc_id").collect()
    model = Model([bytes(r.counts) for r in found], np.array([r.label for r in found], np.int64))
    del found
    give_back()
    return model


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns of keep, for each row."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, score = batch.column(1), np.empty(batch.num_rows)
            for k in range(0, len(score), BLOCK):
                score[k : k + BLOCK] = shared.value.score(np.array([features(t) for t in texts.slice(k, BLOCK).to_pylist()], np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(score)], schema.names)

    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *kept)
    schema = StructType([f for f in rows.schema.fields if f.name != "text"] + [StructField("score", DoubleType())])
    scored = rows.mapInArrow(tidy(run), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)))
