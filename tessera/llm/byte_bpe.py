"""Byte-level BPE encoding and decoding.

Merges are compiled into a lazily determinised finite-state transducer
(transducer.py) that emits tokens after bounded lookahead; decoding streams
token bytes through an incremental UTF-8 state machine.

Defined cases: a null or empty text has no ids and decodes to an empty text;
rows with equal ids or texts are independent; an empty table gives an empty
one; columns other than the two named ones aren't read.
"""

from __future__ import annotations

import base64
import codecs
import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts_of
from .transducer import MergeTransducer
from .units import Generations, UnitCache

#: Tokens that decoding passes on at a time.
DECODE_BLOCK = 8192


class ByteBPE:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.transducer = MergeTransducer(self.tokens, lambda a, b: self.tokens.get(a + b))
        self.pieces = regex.compile(pattern).findall
        self.known = Generations(self.encode_piece)
        self.units = UnitCache(self.cut_and_encode)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        symbols = piece.encode().decode("latin-1")
        whole = self.tokens.get(symbols)
        return (whole,) if whole is not None else tuple(self.transducer.encode(symbols))

    def cut_and_encode(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of the text, each match of the pattern encoded separately."""
        known = self.units.of(text)
        return list(chain.from_iterable(known)) if known is not None else list(self.cut_and_encode(text))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, block by block; a code point that a block cuts waits for the next one."""
        machine, it = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while block := [self.bytes[i] for _, i in zip(range(DECODE_BLOCK), it)]:
            yield machine.decode(b"".join(block))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string, for each row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of what encode_decode gives."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
