"""Scalar expressions on text, with Unicode white space as Python's str has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import formats

# The code points that Python's str takes as white space, as a character class and one by one.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """One space for each run of white space, stripped, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, f"{SPACE}+", " ")))


def estimate_tokens(text: Column, chars_per_token: float = formats.CHARS_PER_TOKEN) -> Column:
    return tokens_of_length(F.length(text), chars_per_token)


def tokens_of_length(chars: Column, chars_per_token: float = formats.CHARS_PER_TOKEN) -> Column:
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be positive")
    return F.ceil(chars / F.lit(float(chars_per_token))).cast("int")


def stable_rank(value: Column) -> Column:
    """SHA-256 in hexadecimal: an order that needs no seed."""
    return F.sha2(value.cast("string"), 256)


def stripped_texts(texts: Column) -> Column:
    """Elements stripped, blank and null ones dropped."""
    return F.filter(F.transform(texts, strip), lambda t: t.isNotNull() & (t != ""))


def or_default(value: Column, default: str, empty_too: bool = True) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")) if empty_too else value, F.lit(default))


def heading_label(path: Column) -> Column:
    """Readable label of a heading path: JSON list, JSON scalar, free text, or nothing.

    List elements and scalars read as Python prints them, but for objects,
    which keep their JSON text.
    """
    raw = strip(F.coalesce(path, F.lit("")))
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    quoted = F.variant_get(value, "$", "string")
    spoken = lambda t: F.when(t == "true", "True").otherwise("False")

    def element(v: Column) -> Column:
        text = F.variant_get(v, "$", "string")
        return F.when(F.is_variant_null(v), "None").when(F.schema_of_variant(v) == "BOOLEAN", spoken(text)).otherwise(text)

    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), element)
    listed = F.array_join(stripped_texts(parts), formats.HEADING_JOINT)
    label = F.when(value.isNull(), raw).when(kind.startswith("ARRAY"), listed).when(kind == "STRING", strip(quoted)).when(kind == "VOID", "None").when(kind == "BOOLEAN", spoken(quoted)).otherwise(raw)
    return or_default(label, formats.NO_HEADING)


def render_chunk(label: Column, text: Column) -> Column:
    return F.concat(F.lit(formats.SECTION_HEADER), label, F.lit("\n"), text)


def error_status(message: Column) -> Column:
    return F.concat(F.lit(formats.ERROR), F.substring(message, 1, formats.ERROR_CHARS))


def checkpoint_number(path: Column) -> Column:
    return F.regexp_extract(path, r"-(\d+)$", 1).try_cast("int")


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def clean_answer(answer: Column, end_marker: str = "<|im_end|>", next_turn: str = "<|im_start|>user") -> Column:
    """The answer up to the next user's turn, without end markers."""
    return strip(F.split(F.replace(answer, F.lit(end_marker), F.lit("")), _literal(next_turn), 2)[0])


def _literal(text: str) -> str:
    return reduce(lambda s, c: s.replace(c, "\\" + c), "|", text)


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def as_flag(value: Column) -> Column:
    return value.cast("boolean").cast("string")
