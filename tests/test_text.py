from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.functions.similarity import ratio, too_similar
from tessera.functions.text import checkpoint_number, clean_answer, error_status, estimate_tokens, heading_label, normalize, or_default, round_half_even, strip, stripped_texts

SPACED = ["  a b\t", "\x1cx y\x1f", "Straße  ÀÉ", "ὈΔΥΣΣΕΎΣ", "", "   ", "a\x0bb\x85c", None]


def values(spark, rows, column):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    return [r.x for r in frame.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_white_space_is_unicode(spark):
    assert values(spark, SPACED, strip) == [None if t is None else t.strip() for t in SPACED]
    assert values(spark, SPACED, normalize) == [None if t is None else " ".join(t.split()).lower() for t in SPACED]


def test_every_white_space_character(spark):
    points = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    assert [c for c, x in zip(points, values(spark, points, strip)) if x == ""] == [c for c in points if c.isspace()]
    assert [c for c, x in zip(points, values(spark, [f"a{c}b" for c in points], normalize)) if x == "a b"] == [c for c in points if c.isspace()]


def test_estimates(spark):
    assert values(spark, ["", "abcd", "abcde", "é" * 9], estimate_tokens) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        estimate_tokens(F.lit("x"), 0)


def test_heading_labels(spark):
    paths = [None, "  ", "Plain text", '["A", " B ", ""]', "[]", '["A", 1, null, true]', '"X"', "null", "12", "[broken", '[" "]']
    assert values(spark, paths, heading_label) == ["Page content", "Page content", "Plain text", "A > B", "Page content", "A > 1 > None > True", "X", "None", "12", "[broken", "Page content"]


def test_small_functions(spark):
    assert values(spark, ["run/checkpoint-120", "adapter", "checkpoint-x"], checkpoint_number) == [120, None, None]
    assert values(spark, ["a<|im_end|> \n<|im_start|>user\nmore", " b "], clean_answer) == ["a", "b"]
    assert values(spark, ["", None, "x"], lambda c: or_default(c, "d")) == ["d", "d", "x"]
    assert values(spark, ["", None, "x"], lambda c: or_default(c, "d", empty_too=False)) == ["", "d", "x"]
    assert values(spark, ["0.5", "1.5", "2.5"], lambda c: round_half_even(c.cast("double"))) == [0, 2, 2]
    assert len(values(spark, ["e" * 900], error_status)[0]) == 506
    assert values(spark, ["a| |b "], lambda c: F.array_join(stripped_texts(F.split(c, r"\|")), ",")) == ["a,b"]


def test_similarity(spark):
    pairs = [("What is X?", "what  is x?"), ("How do I list tables", "How do I list tables now"), ("alpha", "omega"), ("a" * 300, "b" + "a" * 299), ("private thread currency", "private volatile currency")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(too_similar(F.col("a"), F.col("b")).alias("near"))
    expected = [a.lower().split() == b.lower().split() or ratio(a.lower(), b.lower()) >= 0.85 for a, b in pairs]
    assert [r.near for r in frame.collect()] == expected


def test_prompts(spark):
    row = spark.range(1).select(prompts.evaluation_messages(F.lit("T"), F.lit("q"), F.lit("a"), F.array(F.lit("e1"), F.lit("e2"))).alias("m"), prompts.page_question_messages(F.lit("ctx")).alias("p"), prompts.judge_messages(F.lit("q"), F.lit("r"), F.lit("a")).alias("j")).first()
    assert [m.role for m in row.m] == ["system", "user"] and "- e1\n\n- e2" in row.m[1].content
    assert row.p[1].content == "PAGE CONTEXT:\nctx" and row.j[1].content.endswith("CANDIDATE:\na")
