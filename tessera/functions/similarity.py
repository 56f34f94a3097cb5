"""Near-duplicate wording of two questions.

difflib's ratio has no built-in counterpart (edit distance differs), depends on
the order of its arguments and drops frequent characters of long texts; it runs
as an Arrow-batched function on one pair a row, never on a product of rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import formats
from .text import normalize


def ratio(first: str, second: str) -> float:
    return SequenceMatcher(None, first, second).ratio()


def similarity(training: Column, evaluation: Column) -> Column:
    """Ratio of the normalised questions, the training question first."""
    found = F.udf(lambda a, b: None if a is None or b is None else ratio(a, b), "double", useArrow=True)
    return found(normalize(training), normalize(evaluation))


def too_similar(training: Column, evaluation: Column, limit: float = formats.SIMILARITY) -> Column:
    return (normalize(training) == normalize(evaluation)) | (similarity(training, evaluation) >= limit)
