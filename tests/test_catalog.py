"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    rows = catalog.QUERIES[name](spark, DIR)
    columns = sorted(rows.columns)
    found = sorted(repr(tuple(r)) for r in rows.select(columns).collect())
    if name in catalog.ORACLES:
        result = db.execute(catalog.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert found == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_compares_whole_questions(spark, root):
    """Texts of more than 200 characters, in which difflib leaves out frequent characters, are compared to their ends."""
    from difflib import SequenceMatcher

    texts = ["short?", "a question of several words " * 12, "".join(chr(97 + k % 26) for k in range(900)) + " tail\nsecond line"]
    rows = [(1, 2 * k, "user", t) for k, t in enumerate(texts)] + [(1, 1, "assistant", "reply")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    found = {r.turn: r.ratio for r in catalog.similar(spark, root).collect()}
    normal = [" ".join(t.lower().split()) for t in texts]
    assert found == {2 * k: round(SequenceMatcher(None, t, f"{t} other words").ratio(), 6) for k, t in enumerate(normal)}
