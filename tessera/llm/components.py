"""Connected components of links that may be more than one machine holds.

Each round points every node to its least neighbour, shortens the pointers,
and moves the links to where they point; what then joins a node with itself
is done. Pointers only ever lead to smaller nodes, so at least half of the
nodes that still have links lose them each round. Every round's links are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Times that pointers are shortened in a round.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of links (a, b); root is the least node that it reaches. Empty links give no row."""
    links = materialize(links.where("a <> b").select("a", "b").distinct())
    whole = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        to = materialize(to)
        for _ in range(JUMPS):
            on = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            to = to.join(on, "root").select("node", F.col("next").alias("root"))
        to = materialize(to)
        whole = to if whole is None else moved(whole, "root", to)
        links = materialize(moved(moved(links, "a", to), "b", to).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if whole is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole


def moved(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """rows with the column's node replaced by where it points, if it still points anywhere."""
    on = to.select(F.col("node").alias(column), F.col("root").alias("_to"))
    return rows.join(on, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
