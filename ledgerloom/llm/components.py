"""Connected components by alternating large and small stars over DataFrames.

Each round hangs every node's larger neighbours, then its smaller ones, onto the least node it sees.
Edges never outnumber what came in, each round is written to the shared folder, and the only thing
that reaches the driver is a count and a checksum that tell when nothing changes any more. The node of a
large component has many edges and is one key of a join; Spark divides such a key (its skew join), as no
join here feeds an aggregate of the same key without an exchange of partial results.

Up to TOGETHER edges, a bounded amount, are one partition: the joins and aggregates of their rounds then need no
exchange. Otherwise each round would be several exchanges of as many tasks as the session has shuffle partitions,
however few the edges are, and the driver keeps books on every task. More edges are dealt out as ever. Joins are
merged, not broadcast, so that edges do not pass through the driver.

Defined results: null ends and edges to itself link nothing; repeated edges count once; no edges give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import Shelf

#: Edges that one task takes (1 MB of two longs each).
TOGETHER = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node that can be reached."""
    shelf = Shelf(edges.sparkSession)
    now = shelf.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round-0")
    state = _state(now)

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if state[0] <= TOGETHER else df

    for turn in range(1, most + 1):
        if not state[0]:
            break
        both = dealt(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = dealt(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below).where("a <> b")
        now = shelf.cut(dealt(small).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"round-{turn}")
        shelf.drop(f"round-{turn - 1}")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    now = dealt(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
