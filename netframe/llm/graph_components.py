"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is two group-by-and-join steps on (node, node) rows; nothing is collected.  A
round's table is written to the shared folder, so a lost executor never restarts the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy


def _star(pairs: DataFrame, lower_only: bool) -> DataFrame:
    """One star step over (a, b) rows with a > b.

    Large star links every larger neighbour of a node to the node's least neighbour or
    itself; small star links the smaller neighbours and the node to the least one.
    """
    if lower_only:
        around = pairs
    else:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    joined = around.join(least, "a")
    if lower_only:
        out = joined.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        out = out.select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node of its component."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    mark = None
    for _ in range(max_rounds):
        tidy(edges.sparkSession)
        sign = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1000003).alias("s")).first()
        if sign["n"] == 0 or tuple(sign) == mark:
            break
        mark = tuple(sign)
        before, pairs = pairs, materialize(_star(_star(pairs, False), True), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
