"""Shortest paths on long distance tables (i, j, v); an absent pair is out of reach."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.plans.storage import discard, materialize

from .graph import PropertyGraph
from .matrix import min_plus


def edge_costs(g: PropertyGraph) -> DataFrame:
    """(i, j, v) without self-loops: the last of duplicate edges wins."""
    return g.adjacency().where("i <> j")


def _start(g: PropertyGraph) -> DataFrame:
    zero = g.vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v"))
    return edge_costs(g).unionByName(zero)


def _same(m: DataFrame) -> tuple:
    r = m.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).first()
    return r["n"], r["s"]


def all_pairs(g: PropertyGraph, max_rounds: int | None = None, max_distance: float | None = None) -> DataFrame:
    """(i, j, v) of every reachable pair, by squaring over (min, +): ceil(log2 n) rounds, fewer if nothing changes.

    The result has up to n * n rows by its nature; for one source use single_source.  Costs may be
    negative as long as no cycle is.  max_distance caps what is longer.
    """
    n = g.vertices.count()
    rounds = max_rounds if max_rounds is not None else ceil(log2(n)) if n > 1 else 0
    d = materialize(_start(g), "paths")
    seen = None
    for _ in range(rounds):
        d = materialize(min_plus(d, d), "paths")
        now = _same(d)
        if now == seen:
            break
        seen = now
    return d if max_distance is None else capped(d, g, max_distance)


def capped(d: DataFrame, g: PropertyGraph, max_distance: float) -> DataFrame:
    """Every pair, with distances cut at max_distance; pairs out of reach are at max_distance."""
    ids = g.vertices.select("id")
    cells = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j")))
    return cells.join(d, ["i", "j"], "left").select("i", "j", F.least(F.coalesce("v", F.lit(max_distance)), F.lit(max_distance)).alias("v"))


def hop_bounded(g: PropertyGraph, iterations: int | None = None) -> DataFrame:
    """Distances over paths of at most iterations + 1 edges; by default n - 1 iterations or until nothing changes."""
    n = g.vertices.count()
    e = materialize(_start(g), "paths")
    d, seen = e, None
    for _ in range(n - 1 if iterations is None else iterations):
        d = materialize(min_plus(d, e), "paths")
        if iterations is None:
            now = _same(d)
            if now == seen:
                break
            seen = now
    return d


def floyd_warshall(g: PropertyGraph, max_distance: float | None = None) -> DataFrame:
    """All-pairs distances with the classic result: a self-loop is worth its cost on the diagonal."""
    d = all_pairs(g)
    loops = g.adjacency().where("i = j").select("i", F.col("v").alias("loop"))
    j = d.join(loops, "i", "left")
    around = min_plus(edge_costs(g), d).where("i = j").select("i", F.col("v").alias("cycle"))
    out = j.join(around, "i", "left").select("i", "j", F.when((F.col("i") == F.col("j")) & F.col("loop").isNotNull(), F.least("loop", F.coalesce("cycle", "loop"))).otherwise(F.col("v")).alias("v"))
    return out if max_distance is None else capped(out, g, max_distance)


#: Rounds of improvements that are kept apart.
MERGE_EVERY = 8


def single_source(g: PropertyGraph, source: int, max_distance: float | None = None, rounds: int | None = None) -> DataFrame:
    """(id, v): distances from source, relaxing only edges out of vertices that got closer.

    rounds bounds the edges of a path; by default it goes on until nothing improves.  Costs that
    add up to a negative cycle raise ValueError after n rounds.

    A round writes what it has improved and looks only the vertices with offers up among what was written before;
    the tables are merged into one every MERGE_EVERY rounds.
    """
    e = materialize(edge_costs(g).select(F.col("i").alias("id"), F.col("j").alias("to"), "v"), "paths")
    spark = g.edges.sparkSession
    fresh = spark.createDataFrame([(source, 0.0)], "id long, v double")
    found = [fresh]
    n = g.vertices.count()
    made = 0

    def best(tables: list[DataFrame], ids: DataFrame | None = None) -> DataFrame:
        rows = reduce(DataFrame.unionByName, tables)
        return (rows if ids is None else rows.join(ids, "id", "left_semi")).groupBy("id").agg(F.min("v").alias("v"))

    while rounds is None or made < rounds:
        offers = fresh.select("id", F.col("v").alias("have")).join(e, "id").groupBy(F.col("to").alias("id")).agg(F.min(F.col("have") + F.col("v")).alias("offer"))
        offers = materialize(offers, "offers")
        better = offers.join(best(found, offers.select("id")), "id", "left").where(F.col("v").isNull() | (F.col("offer") < F.col("v")))
        fresh = materialize(better.select("id", F.col("offer").alias("v")), "paths")
        discard(offers)
        made += 1
        if fresh.isEmpty():
            break
        if made > n:
            raise ValueError("there is a cycle of negative cost")
        found.append(fresh)
        if len(found) > MERGE_EVERY:
            whole = materialize(best(found), "paths")
            discard(*(t for t in found if t is not fresh))
            found = [whole, fresh]
    out = best(found)
    if max_distance is not None:
        out = g.vertices.select("id").join(out, "id", "left").select("id", F.least(F.coalesce("v", F.lit(max_distance)), F.lit(max_distance)).alias("v"))
    return out


def path_exists(g: PropertyGraph, source: int, target: int, max_distance: float | None = None) -> bool:
    """Whether target is in reach of source (within max_distance, if given), by frontiers of unseen vertices."""
    if max_distance is not None:
        return not single_source(g, source).where((F.col("id") == target) & (F.col("v") <= max_distance)).isEmpty()
    if source == target:
        return True
    e = materialize(g.edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct(), "paths")
    seen = edge = g.edges.sparkSession.createDataFrame([(source,)], "id long")
    while True:
        edge = materialize(edge.join(e, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"), "paths")
        if edge.isEmpty():
            return False
        if not edge.where(F.col("id") == target).isEmpty():
            return True
        seen = materialize(seen.unionByName(edge), "paths")


def reachable(d: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (i, j) with exists, from a distance table."""
    return pairs.join(d.select("i", "j", F.lit(True).alias("yes")), ["i", "j"], "left").select("i", "j", F.coalesce("yes", F.lit(False)).alias("exists"))


def diameter(d: DataFrame) -> DataFrame:
    """One row: the largest finite distance above 0, minus infinity if there is none."""
    return d.where("v > 0").agg(F.coalesce(F.max("v"), F.lit(float("-inf"))).alias("diameter"))


def average_length(d: DataFrame) -> DataFrame:
    """One row: the mean of finite distances above 0 (count + 1e-8)."""
    return d.where("v > 0").agg((F.coalesce(F.sum("v"), F.lit(0.0)) / (F.count(F.lit(1)) + 1e-8)).alias("average"))


def unit_costs(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(g.vertices, g.edges.withColumn("weight", F.lit(1.0)))
