"""Message passing: sums over edges of neighbours' features, and layer and degree helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph, weight
from .matrix import node_degrees


def long_features(x: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., f, x) of (keys..., features array)."""
    return x.select(*keys, F.posexplode("features").alias("f", "x"))


def propagate(g: PropertyGraph, x: DataFrame, direction: str = "in", mask: Column | None = None, key: str | None = None) -> DataFrame:
    """(id, f, y): sums of weight * feature over edges, for every vertex and feature.

    direction "in" gathers at the source and sums at the target (A transposed times X), "out" the
    other way (A X).  x is (id, features array); ValueError for anything else.  mask is a condition
    on vertices: where it fails the result is 0.  key is a further column of all tables (graph_id).
    Products are summed map-side before the one shuffle by target.
    """
    if direction not in ("in", "out"):
        raise ValueError(direction)
    if "features" not in x.columns or not x.schema["features"].dataType.simpleString().startswith("array"):
        raise ValueError("x needs a column features of arrays")
    source, target = ("src", "dst") if direction == "in" else ("dst", "src")
    keys = [key] if key else []
    long = long_features(x, [*keys, "id"])
    edges = g.edges.select(*keys, F.col(source).alias("id"), F.col(target).alias("to"), weight().alias("w"))
    sums = edges.join(long, [*keys, "id"]).groupBy(*keys, F.col("to").alias("id"), "f").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    width = long.select(*keys, "f").distinct()
    cells = g.vertices.join(width, key) if key else g.vertices.crossJoin(F.broadcast(width))  # one row for each feature
    keep = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    out = cells.select(*keys, "id", "f", keep.alias("nf_keep")).join(sums, [*keys, "id", "f"], "left")
    return out.select(*keys, "id", "f", F.when(F.col("nf_keep"), F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"))


def gather(y: DataFrame, *keys: str) -> DataFrame:
    """(keys..., features array) of (keys..., f, y)."""
    keys = keys or ("id",)
    return y.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "y"))), lambda c: c["y"]).alias("features"))


def multiply_dense(a: DataFrame, x: DataFrame) -> DataFrame:
    """(id, f, y): A X for a long matrix a and x (id, features)."""
    long = long_features(x, ["id"]).withColumnRenamed("id", "j")
    return a.join(long, "j").groupBy(F.col("i").alias("id"), "f").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def edge_capacities(g: PropertyGraph, capacity: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(src, dst, capacity): the sum of both ends' degrees, or capacity(edges with src_degree, dst_degree)."""
    d = node_degrees(g)
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("src_degree")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree")), "dst")
    c = capacity(e) if capacity else (F.col("src_degree") + F.col("dst_degree")).cast("double")
    return e.select("src", "dst", c.alias("capacity"))


def layer_masks(vertices: DataFrame, n: int, ref_ratio: float = 0.33, term_ratio: float = 0.33) -> DataFrame:
    """vertices with ref, term, gas: contiguous shares by id."""
    n_ref, n_term = int(n * ref_ratio), int(n * term_ratio)
    i = F.col("id")
    return vertices.select("*", (i < n_ref).alias("ref"), ((i >= n_ref) & (i < n_ref + n_term)).alias("term"), (i >= n_ref + n_term).alias("gas"))


def layer_statistics(g: PropertyGraph, masks: DataFrame) -> DataFrame:
    """(layer, n, avg_degree) for the mask columns ref, term, gas of masks; layers may overlap."""
    d = node_degrees(g).join(masks, "id")
    layers = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.col(k).alias("inside")) for k in ("ref", "term", "gas"))))
    return (
        d.select("degree", layers.alias("m"))
        .groupBy(F.col("m.layer").alias("layer"))
        .agg(F.sum(F.col("m.inside").cast("long")).alias("n"), F.sum(F.when(F.col("m.inside"), F.col("degree")).otherwise(0)).alias("total"))
        .select("layer", "n", (F.col("total") / (F.col("n") + 1e-8)).alias("avg_degree"))
    )


def degree_layers(g: PropertyGraph) -> DataFrame:
    """(id, degree, layer): ref up to the 25th percentile of the degrees, gas from the 75th, else term."""
    d = node_degrees(g)
    cuts = d.agg(F.percentile("degree", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    j = d.crossJoin(F.broadcast(cuts))  # one row
    return j.select("id", "degree", F.when(F.col("degree") <= F.col("q")[0], "ref").when(F.col("degree") >= F.col("q")[1], "gas").otherwise("term").alias("layer"))
