"""Graphs and points from hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph


def uniform(seed: int, *cols) -> Column:
    """In [0, 1), from a hash of the columns and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *cols) -> Column:
    """Standard normal numbers (Box-Muller)."""
    u = F.greatest(uniform(seed, *cols), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *cols))


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    a = spark.range(n).withColumnRenamed("id", "src")
    return a.withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.lit(n)))).where(F.col("dst") < n)


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 42, low: float = 0.1, high: float = 2.0) -> PropertyGraph:
    """Each pair is an edge with chance p, weights uniform in [low, high]."""
    e = _pairs(spark, n).where(uniform(seed, "src", "dst") < p).withColumn("weight", low + (high - low) * uniform(seed + 2, "src", "dst"))
    return PropertyGraph.from_edges(e.withColumn("pos", F.col("src") * n + F.col("dst")), spark.range(n), directed=False)


def grid_graph(spark: SparkSession, rows: int, cols: int) -> PropertyGraph:
    v = spark.range(rows * cols)
    right = v.where((F.col("id") + 1) % cols != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    e = right.unionByName(down)
    return PropertyGraph.from_edges(e.withColumn("pos", F.col("src") * rows * cols + F.col("dst")), v, directed=False)


def planted_partition(spark: SparkSession, n: int = 200, k: int = 5, inside: float = 0.3, across: float = 0.02, seed: int = 42) -> tuple[PropertyGraph, DataFrame]:
    """(graph, (id, cluster)): dense and heavy inside communities, sparse and light across."""
    v = spark.range(n)
    labels = v.select("id", F.floor(uniform(seed + 7, "id") * k).cast("int").alias("cluster"))
    e = _pairs(spark, n).join(labels.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    same, u = F.col("a") == F.col("b"), uniform(seed + 1, "src", "dst")
    e = e.where(uniform(seed, "src", "dst") < F.when(same, inside).otherwise(across)).withColumn("weight", F.when(same, 0.8 + 0.2 * u).otherwise(0.1 + 0.2 * u))
    return PropertyGraph.from_edges(e.withColumn("pos", F.col("src") * n + F.col("dst")), v, directed=False), labels


def blobs(spark: SparkSession, n: int = 300, k: int = 4, d: int = 6, spread: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((id, features), (id, cluster)): normal clouds around centres of scale 2."""
    c = (F.col("id") % k).cast("int")
    x = F.array(*(2 * normal(seed, c, F.lit(f)) + spread * normal(seed + 5, "id", F.lit(f)) for f in range(d)))
    return spark.range(n).select("id", x.alias("features")), spark.range(n).select("id", c.alias("cluster"))


def similarity_graph(points: DataFrame, chance: float = 0.3, seed: int = 42) -> PropertyGraph:
    """Pairs become edges with chance * exp(-distance / 2), weighted by that similarity; a chain joins what is left apart."""
    from netframe.plans.indexing import with_dense_index

    from .spectral import euclidean_distances

    s = F.exp(-F.col("v") / 2)
    d = euclidean_distances(points).where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), s.alias("weight"))
    drawn = d.where(uniform(seed, "src", "dst") < chance * F.col("weight"))
    order = with_dense_index(points.select("id"), ["id"], "rank")
    chain = order.select(F.col("id").alias("src"), (F.col("rank") + 1).alias("rank")).join(order.select(F.col("id").alias("dst"), "rank"), "rank").select("src", "dst")
    kept = drawn.unionByName(d.join(chain, ["src", "dst"], "left_semi")).distinct()
    return PropertyGraph.from_edges(kept.withColumn("pos", F.shiftright(F.xxhash64("src", "dst"), 2)), points.select("id"), directed=False)


def supply_chain(spark: SparkSession, layers: tuple[int, int, int] = (5, 29, 3422), seed: int = 42) -> tuple[PropertyGraph, DataFrame]:
    """(graph, (id, ref, term, gas)): three layers with random links down and, from the first, straight to the last."""
    n1, n2, n3 = layers
    v = spark.range(n1 + n2 + n3)
    i = F.col("id")
    masks = v.select("id", (i < n1).alias("ref"), ((i >= n1) & (i < n1 + n2)).alias("term"), (i >= n1 + n2).alias("gas"))
    second = v.where((i >= n1) & (i < n1 + n2)).select("id", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(n1, 5))))).alias("k")).select(F.floor(uniform(seed, "id", "k") * n1).alias("src"), F.col("id").alias("dst"), (70 + 70 * uniform(seed + 3, "id", "k")).alias("weight"))
    third = v.where(i >= n1 + n2).select("id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k")).select((n1 + F.floor(uniform(seed + 1, "id", "k") * n2)).alias("src"), F.col("id").alias("dst"), (105 + 140 * uniform(seed + 4, "id", "k")).alias("weight"))
    direct = v.where(i >= n1 + n2).select(F.floor(uniform(seed + 2, "id") * n1).alias("src"), F.col("id").alias("dst"), (21 + 60 * uniform(seed + 6, "id")).alias("weight"))
    e = second.unionByName(third).unionByName(direct).dropDuplicates(["src", "dst"])
    return PropertyGraph.from_edges(e.withColumn("pos", F.xxhash64("src", "dst"))), masks
