"""Graphs and points made from the driver's tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netframe.operators.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def trade(spark: SparkSession, d: str) -> PropertyGraph:
    """Customers' nations to suppliers' nations, weighted by line items; every nation is a vertex."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    v = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("orig"), F.col("n_regionkey").alias("region"))
    return PropertyGraph.from_edges(e.withColumn("pos", F.col("src") * 1000 + F.col("dst")), v)


TRADE = """trade AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
v AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS orig, n_regionkey AS region FROM nation)"""


def trade3(spark: SparkSession, d: str) -> PropertyGraph:
    """The three heaviest edges out of each nation, without self-loops."""
    g = trade(spark, d)
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    e = g.edges.where("src <> dst").withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")
    return PropertyGraph(g.vertices, e)


TRADE3 = TRADE + """,
trade3 AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM trade WHERE src <> dst) WHERE k <= 3)"""


def purchase(spark: SparkSession, d: str) -> PropertyGraph:
    """Customers (2 c) to suppliers (2 s + 1), weighted by line items; suppliers dangle."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.groupBy((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    v = table(spark, d, "customer").select((2 * F.col("c_custkey")).alias("id")).unionByName(table(spark, d, "supplier").select((2 * F.col("s_suppkey") + 1).alias("id")))
    return PropertyGraph.from_edges(e.withColumn("pos", F.col("src") * 1000000 + F.col("dst")), v)


PURCHASE = """purchase AS (SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT 2 * c_custkey AS id FROM customer UNION ALL SELECT 2 * s_suppkey + 1 FROM supplier)"""


def supply(spark: SparkSession, d: str) -> tuple[PropertyGraph, DataFrame]:
    """Suppliers (3 s) to parts (3 p + 1) to customers (3 c + 2), and suppliers to customers; with their layers."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.select("l_orderkey", "l_suppkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s, p, c = 3 * F.col("l_suppkey"), 3 * F.col("l_partkey") + 1, 3 * F.col("o_custkey") + 2
    e = j.select(F.explode(F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ((s, p), (p, c), (s, c))))).alias("e")).select("e.src", "e.dst").distinct().withColumn("weight", F.lit(None).cast("double")).withColumn("pos", F.col("src") * 10000000 + F.col("dst"))
    ids = table(spark, d, "supplier").select((3 * F.col("s_suppkey")).alias("id")).unionByName(table(spark, d, "part").select((3 * F.col("p_partkey") + 1).alias("id"))).unionByName(table(spark, d, "customer").select((3 * F.col("c_custkey") + 2).alias("id")))
    masks = ids.select("id", (F.col("id") % 3 == 0).alias("ref"), (F.col("id") % 3 == 1).alias("term"), (F.col("id") % 3 == 2).alias("gas"))
    return PropertyGraph(ids, e), masks


SUPPLY = """j AS (SELECT 3 * l_suppkey AS s, 3 * l_partkey + 1 AS p, 3 * o_custkey + 2 AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT s AS src, p AS dst FROM j UNION SELECT p, c FROM j UNION SELECT s, c FROM j),
v AS (SELECT 3 * s_suppkey AS id FROM supplier UNION ALL SELECT 3 * p_partkey + 1 FROM part UNION ALL SELECT 3 * c_custkey + 2 FROM customer)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def true_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


EMB = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
#: Points as one row for each coordinate.
EMB_LONG = EMB + ",\nlong AS (SELECT id, unnest(x) AS x, unnest(range(0, len(x))) AS f FROM p)"


def first_centres(spark: SparkSession, d: str, k: int = 10) -> list[list[float]]:
    """The k points with the lowest ids."""
    return [list(x["features"]) for x in points(spark, d).orderBy("id").limit(k).collect()]


CENTRES = "c AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT id, x FROM p ORDER BY id LIMIT 10))"


def user_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
