"""Graph files: node-link JSON, CSV edge lists, text edge lists with # comments, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.operators.graph import PropertyGraph, weight
from netframe.plans.storage import materialize

NODE_LINK = "nodes array<struct<id:string, features:array<double>>>, links array<struct<source:string, target:string, weight:double>>"


def read_node_link(spark: SparkSession, path: str) -> PropertyGraph:
    """{"nodes": [{id, features?}], "links": [{source, target, weight?}]}: a node's id is its place; sources and targets are places.

    Features and weights are there if the first node and link have them; a missing weight is then 1.
    """
    df = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    v = df.select(F.posexplode("nodes").alias("pos", "n"), F.col("nodes")[0]["features"].isNotNull().alias("with_features"))
    v = v.select(F.col("pos").cast("long").alias("id"), F.col("n.id").alias("orig"), F.when(F.col("with_features"), F.col("n.features")).alias("features"))
    e = df.select(F.posexplode("links").alias("pos", "l"), F.col("links")[0]["weight"].isNotNull().alias("weighted"))
    e = e.select(F.col("l.source").cast("double").cast("long").alias("src"), F.col("l.target").cast("double").cast("long").alias("dst"), F.when(F.col("weighted"), F.coalesce("l.weight", F.lit(1.0))).alias("weight"), F.col("pos").cast("long").alias("pos"))
    return PropertyGraph(v, e)


#: Vertices and edges that one JSON document may hold.
NODE_LINK_ROWS = 1_000_000


def write_node_link(g: PropertyGraph, path: str, most: int = NODE_LINK_ROWS) -> None:
    """One JSON document, in a folder: the format is one object, so one task writes it.

    A graph of more than `most` vertices and edges is refused; for those use write_parquet.
    """
    n = g.vertices.count() + g.edges.count()
    if n > most:
        raise ValueError(f"{n} vertices and edges are too many for one JSON document")
    features = F.col("features") if "features" in g.vertices.columns else F.lit(None).cast("array<double>")
    nodes = g.vertices.select(F.struct(F.col("id"), features.alias("features")).alias("n")).agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    links = g.edges.select(F.struct(F.col("pos"), F.col("src").alias("source"), F.col("dst").alias("target"), weight().alias("weight")).alias("l")).agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["weight"].alias("weight"))).alias("links"))
    nodes.crossJoin(links).select(F.to_json(F.struct("nodes", "links")).alias("value")).coalesce(1).write.mode("overwrite").text(path)  # one row each


def read_csv(spark: SparkSession, path: str, weighted: bool = True) -> PropertyGraph:
    """Header, then source, target[, weight]; ids may be written as floats.  Vertices are 0 to the largest id.

    Malformed cells raise; blank lines are ignored; no rows give an empty graph.
    """
    schema = "source string, target string" + (", weight string" if weighted else "")
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).where("source is not null or target is not null")
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    e = raw.select(F.col("source").cast("double").cast("long").alias("src"), F.col("target").cast("double").cast("long").alias("dst"), w.alias("weight"), F.monotonically_increasing_id().alias("pos"))
    e = materialize(e, "csv")
    top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return PropertyGraph(spark.range(0 if top is None else top + 1), e)


def write_csv(g: PropertyGraph, path: str) -> None:
    """source, target and, if any edge has one, weight; part files with a header each."""
    weighted = not g.edges.where("weight is not null").limit(1).isEmpty()
    cols = [F.col("src").alias("source"), F.col("dst").alias("target")] + ([weight().alias("weight")] if weighted else [])
    g.edges.orderBy("pos").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_edge_text(spark: SparkSession, path: str, directed: bool = True, every: int = 1, max_id: int | None = None, drop_loops: bool = False) -> PropertyGraph:
    """White-space separated pairs of ids, # comments; duplicates are dropped.

    every keeps each k-th line of a file, max_id drops larger ids.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if every > 1:
        from netframe.plans.indexing import with_dense_index

        placed = lines.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("p"))
        lines = with_dense_index(placed, ["f", "p"], "k").where(F.col("k") % every == 0)
    parts = F.split(F.trim("value"), r"\s+")
    e = lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
    if max_id is not None:
        e = e.where((F.col("src") < max_id) & (F.col("dst") < max_id))
    if drop_loops:
        e = e.where("src <> dst")
    return PropertyGraph.from_edges(e.dropDuplicates(["src", "dst"]).withColumn("pos", F.xxhash64("src", "dst")), directed=directed)


def write_edge_text(g: PropertyGraph, path: str) -> None:
    g.edges.select(F.concat_ws("\t", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def write_parquet(g: PropertyGraph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def node_objects(g: PropertyGraph) -> DataFrame:
    """(id, features, neighbours array<struct<id, weight>>): each vertex as an object, as graph libraries hold them.

    Weights are 1 where there are none, of duplicate edges the last counts; features are null, or one number where
    they have one (then features is array of one).  A hub's neighbours are in one row by the nature of the form.
    """
    features = F.col("features") if "features" in g.vertices.columns else F.lit(None).cast("array<double>")
    edges = g.adjacency().groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("id"), F.col("v").alias("weight")))).alias("neighbours"))
    none = F.array().cast("array<struct<id:bigint,weight:double>>")
    return g.vertices.select("id", features.alias("features")).join(edges, "id", "left").select("id", "features", F.coalesce("neighbours", none).alias("neighbours"))
