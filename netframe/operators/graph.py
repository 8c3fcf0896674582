"""Property graphs: a vertex table (id, ...) and an edge table (src, dst, weight, pos).

A null weight counts as 1.  pos orders duplicate edges: where one of them has to win, the last
does; sums take all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.plans.indexing import with_dense_index


def weight() -> Column:
    return F.coalesce(F.col("weight"), F.lit(1.0))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, next to each other in pos (a self-loop twice as well)."""
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), (2 * F.col("pos")).alias("pos")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (2 * F.col("pos") + 1).alias("pos")),
    )
    return edges.select("weight", F.explode(both).alias("e")).select("e.src", "e.dst", "weight", "e.pos")


def label_codes(df: DataFrame, label: str, pos: str) -> DataFrame:
    """(label, code int): codes in the order in which the labels are first seen."""
    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(pos).alias("nf_first"))
    return with_dense_index(first, ["nf_first", label], "code").select(label, F.col("code").cast("int").alias("code"))


@dataclass
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, weight_col: str | None = "weight") -> PropertyGraph:
        """edges: src, dst (long), and if there are any weight and pos; vertices: id and more.

        Without vertices those of the edges are taken.
        """
        w = F.col(weight_col).cast("double") if weight_col and weight_col in edges.columns else F.lit(None).cast("double")
        pos = F.col("pos").cast("long") if "pos" in edges.columns else F.monotonically_increasing_id()
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"), pos.alias("pos"))
        e = e if directed else symmetrize(e)
        v = vertices if vertices is not None else e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(v, e)

    @classmethod
    def from_named_edges(cls, edges: DataFrame, names: DataFrame | None = None, directed: bool = True) -> PropertyGraph:
        """edges: src, dst of any type, pos[, weight]; ids are numbers in first-seen order, orig the names.

        names (orig, pos) lists further vertices, and comes first.
        """
        own = edges.select(F.explode(F.array(F.struct(F.col("src").cast("string").alias("orig"), (2 * F.col("pos")).alias("p")), F.struct(F.col("dst").cast("string").alias("orig"), (2 * F.col("pos") + 1).alias("p")))).alias("x")).select("x.orig", F.lit(1).alias("late"), "x.p")
        if names is not None:
            own = names.select(F.col("orig").cast("string").alias("orig"), F.lit(0).alias("late"), F.col("pos").alias("p")).unionByName(own)
        first = own.groupBy("orig").agg(F.min(F.struct("late", "p")).alias("f")).select("orig", F.col("f.late").alias("late"), F.col("f.p").alias("p"))
        v = with_dense_index(first, ["late", "p", "orig"], "id").select("id", "orig")
        a, b = v.select(F.col("id").alias("nf_s"), F.col("orig").alias("nf_so")), v.select(F.col("id").alias("nf_d"), F.col("orig").alias("nf_do"))
        joined = edges.join(a, F.col("src").cast("string") == F.col("nf_so")).join(b, F.col("dst").cast("string") == F.col("nf_do"))
        keep = ["pos"] + (["weight"] if "weight" in edges.columns else [])
        return cls.from_edges(joined.select(F.col("nf_s").alias("src"), F.col("nf_d").alias("dst"), *keep), v, directed)

    # ids

    def original_id(self, index: int):
        row = self.vertices.where(F.col("id") == index).select("orig").first()
        return index if row is None else row["orig"]

    def index_of(self, orig) -> int | None:
        row = self.vertices.where(F.col("orig") == str(orig)).select("id").first()
        return None if row is None else row["id"]

    def map_results(self, results: DataFrame) -> DataFrame:
        """results (id, ...) under the original ids."""
        return results.join(self.vertices.select("id", "orig"), "id").drop("id")

    # facts

    def n_nodes(self) -> int:
        return self.vertices.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def undirected(self, first: int | None = 10) -> DataFrame:
        """One row, is_undirected: an even number of edges, and each of the first ones by pos has its reverse.

        first=None looks at every edge.
        """
        e = self.edges.select("src", "dst", "pos")
        n = e.agg(F.count(F.lit(1)).alias("n"))
        looked = e if first is None else e.orderBy("pos").limit(first)
        lonely = looked.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("lonely"))
        return n.crossJoin(lonely).select(F.when(F.col("n") == 0, True).when(F.col("n") % 2 == 1, False).otherwise(F.col("lonely") == 0).alias("is_undirected"))

    def is_undirected(self, first: int | None = 10) -> bool:
        return self.undirected(first).first()[0]

    def profile(self) -> DataFrame:
        """One row of counts: nodes, edges, self-loops, ids, dangling nodes, out-degrees."""
        out = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
        per = self.vertices.select("id").join(out, F.col("id") == F.col("src"), "left")
        return per.agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.coalesce(F.sum("k"), F.lit(0)).alias("n_edges"),
            F.coalesce(F.sum("loops"), F.lit(0)).alias("n_self_loops"),
            F.min("id").alias("min_id"),
            F.max("id").alias("max_id"),
            (F.max("id") - F.min("id") + 1 == F.count(F.lit(1))).alias("contiguous"),
            F.sum(F.col("k").isNull().cast("long")).alias("n_dangling"),
            F.max("k").alias("max_out_degree"),
            F.avg(F.coalesce("k", F.lit(0))).alias("avg_out_degree"),
        )

    def describe(self) -> str:
        both = self.is_undirected()
        return f"PropertyGraph(nodes={self.n_nodes()}, edges={self.n_edges() // (2 if both else 1)}, {'undirected' if both else 'directed'})"

    # views

    def adjacency(self) -> DataFrame:
        """(i, j, v): the last of duplicate edges wins."""
        return self.edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max_by(weight(), "pos").alias("v"))

    def unweighted_adjacency(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v")).distinct()

    def masked(self, node_mask: Column | None = None, edge_mask: Column | None = None) -> PropertyGraph:
        """Edges and vertices whose mask holds; edges need both ends."""
        v = self.vertices if node_mask is None else self.vertices.where(node_mask)
        e = self.edges if edge_mask is None else self.edges.where(edge_mask)
        return PropertyGraph(v, e) if node_mask is None else PropertyGraph(v, induced(e, v))

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """Subgraph of the vertices in ids (id)."""
        return PropertyGraph(self.vertices.join(ids.select("id"), "id", "left_semi"), induced(self.edges, ids))

    def ego(self, centre: DataFrame) -> PropertyGraph:
        """Subgraph of the vertices in centre (id) and their out-neighbours."""
        near = self.edges.join(centre.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        return self.induced(near.unionByName(centre.select("id")).distinct())


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    one = ids.select("id")
    return edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def batch_graphs(graphs: list[PropertyGraph]) -> PropertyGraph:
    """One graph of many, told apart by graph_id; what padding and masks do elsewhere is which rows there are."""
    if not graphs:
        raise ValueError("no graphs to batch")
    v = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (g.vertices.withColumn("graph_id", F.lit(k)) for k, g in enumerate(graphs)))
    e = reduce(DataFrame.unionByName, (g.edges.withColumn("graph_id", F.lit(k)) for k, g in enumerate(graphs)))
    return PropertyGraph(v, e)


def padded(graph: PropertyGraph, key: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a batch filled up to the largest graph: padding edges are 0 -> 0 with weight 0."""
    sizes_v = graph.vertices.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes_e = graph.edges.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = lambda s: s.agg(F.max("n").alias("top"))
    more = lambda s: s.crossJoin(F.broadcast(top(s))).where("n < top").select(key, F.explode(F.sequence(F.col("n"), F.col("top") - 1)).alias("at"))
    v = graph.vertices.select(key, "id", F.lit(True).alias("mask")).unionByName(more(sizes_v).select(key, F.col("at").alias("id"), F.lit(False).alias("mask")))
    e = graph.edges.select(key, "src", "dst", weight().alias("weight"), F.lit(True).alias("mask")).unionByName(more(sizes_e).select(key, F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("weight"), F.lit(False).alias("mask")))
    return v, e


def last_by_pos(edges: DataFrame) -> DataFrame:
    """Duplicate edges reduced to the last one."""
    w = Window.partitionBy("src", "dst").orderBy(F.col("pos").desc())
    return edges.withColumn("nf_k", F.row_number().over(w)).where("nf_k = 1").drop("nf_k")
