"""Construction, files, matrices and message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.functions import scalar as S
from netframe.operators import centrality, matrix, message, tensor
from netframe.operators.graph import PropertyGraph, batch_graphs, padded, symmetrize
from netframe.plans.session import engine_info
from netframe.plans.storage import fresh_dir
from netframe.sources import files
from netframe.streaming import degrees

from .paths import BETWEEN, _eigen_sql
from .tables import EMB_LONG, PURCHASE, TRADE, TRADE3, points, purchase, r, table, trade, trade3


def _m(df: DataFrame) -> DataFrame:
    return df.select("i", "j", r("v").alias("v"))


def edges_from_tables(spark, d):
    return purchase(spark, d).edges.select("src", "dst", F.col("weight").alias("w"))


def symmetrized(spark, d):
    return symmetrize(trade3(spark, d).edges).groupBy("src", "dst").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))


def label_codes(spark, d):
    from netframe.operators.graph import label_codes as codes

    c = codes(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    return table(spark, d, "customer").join(c, "c_mktsegment").groupBy("c_mktsegment", "code").agg(F.count(F.lit(1)).alias("n"))


def id_mapping(spark, d):
    g = trade3(spark, d)
    named = g.edges.join(g.vertices.select(F.col("id").alias("src"), F.col("orig").alias("a")), "src").join(g.vertices.select(F.col("id").alias("dst"), F.col("orig").alias("b")), "dst")
    own = PropertyGraph.from_named_edges(named.select(F.col("a").alias("src"), F.col("b").alias("dst"), "pos", "weight"))
    return own.map_results(matrix.node_degrees(own)).select("orig", "degree")


def is_undirected(spark, d):
    g = trade3(spark, d)
    both = PropertyGraph(g.vertices, symmetrize(g.edges))
    return g.undirected().select(F.lit("directed").alias("graph"), "is_undirected").unionByName(both.undirected(None).select(F.lit("symmetrized").alias("graph"), "is_undirected"))


def json_roundtrip(spark, d):
    path = fresh_dir(spark, "json")
    files.write_node_link(trade(spark, d), path)
    return files.read_node_link(spark, path).edges.select("src", "dst", F.col("weight").alias("w"))


def csv_roundtrip(spark, d):
    path = fresh_dir(spark, "csv")
    files.write_csv(purchase(spark, d), path)
    return files.read_csv(spark, path).edges.select("src", "dst", F.col("weight").alias("w"))


def node_objects(spark, d):
    o = files.node_objects(trade3(spark, d))
    return o.select("id", F.size("neighbours").alias("n"), F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["id"], x["weight"].cast("long"))), ",").alias("neighbours"))


def edge_text(spark, d):
    path = fresh_dir(spark, "text")
    files.write_edge_text(purchase(spark, d), path)
    return files.read_edge_text(spark, path).edges.select("src", "dst")


def parquet_roundtrip(spark, d):
    path = fresh_dir(spark, "graph")
    files.write_parquet(purchase(spark, d), path)
    return matrix.node_degrees(files.read_parquet(spark, path)).select("id", "degree")


def batched(spark, d):
    e = table(spark, d, "events")
    kinds = [x["event_type"] for x in e.select("event_type").distinct().orderBy("event_type").collect()]
    graphs = []
    for kind in kinds:
        one = e.where(F.col("event_type") == kind).select(F.col("user_id").alias("src"), (F.col("user_id") % 10).alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("pos"))
        graphs.append(PropertyGraph.from_edges(one))
    g = batch_graphs(graphs)
    return g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), r(F.sum("weight"), 4).alias("total"))


def padded_batch(spark, d):
    g = trade(spark, d)
    regions = [PropertyGraph(g.vertices.where(F.col("region") == k).select("id"), g.edges.where(F.col("src") % 5 == k)) for k in range(5)]
    v, e = padded(batch_graphs([*regions, trade3(spark, d)]))
    return v.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("mask").cast("long")).alias("real_nodes")).join(e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("mask").cast("long")).alias("real_edges")), "graph_id")


def adjacency(spark, d):
    return _m(trade(spark, d).adjacency())


def adjacency_unweighted(spark, d):
    return _m(trade3(spark, d).unweighted_adjacency())


def degree_matrix(spark, d):
    return _m(matrix.degree_matrix(purchase(spark, d)))


def node_degrees(spark, d):
    return matrix.node_degrees(purchase(spark, d))


def laplacian(spark, d):
    return _m(matrix.laplacian(trade(spark, d)))


def laplacian_sym(spark, d):
    return _m(matrix.normalized_laplacian(trade3(spark, d), add_self_loops=False))


def laplacian_sym_loops(spark, d):
    return _m(matrix.normalized_laplacian(trade(spark, d), add_self_loops=True, use_weights=True))


def laplacian_rw(spark, d):
    return _m(matrix.random_walk_laplacian(purchase(spark, d)))


def laplacian_eigen(spark, d):
    g = trade(spark, d)
    sym = PropertyGraph(g.vertices, symmetrize(g.edges))
    values, _ = matrix.eigensystem(matrix.normalized_laplacian(sym, False, True), sym.vertices, 5)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(values)], "k int, value double")


def _nation_features(spark, d) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum(F.col("c_custkey") % 7).cast("double").alias("b"))
    return c.select("id", F.array("a", "b").alias("features"))


NATION_FEATURES = """x AS (SELECT CAST(c_nationkey AS BIGINT) AS id, CAST(count(*) AS DOUBLE) AS a, CAST(sum(c_custkey % 7) AS DOUBLE) AS b FROM customer GROUP BY ALL),
xl AS (SELECT id, 0 AS f, a AS x FROM x UNION ALL SELECT id, 1, b FROM x)"""


def spmm_in(spark, d):
    return message.propagate(trade3(spark, d), _nation_features(spark, d)).select("id", "f", r("y").alias("y"))


def spmm_out(spark, d):
    return message.propagate(trade3(spark, d), _nation_features(spark, d), "out").select("id", "f", r("y").alias("y"))


def spmm_masked(spark, d):
    return message.propagate(trade3(spark, d), _nation_features(spark, d), mask=F.col("region") < 2).select("id", "f", r("y").alias("y"))


def spmm_batch(spark, d):
    g = batch_graphs([trade(spark, d), trade3(spark, d)])
    x = _nation_features(spark, d).withColumn("graph_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return message.propagate(g, x, key="graph_id").select("graph_id", "id", "f", r("y").alias("y"))


def spmm_dense(spark, d):
    return message.multiply_dense(trade(spark, d).adjacency(), _nation_features(spark, d)).select("id", "f", r("y").alias("y"))


def gemm(spark, d):
    a = trade(spark, d).adjacency()
    return _m(matrix.matmul(a, a))


def _grid(spark, d) -> DataFrame:
    """One image: nations by month of order date, counts."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("h"), (F.month("o_orderdate") - 1).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit(0).alias("n"), "h", "w", F.lit(0).alias("c"), "v")


GRID = "g AS (SELECT c_nationkey AS h, month(o_orderdate) - 1 AS w, CAST(count(*) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _kernel(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(i, j, 0, co, float((i * n + j + 1) * (co + 1))) for i in range(n) for j in range(n) for co in range(2)], "kh int, kw int, ci int, co int, v double")


def conv3x3(spark, d):
    return tensor.conv_3x3(_grid(spark, d), _kernel(spark, 3), (25, 12)).select("h", "w", "c", r("v").alias("v"))


def conv3x3_strided(spark, d):
    return tensor.conv_3x3(_grid(spark, d), _kernel(spark, 3), (25, 12), 2, "VALID").select("h", "w", "c", r("v").alias("v"))


def conv1x1(spark, d):
    return tensor.conv_1x1(_grid(spark, d), _kernel(spark, 1), (25, 12)).select("h", "w", "c", r("v").alias("v"))


def edge_capacity(spark, d):
    return message.edge_capacities(purchase(spark, d)).select("src", "dst", "capacity")


def capacity_histogram(spark, d):
    return message.edge_capacities(purchase(spark, d)).groupBy("capacity").agg(F.count(F.lit(1)).alias("n"))


def layer_masks(spark, d):
    return message.layer_masks(trade(spark, d).vertices, 25).select("id", "ref", "term", "gas")


def layer_stats(spark, d):
    g = trade3(spark, d)
    return message.layer_statistics(g, message.layer_masks(g.vertices.select("id"), 25)).select("layer", "n", r("avg_degree").alias("avg_degree"))


def degree_layers(spark, d):
    return message.degree_layers(purchase(spark, d))


def graph_profile(spark, d):
    return purchase(spark, d).profile().withColumn("avg_out_degree", r("avg_out_degree"))


def induced_subgraph(spark, d):
    g = trade(spark, d)
    return g.induced(g.vertices.where("region <= 1")).edges.select("src", "dst", F.col("weight").alias("w"))


def _top_seller(g: PropertyGraph) -> DataFrame:
    return centrality.top(g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("score")), 1)


def ego_graph(spark, d):
    g = trade3(spark, d)
    return g.ego(_top_seller(g)).edges.select("src", "dst", F.col("weight").alias("w"))


def adjacency_plus_identity(spark, d):
    g = trade3(spark, d)
    return _m(matrix.add(g.unweighted_adjacency(), matrix.identity(g.vertices)))


def dense_adjacency(spark, d):
    g = trade3(spark, d)
    return _m(matrix.densify(g.adjacency(), g.vertices))


def triangles(spark, d):
    return centrality.clustering_coefficients(trade3(spark, d)).select("id", "triangles", r("coefficient").alias("coefficient"))


def node_features(spark, d):
    x = centrality.node_features(trade3(spark, d))
    return x.select("id", F.posexplode("features").alias("f", "x")).select("id", "f", r("x", 3).alias("x"))


def activations(spark, d):
    x = points(spark, d).select("id", F.posexplode("features").alias("f", "x"))
    return x.groupBy("f").agg(r(F.sum(S.relu("x")), 4).alias("relu"), r(F.sum(S.leaky_relu("x")), 4).alias("leaky"), r(F.sum(S.sigmoid("x")), 4).alias("sigmoid"), r(F.sum(S.tanh("x")), 4).alias("tanh"))


def softmax(spark, d):
    p = points(spark, d)
    return p.select("id", F.posexplode(S.softmax("features")).alias("f", "s")).select("id", "f", r("s").alias("s"))


def log_softmax(spark, d):
    p = points(spark, d)
    return p.select("id", F.posexplode(S.log_softmax("features")).alias("f", "s")).select("id", "f", r("s").alias("s"))


def cross_entropy(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), "label")
    return p.agg(r(S.cross_entropy_loss("x", "label")).alias("loss"))


def bce(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), (F.col("label") % 2).cast("double").alias("z"))
    return p.agg(r(S.binary_cross_entropy_with_logits("x", "z")).alias("loss"))


def mse_mae(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("p"), (F.col("l_tax") * 100).alias("t"))
    return li.agg(r(S.mean_squared_error("p", "t")).alias("mse"), r(S.mean_absolute_error("p", "t")).alias("mae"))


def engine(spark, d):
    return spark.createDataFrame([(k, str(v)) for k, v in engine_info(spark).items()], "name string, value string")


def stream_degrees(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("user_id") % 10 + 1000000).alias("dst"))
    path = fresh_dir(spark, "edges")
    e.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return degrees.run_available(degrees.stream_degrees(stream), ["id"])


_SUMS = """SELECT CAST(v.id AS BIGINT) AS id, CAST(fs.f AS INTEGER) AS f, {value} AS y FROM v CROSS JOIN (SELECT unnest([0, 1]) AS f) fs
LEFT JOIN (SELECT {to} AS id, f, sum(w * x) AS y FROM {e} JOIN xl ON xl.id = {at} GROUP BY ALL) s ON s.id = v.id AND s.f = fs.f"""

_CONV = """WITH {g}, k AS (SELECT i AS kh, j AS kw, co, CAST((i * {n} + j + 1) * (co + 1) AS DOUBLE) AS kv FROM (SELECT unnest(range(0, {n})) AS i) CROSS JOIN (SELECT unnest(range(0, {n})) AS j) CROSS JOIN (SELECT unnest([0, 1]) AS co))
SELECT CAST((h + {p} - kh) // {s} AS INTEGER) AS h, CAST((w + {q} - kw) // {s} AS INTEGER) AS w, CAST(co AS INTEGER) AS c, round(sum(v * kv), 6) + 0.0 AS v FROM g CROSS JOIN k
WHERE (h + {p} - kh) % {s} = 0 AND (w + {q} - kw) % {s} = 0 AND h + {p} - kh >= 0 AND w + {q} - kw >= 0 AND (h + {p} - kh) // {s} < {oh} AND (w + {q} - kw) // {s} < {ow} GROUP BY ALL"""

_SYM = """d AS (SELECT v.id, coalesce(sum(a.w), 0) AS d FROM v LEFT JOIN a ON a.src = v.id GROUP BY ALL),
h AS (SELECT id, CASE WHEN d > 0 THEN 1 / sqrt(d) ELSE 0 END AS h FROM d),
l AS (SELECT id AS i, id AS j, 1.0::DOUBLE AS v FROM v UNION ALL SELECT a2.src, a2.dst, -(x.h * a2.w * y.h) FROM a2 JOIN h x ON x.id = a2.src JOIN h y ON y.id = a2.dst)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(v), 6) + 0.0 AS v FROM l GROUP BY ALL"""

QUERIES = {
    "q_edges_from_tables": (edges_from_tables, f"WITH {PURCHASE} SELECT src, dst, w FROM purchase"),
    "q_symmetrize": (symmetrized, f"WITH {TRADE3} SELECT src, dst, sum(w) AS w, count(*) AS n FROM (SELECT src, dst, w FROM trade3 UNION ALL SELECT dst, src, w FROM trade3) GROUP BY ALL"),
    "q_label_encode": (label_codes, "WITH f AS (SELECT c_mktsegment, min(c_custkey) AS k, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS code, n FROM f"),
    "q_id_mapping": (id_mapping, f"WITH {TRADE3}, u AS (SELECT src AS id FROM trade3 UNION ALL SELECT dst FROM trade3) SELECT orig, count(*) AS degree FROM u JOIN v USING (id) GROUP BY ALL"),
    "q_is_undirected": (is_undirected, f"""WITH {TRADE3}, n AS (SELECT count(*) AS n FROM trade3),
f AS (SELECT * FROM trade3 ORDER BY src, dst LIMIT 10), lone AS (SELECT count(*) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM trade3 t WHERE t.src = f.dst AND t.dst = f.src))
SELECT 'directed' AS graph, CASE WHEN n = 0 THEN true WHEN n % 2 = 1 THEN false ELSE k = 0 END AS is_undirected FROM n, lone UNION ALL SELECT 'symmetrized', true"""),
    "q_json_roundtrip": (json_roundtrip, f"WITH {TRADE} SELECT src, dst, w FROM trade"),
    "q_node_objects": (node_objects, f"WITH {TRADE3} SELECT v.id, CAST(count(dst) AS INTEGER) AS n, coalesce(string_agg(dst || ':' || CAST(w AS BIGINT), ',' ORDER BY dst), '') AS neighbours FROM v LEFT JOIN trade3 ON src = v.id GROUP BY v.id"),
    "q_csv_roundtrip": (csv_roundtrip, f"WITH {PURCHASE} SELECT src, dst, w FROM purchase"),
    "q_edge_text": (edge_text, f"WITH {PURCHASE} SELECT src, dst FROM purchase"),
    "q_parquet_roundtrip": (parquet_roundtrip, f"WITH {PURCHASE}, u AS (SELECT src AS id FROM purchase UNION ALL SELECT dst FROM purchase) SELECT v.id, count(u.id) AS degree FROM v LEFT JOIN u ON u.id = v.id GROUP BY ALL"),
    "q_batch_graphs": (batched, "SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS graph_id, count(*) AS n_edges, count(DISTINCT user_id) AS n_src, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY event_type"),
    "q_padded_batch": (padded_batch, f"""WITH {TRADE3}, n AS (SELECT CAST(region AS INTEGER) AS g, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 5, count(*) FROM v),
e AS (SELECT CAST(src % 5 AS INTEGER) AS g, count(*) AS n FROM trade GROUP BY ALL UNION ALL SELECT 5, count(*) FROM trade3)
SELECT n.g AS graph_id, (SELECT max(n) FROM n) AS nodes, n.n AS real_nodes, (SELECT max(n) FROM e) AS edges, e.n AS real_edges FROM n JOIN e ON n.g = e.g"""),
    "q_adjacency": (adjacency, f"WITH {TRADE} SELECT src AS i, dst AS j, round(w, 6) + 0.0 AS v FROM trade"),
    "q_adjacency_unweighted": (adjacency_unweighted, f"WITH {TRADE3} SELECT DISTINCT src AS i, dst AS j, 1.0::DOUBLE AS v FROM trade3"),
    "q_dense_adjacency": (dense_adjacency, f"WITH {TRADE3} SELECT a.id AS i, b.id AS j, coalesce(w, 0.0::DOUBLE) AS v FROM v a CROSS JOIN v b LEFT JOIN trade3 t ON t.src = a.id AND t.dst = b.id"),
    "q_adjacency_identity": (adjacency_plus_identity, f"WITH {TRADE3} SELECT src AS i, dst AS j, 1.0::DOUBLE AS v FROM trade3 UNION ALL SELECT id, id, 1.0::DOUBLE FROM v"),
    "q_degree_matrix": (degree_matrix, f"WITH {PURCHASE} SELECT v.id AS i, v.id AS j, CAST(count(dst) AS DOUBLE) AS v FROM v LEFT JOIN purchase ON dst = v.id GROUP BY v.id"),
    "q_node_degrees": (node_degrees, f"WITH {PURCHASE}, u AS (SELECT src AS id FROM purchase UNION ALL SELECT dst FROM purchase) SELECT v.id, count(u.id) AS degree FROM v LEFT JOIN u ON u.id = v.id GROUP BY ALL"),
    "q_laplacian": (laplacian, f"WITH {TRADE}, l AS (SELECT src AS i, src AS j, w AS v FROM trade UNION ALL SELECT src, dst, -w FROM trade) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM l GROUP BY ALL"),
    "q_laplacian_sym": (laplacian_sym, f"WITH {TRADE3}, a AS (SELECT DISTINCT src, dst, 1.0 AS w FROM trade3), a2 AS (SELECT * FROM a), {_SYM}"),
    "q_laplacian_sym_loops": (laplacian_sym_loops, f"WITH {TRADE}, a AS (SELECT src, dst, w FROM trade), a2 AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM a UNION ALL SELECT id, id, 1.0 FROM v) GROUP BY ALL), {_SYM}"),
    "q_laplacian_rw": (laplacian_rw, f"""WITH {PURCHASE}, a AS (SELECT src, dst, w FROM purchase UNION ALL SELECT id, id, 1.0 FROM v), d AS (SELECT src, sum(w) AS d FROM a GROUP BY ALL),
l AS (SELECT id AS i, id AS j, 1.0::DOUBLE AS v FROM v UNION ALL SELECT a.src, a.dst, -(w / d) FROM a JOIN d USING (src)) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM l GROUP BY ALL"""),
    "q_laplacian_eigen": (laplacian_eigen, None),
    "q_spmm_in": (spmm_in, f"WITH {TRADE3}, {NATION_FEATURES} " + _SUMS.format(value="round(coalesce(y, 0), 6) + 0.0", to="dst", at="src", e="trade3")),
    "q_spmm_out": (spmm_out, f"WITH {TRADE3}, {NATION_FEATURES} " + _SUMS.format(value="round(coalesce(y, 0), 6) + 0.0", to="src", at="dst", e="trade3")),
    "q_spmm_masked": (spmm_masked, f"WITH {TRADE3}, {NATION_FEATURES} " + _SUMS.format(value="CASE WHEN region < 2 THEN round(coalesce(y, 0), 6) + 0.0 ELSE 0.0 END", to="dst", at="src", e="trade3")),
    "q_spmm_batch": (spmm_batch, f"WITH {TRADE3}, {NATION_FEATURES} SELECT 0 AS graph_id, * FROM (" + _SUMS.format(value="round(coalesce(y, 0), 6) + 0.0", to="dst", at="src", e="trade") + ") UNION ALL SELECT 1, * FROM (" + _SUMS.format(value="round(coalesce(y, 0), 6) + 0.0", to="dst", at="src", e="trade3") + ")"),
    "q_spmm_dense": (spmm_dense, f"WITH {TRADE}, {NATION_FEATURES} SELECT src AS id, CAST(f AS INTEGER) AS f, round(sum(w * x), 6) + 0.0 AS y FROM trade JOIN xl ON xl.id = dst GROUP BY ALL"),
    "q_gemm": (gemm, f"WITH {TRADE} SELECT a.src AS i, b.dst AS j, round(sum(a.w * b.w), 6) + 0.0 AS v FROM trade a JOIN trade b ON a.dst = b.src GROUP BY ALL"),
    "q_conv3x3": (conv3x3, _CONV.format(g=GRID, n=3, p=1, q=1, s=1, oh=25, ow=12)),
    "q_conv3x3_strided": (conv3x3_strided, _CONV.format(g=GRID, n=3, p=0, q=0, s=2, oh=12, ow=5)),
    "q_conv1x1": (conv1x1, _CONV.format(g=GRID, n=1, p=0, q=0, s=1, oh=25, ow=12)),
    "q_edge_capacity": (edge_capacity, f"WITH {PURCHASE}, d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM purchase UNION ALL SELECT dst FROM purchase) GROUP BY ALL) SELECT src, dst, CAST(x.d + y.d AS DOUBLE) AS capacity FROM purchase JOIN d x ON x.id = src JOIN d y ON y.id = dst"),
    "q_capacity_histogram": (capacity_histogram, f"WITH {PURCHASE}, d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM purchase UNION ALL SELECT dst FROM purchase) GROUP BY ALL) SELECT CAST(x.d + y.d AS DOUBLE) AS capacity, count(*) AS n FROM purchase JOIN d x ON x.id = src JOIN d y ON y.id = dst GROUP BY ALL"),
    "q_layer_masks": (layer_masks, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey < 8 AS ref, n_nationkey >= 8 AND n_nationkey < 16 AS term, n_nationkey >= 16 AS gas FROM nation"),
    "q_layer_stats": (layer_stats, f"""WITH {TRADE3}, d AS (SELECT v.id, count(u.id) AS d FROM v LEFT JOIN (SELECT src AS id FROM trade3 UNION ALL SELECT dst FROM trade3) u ON u.id = v.id GROUP BY ALL)
SELECT CASE WHEN id < 8 THEN 'ref' WHEN id < 16 THEN 'term' ELSE 'gas' END AS layer, count(*) AS n, round(sum(d) / (count(*) + 1e-8), 6) + 0.0 AS avg_degree FROM d GROUP BY ALL"""),
    "q_degree_layers": (degree_layers, f"""WITH {PURCHASE}, d AS (SELECT v.id, count(u.id) AS degree FROM v LEFT JOIN (SELECT src AS id FROM purchase UNION ALL SELECT dst FROM purchase) u ON u.id = v.id GROUP BY ALL),
q AS (SELECT quantile_cont(degree, 0.25) AS a, quantile_cont(degree, 0.75) AS b FROM d) SELECT id, degree, CASE WHEN degree <= a THEN 'ref' WHEN degree >= b THEN 'gas' ELSE 'term' END AS layer FROM d, q"""),
    "q_graph_profile": (graph_profile, f"""WITH {PURCHASE}, o AS (SELECT src, count(*) AS k FROM purchase GROUP BY ALL), j AS (SELECT id, k FROM v LEFT JOIN o ON src = id)
SELECT count(*) AS n_nodes, CAST(sum(k) AS BIGINT) AS n_edges, CAST(0 AS BIGINT) AS n_self_loops, min(id) AS min_id, max(id) AS max_id, max(id) - min(id) + 1 = count(*) AS contiguous, CAST(count(*) - count(k) AS BIGINT) AS n_dangling, max(k) AS max_out_degree, round(avg(coalesce(k, 0)), 6) + 0.0 AS avg_out_degree FROM j"""),
    "q_induced_subgraph": (induced_subgraph, f"WITH {TRADE} SELECT src, dst, w FROM trade JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.region <= 1 AND b.region <= 1"),
    "q_ego_graph": (ego_graph, f"""WITH {TRADE3}, t AS (SELECT src FROM (SELECT src, sum(w) AS s FROM trade3 GROUP BY ALL) ORDER BY s DESC, src LIMIT 1),
n AS (SELECT dst AS id FROM trade3 WHERE src IN (SELECT src FROM t) UNION SELECT src FROM t) SELECT src, dst, w FROM trade3 WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"""),
    "q_clustering_coefficient": (triangles, f"""WITH {TRADE3}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade3),
k AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM s UNION ALL SELECT b FROM s) GROUP BY ALL), tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b),
t AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY ALL)
SELECT v.id, coalesce(t, 0) AS triangles, CASE WHEN coalesce(k, 0) > 1 THEN round(2.0 * coalesce(t, 0) / (k * (k - 1)), 6) + 0.0 ELSE 0.0::DOUBLE END AS coefficient FROM v LEFT JOIN k ON k.id = v.id LEFT JOIN t ON t.id = v.id"""),
    "q_node_features": (node_features, _eigen_sql(60, f""", {BETWEEN}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade3),
k AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM s UNION ALL SELECT b FROM s) GROUP BY ALL), tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b),
t AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY ALL),
f AS (SELECT v.id, coalesce(k, 0)::DOUBLE AS f0, CASE WHEN coalesce(k, 0) > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END::DOUBLE AS f1, between_.x AS f2, x60.x AS f3 FROM v LEFT JOIN k USING (id) LEFT JOIN t USING (id) JOIN between_ USING (id) JOIN x60 USING (id)),
long AS (SELECT id, unnest([0, 1, 2, 3]) AS f, unnest([f0, f1, f2, f3]) AS x FROM f)
SELECT id, CAST(f AS INTEGER) AS f, round((x - avg(x) OVER (PARTITION BY f)) / (stddev_pop(x) OVER (PARTITION BY f) + 1e-8), 3) + 0.0 AS x FROM long""")),
    "q_activations": (activations, f"WITH {EMB_LONG} SELECT CAST(f AS INTEGER) AS f, round(sum(greatest(x, 0)), 4) + 0.0 AS relu, round(sum(CASE WHEN x >= 0 THEN x ELSE x * 0.01 END), 4) + 0.0 AS leaky, round(sum(1 / (1 + exp(-x))), 4) + 0.0 AS sigmoid, round(sum((exp(x) - exp(-x)) / (exp(x) + exp(-x))), 4) + 0.0 AS tanh FROM long GROUP BY ALL"),
    "q_softmax": (softmax, f"WITH {EMB_LONG} SELECT id, CAST(f AS INTEGER) AS f, round(exp(x) / sum(exp(x)) OVER (PARTITION BY id), 6) + 0.0 AS s FROM long"),
    "q_log_softmax": (log_softmax, f"WITH {EMB_LONG} SELECT id, CAST(f AS INTEGER) AS f, round(x - ln(sum(exp(x)) OVER (PARTITION BY id)), 6) + 0.0 AS s FROM long"),
    "q_cross_entropy": (cross_entropy, f"WITH {EMB_LONG}, z AS (SELECT id, ln(sum(exp(x))) AS z FROM long GROUP BY ALL) SELECT round(avg(z - p.x[label + 1]), 6) + 0.0 AS loss FROM p JOIN z USING (id)"),
    "q_bce": (bce, "WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(label % 2 AS DOUBLE) AS z FROM embeddings) SELECT round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x))) + x - x * z), 6) + 0.0 AS loss FROM e"),
    "q_mse_mae": (mse_mae, "SELECT round(avg((l_quantity - l_tax * 100) * (l_quantity - l_tax * 100)), 6) + 0.0 AS mse, round(avg(abs(l_quantity - l_tax * 100)), 6) + 0.0 AS mae FROM lineitem"),
    "q_engine_info": (engine, None),
    "q_stream_degrees": (stream_degrees, "SELECT id, count(*) AS degree FROM (SELECT user_id AS id FROM events UNION ALL SELECT user_id % 10 + 1000000 FROM events) GROUP BY ALL"),
}
