import pytest
from pyspark.sql import functions as F

from netframe import PropertyGraph
from netframe.operators import centrality, generate, matrix, message, tensor
from netframe.operators.graph import batch_graphs, label_codes, last_by_pos, padded
from netframe.plans.fixpoint import iterate
from netframe.plans.indexing import with_dense_index
from netframe.plans.storage import fresh_dir
from netframe.sources import files


@pytest.fixture(scope="module")
def directed(spark):
    """Four nodes, one of them alone."""
    e = spark.createDataFrame([(0, 1, 0.5, 0), (1, 2, 1.5, 1), (2, 0, 2.5, 2), (2, 1, 3.0, 3)], "src long, dst long, weight double, pos long")
    return PropertyGraph.from_edges(e, spark.range(4))


@pytest.fixture(scope="module")
def symmetric(spark):
    e = spark.createDataFrame([(0, 1, 1.5, 0), (1, 0, 1.5, 1), (1, 2, 2.0, 2), (2, 1, 2.0, 3)], "src long, dst long, weight double, pos long")
    return PropertyGraph.from_edges(e, spark.range(3))


def cells(m):
    return {(r["i"], r["j"]): round(r["v"], 8) + 0.0 for r in m.collect() if abs(r["v"]) > 1e-12}


def close(a, b, tol=1e-6):
    assert set(a) == set(b)
    assert all(abs(a[k] - b[k]) < tol for k in a)


def test_pagerank(directed):
    scores, made = centrality.pagerank(directed, stop="per_vertex")
    got = {r["id"]: r["score"] for r in scores.collect()}
    assert made == 22
    close(got, dict(enumerate([0.1924632796, 0.3850265979, 0.3748910749, 0.0476190476])), 1e-9)
    scores, made = centrality.pagerank(directed, tolerance=1e-12, stop="per_vertex")
    assert made == 47
    close({r["id"]: r["score"] for r in scores.collect()}, dict(enumerate([0.1924634225, 0.3850262066, 0.3748913232, 0.0476190476])), 1e-9)


def test_pagerank_ends(spark, directed):
    assert centrality.pagerank(PropertyGraph(spark.range(0), directed.edges.limit(0)))[0].count() == 0
    scores, made = centrality.pagerank(directed, tolerance=0.3, stop="per_vertex")
    assert made == 0 and {r["score"] for r in scores.collect()} == {0.25}
    with pytest.raises(ValueError):
        centrality.pagerank(directed, stop="never")


def test_pagerank_where_vertices_times_tolerance_is_one_or_more(spark, directed):
    """The default and the rule tested after an iteration go on; only the rule by vertex does nothing there."""
    many = PropertyGraph(spark.range(400), directed.edges)
    for stop, moved in (("total", True), ("after", True), ("per_vertex", False)):
        scores, made = centrality.pagerank(many, tolerance=0.0025, stop=stop)
        assert (made > 0) == moved and (scores.select("score").distinct().count() > 1) == moved
    a, b = (centrality.pagerank(many, tolerance=0.0025, stop=x)[1] for x in ("total", "after"))
    assert a > b == 1


def test_betweenness_against_brute_force(spark):
    from collections import deque
    from itertools import permutations

    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (5, 6), (6, 4), (7, 8), (1, 0), (3, 3)]
    n = 10
    near = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def shortest(s, t):
        found, todo, least = [], deque([(s,)]), None
        while todo:
            path = todo.popleft()
            if least is not None and len(path) > least:
                break
            if path[-1] == t:
                least = len(path)
                found.append(path)
                continue
            todo.extend(path + (x,) for x in near[path[-1]] if x not in path)
        return found

    want = dict.fromkeys(range(n), 0.0)
    for s, t in permutations(range(n), 2):
        found = shortest(s, t)
        for path in found:
            for v in path[1:-1]:
                want[v] += 1 / len(found) / ((n - 1) * (n - 2))
    g = PropertyGraph.from_edges(spark.createDataFrame([(a, b, 1.0, k) for k, (a, b) in enumerate(edges)], "src long, dst long, weight double, pos long"), spark.range(n))
    close({r["id"]: r["score"] for r in centrality.betweenness(g).collect()}, want, 1e-12)
    some = {r["id"]: r["score"] for r in centrality.betweenness(g, spark.range(n)).collect()}
    close(some, want, 1e-12)
    alone = PropertyGraph(spark.range(3), g.edges.limit(0))
    assert {r["score"] for r in centrality.betweenness(alone).collect()} == {0.0}
    features = {r["id"]: r["features"] for r in centrality.node_features(g).collect()}
    other = {r["id"]: r["features"] for r in centrality.node_features(g, small=5).collect()}
    assert abs(other[4][2] - other[4][0]) < 1e-12 and abs(features[4][2] - features[4][0]) > 1e-3


def test_eigenvectors_have_one_sign_either_way(spark):
    edges = [(k, k + 1) for k in range(7)]
    g = PropertyGraph.from_edges(spark.createDataFrame([(a, b, 1.0 + 0.1 * k, k) for k, (a, b) in enumerate(edges)], "src long, dst long, weight double, pos long"), spark.range(8), directed=False)
    m = matrix.normalized_laplacian(g, False, True)
    values, x = matrix.eigensystem(m, g.vertices, 3)
    far, y = matrix.eigensystem(m, g.vertices, 3, dense_limit=0, rounds=60)
    a, b = ({r["id"]: r["features"] for r in z.collect()} for z in (x, y))
    assert all(abs(p - q) < 1e-6 for p, q in zip(values, far))
    assert all(abs(p - q) < 1e-3 for k in a for p, q in zip(a[k], b[k]))
    assert len(matrix.eigensystem(m, g.vertices, 8, dense_limit=0, rounds=3)[0]) == 8


def test_block_min_plus_is_the_row_join(spark):
    import random

    r = random.Random(6)
    a, b = ({(r.randrange(40) * 7, r.randrange(40) * 7): float(r.randrange(1, 99)) for _ in range(700)} for _ in "ab")
    want = {}
    for (i, k), x in a.items():
        for (k2, j), y in b.items():
            if k == k2:
                want[i, j] = min(want.get((i, j), 1e9), x + y)
    left, right = (spark.createDataFrame([(*k, v) for k, v in m.items()], "i long, j long, v double") for m in (a, b))
    for block in (4, 16, 1000):
        assert cells(matrix.blocked_min_plus(left, right, 40, block)) == want
    assert cells(matrix.min_plus(left, right)) == want
    few = spark.createDataFrame([(*k, v) for k, v in list(a.items())[:5]], "i long, j long, v double")
    joined = cells(matrix.matmul(few, right, lambda x, y: x + y, F.min))
    assert joined and cells(matrix.min_plus(few, right)) == cells(matrix.blocked_min_plus(few, right, 40, 16)) == joined
    none = left.limit(0)
    assert matrix.min_plus(none, right).count() == matrix.blocked_min_plus(none, right, 40).count() == 0


def test_node_objects_and_the_size_of_one_document(spark, directed):
    got = {r["id"]: [tuple(x) for x in r["neighbours"]] for r in files.node_objects(directed).collect()}
    assert got == {0: [(1, 0.5)], 1: [(2, 1.5)], 2: [(0, 2.5), (1, 3.0)], 3: []}
    with pytest.raises(ValueError):
        files.write_node_link(directed, fresh_dir(spark, "json"), most=7)


def test_laplacians(symmetric):
    close(cells(matrix.laplacian(symmetric)), {(0, 0): 1.5, (0, 1): -1.5, (1, 0): -1.5, (1, 1): 3.5, (1, 2): -2, (2, 1): -2, (2, 2): 2})
    h = -0.70710678
    close(cells(matrix.normalized_laplacian(symmetric, False)), {(0, 0): 1, (0, 1): h, (1, 0): h, (1, 1): 1, (1, 2): h, (2, 1): h, (2, 2): 1})
    close(cells(matrix.normalized_laplacian(symmetric)), {(0, 1): h, (1, 0): h, (1, 1): 0.5, (1, 2): h, (2, 1): h})
    close(cells(matrix.random_walk_laplacian(symmetric)), {(0, 0): 0.6, (0, 1): -0.6, (1, 0): -1 / 3, (1, 1): 7 / 9, (1, 2): -4 / 9, (2, 1): -2 / 3, (2, 2): 2 / 3})


def test_eigensystem_dense_and_distributed(symmetric):
    m = matrix.normalized_laplacian(symmetric, False)
    values, x = matrix.eigensystem(m, symmetric.vertices, 3)
    assert [round(v, 8) + 0.0 for v in values] == [0.0, 1.0, 2.0] and x.count() == 3
    values, x = matrix.eigensystem(m, symmetric.vertices, 1, dense_limit=0, rounds=30)
    assert abs(values[0]) < 1e-6
    f = {r["id"]: abs(r["features"][0]) for r in x.collect()}
    close(f, {0: 0.5, 1: 0.70710678, 2: 0.5}, 1e-4)


def test_message_passing(spark, symmetric):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, features array<double>")
    got = {r["id"]: r["features"] for r in message.gather(message.propagate(symmetric, x)).collect()}
    assert got == {0: [0.0, 1.5], 1: [3.5, 2.0], 2: [0.0, 2.0]}
    masked = {(r["id"], r["f"]): r["y"] for r in message.propagate(symmetric, x, mask=F.col("id") == 1).collect()}
    assert masked[(1, 0)] == 3.5 and masked[(0, 1)] == 0.0
    with pytest.raises(ValueError):
        message.propagate(symmetric, x.select("id", F.lit(1.0).alias("features")))


def test_degrees_and_capacities(directed):
    assert {r["id"]: r["degree"] for r in matrix.node_degrees(directed).collect()} == {0: 2, 1: 3, 2: 3, 3: 0}
    assert {r["id"]: r["degree"] for r in matrix.in_degrees(directed).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
    assert {(r["src"], r["dst"]): r["capacity"] for r in message.edge_capacities(directed, lambda e: F.col("weight") * 2).collect()}[(2, 1)] == 6.0


def test_undirected_rules(spark, directed, symmetric):
    assert symmetric.is_undirected() and not directed.is_undirected() and symmetric.is_undirected(None)
    assert PropertyGraph(spark.range(2), symmetric.edges.limit(0)).is_undirected()
    loop = spark.createDataFrame([(1, 1, 1.0, 0)], "src long, dst long, weight double, pos long")
    assert PropertyGraph.from_edges(loop, directed=False).n_edges() == 2
    assert "undirected" in symmetric.describe() and "nodes=4" in directed.describe()


def test_duplicates_last_wins_in_views_and_add_up_in_sums(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0), (0, 1, 5.0, 1)], "src long, dst long, weight double, pos long")
    g = PropertyGraph.from_edges(e)
    assert cells(g.adjacency()) == {(0, 1): 5.0} and last_by_pos(g.edges).first()["weight"] == 5.0
    x = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "id long, features array<double>")
    assert {r["id"]: r["y"] for r in message.propagate(g, x).collect()}[1] == 6.0


def test_names_and_codes(spark):
    e = spark.createDataFrame([("b", "a", 0), ("a", "c", 1)], "src string, dst string, pos long")
    g = PropertyGraph.from_named_edges(e)
    assert {r["orig"]: r["id"] for r in g.vertices.collect()} == {"b": 0, "a": 1, "c": 2}
    assert g.original_id(2) == "c" and g.index_of("a") == 1 and g.index_of("z") is None and g.original_id(9) == 9
    df = spark.createDataFrame([("y", 3), ("x", 1), ("y", 0), (None, 2)], "s string, p long")
    assert {r["s"]: r["code"] for r in label_codes(df, "s", "p").collect()} == {"y": 0, "x": 1}


def test_batches_and_padding(directed, symmetric):
    g = batch_graphs([directed, symmetric])
    v, e = padded(g)
    assert v.groupBy("graph_id").count().select("count").distinct().count() == 1
    assert e.where("not mask").count() == 0 and v.where("not mask").count() == 1
    with pytest.raises(ValueError):
        batch_graphs([])


def test_files(spark, directed, tmp_path):
    want = {(r["src"], r["dst"], r["weight"]) for r in directed.edges.collect()}
    path = fresh_dir(spark, "t")
    files.write_node_link(directed, path)
    back = files.read_node_link(spark, path)
    assert {(r["src"], r["dst"], r["weight"]) for r in back.edges.collect()} == want and back.n_nodes() == 4
    path = fresh_dir(spark, "t")
    files.write_csv(directed, path)
    back = files.read_csv(spark, path)
    assert {(r["src"], r["dst"], r["weight"]) for r in back.edges.collect()} == want and back.n_nodes() == 3
    (tmp_path / "e.csv").write_text("source,target\n0.0,1.0\n\n2,0\n")
    one = files.read_csv(spark, f"file://{tmp_path}/e.csv", weighted=False)
    assert {(r["src"], r["dst"], r["weight"]) for r in one.edges.collect()} == {(0, 1, 1.0), (2, 0, 1.0)}
    (tmp_path / "none.csv").write_text("source,target,weight\n")
    assert files.read_csv(spark, f"file://{tmp_path}/none.csv").n_nodes() == 0
    (tmp_path / "g.txt").write_text("# a comment\n1\t2\n2 3\n1 2\n3 3\n9 1\n")
    t = files.read_edge_text(spark, f"file://{tmp_path}/g.txt", max_id=9, drop_loops=True)
    assert {(r["src"], r["dst"]) for r in t.edges.collect()} == {(1, 2), (2, 3)}
    every = files.read_edge_text(spark, f"file://{tmp_path}/g.txt", every=2)
    assert {(r["src"], r["dst"]) for r in every.edges.collect()} == {(1, 2), (9, 1)}
    (tmp_path / "w.json").write_text('{"nodes": [{"id": 5, "features": [1.0]}, {"id": 7, "features": [2.0]}], "links": [{"source": 0, "target": 1}]}')
    j = files.read_node_link(spark, f"file://{tmp_path}/w.json")
    assert j.edges.first()["weight"] is None and [r["features"] for r in j.vertices.orderBy("id").collect()] == [[1.0], [2.0]]


def test_subgraphs_and_profile(directed):
    assert directed.masked(edge_mask=F.col("weight") > 1).n_edges() == 3
    assert directed.masked(F.col("id") != 1).n_edges() == 1
    centre = directed.vertices.where("id = 2")
    assert directed.ego(centre).n_edges() == 4
    p = directed.profile().first()
    assert (p["n_nodes"], p["n_edges"], p["n_dangling"], p["max_out_degree"]) == (4, 4, 1, 2)


def test_conv_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, k = r.normal(size=(5, 6, 2)), r.normal(size=(3, 3, 2, 3))
    inputs = spark.createDataFrame([(0, i, j, c, float(x[i, j, c])) for i in range(5) for j in range(6) for c in range(2)], "n int, h int, w int, c int, v double")
    kernel = spark.createDataFrame([(a, b, c, o, float(k[a, b, c, o])) for a in range(3) for b in range(3) for c in range(2) for o in range(3)], "kh int, kw int, ci int, co int, v double")
    for strides, padding in ((1, "SAME"), (2, "SAME"), (1, "VALID"), ((2, 1), "VALID")):
        sh, sw = (strides, strides) if isinstance(strides, int) else strides
        if padding == "SAME":
            oh, ow = -(-5 // sh), -(-6 // sw)
            ph, pw = max((oh - 1) * sh + 3 - 5, 0), max((ow - 1) * sw + 3 - 6, 0)
            z = np.pad(x, ((ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2), (0, 0)))
        else:
            oh, ow, z = (5 - 3) // sh + 1, (6 - 3) // sw + 1, x
        want = {(i, j, o): (z[i * sh : i * sh + 3, j * sw : j * sw + 3, :, None] * k).sum(axis=(0, 1, 2))[o] for i in range(oh) for j in range(ow) for o in range(3)}
        close({(q["h"], q["w"], q["c"]): q["v"] for q in tensor.conv(inputs, kernel, (5, 6), (3, 3), strides, padding).collect()}, want, 1e-9)
    with pytest.raises(AssertionError):
        tensor.conv_1x1(inputs, kernel, (5, 6))


def test_dense_index_and_loops(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert {(r["k"], r["n"]) for r in with_dense_index(df.repartition(6), ["k"], "n").collect()} == {(k, k) for k in range(1000)}
    state, seen, made = iterate(spark.range(3).toDF("x"), lambda s, row, k: s.select((F.col("x") + 1).alias("x")), lambda: [F.max("x").alias("top")], lambda row, k: row["top"] >= 7, 100, cut_every=2)
    assert made == 5 and seen["top"] == 7 and sorted(r[0] for r in state.collect()) == [5, 6, 7]


def test_generators_do_not_depend_on_partitions(spark):
    a = generate.random_graph(spark, 40, 0.3)
    assert a.is_undirected(None) and 0.2 < a.n_edges() / (40 * 39) < 0.4
    assert generate.grid_graph(spark, 3, 4).n_edges() == 2 * (3 * 3 + 2 * 4)
    g, masks = generate.supply_chain(spark, (2, 3, 20))
    assert masks.where("ref").count() == 2 and g.edges.where("src >= dst").count() == 0


def test_triangles_of_a_complete_graph(spark):
    g = generate.random_graph(spark, 5, 1.1)
    assert {(r["triangles"], r["coefficient"]) for r in centrality.clustering_coefficients(g).collect()} == {(6, 1.0)}
    s = {r["score"] for r in centrality.eigenvector_centrality(g).collect()}
    assert all(abs(x - 5**-0.5) < 1e-6 for x in s)
