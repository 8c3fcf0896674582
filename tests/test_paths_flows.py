import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netframe import PropertyGraph
from netframe.operators import flow, paths

INF = math.inf


def graph(spark, edges, n):
    rows = [(u, v, float(w), k) for k, (u, v, w) in enumerate(edges)]
    return PropertyGraph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double, pos long"), spark.range(n), directed=False)


CASES = {
    "triangle": ([(0, 1, 3), (1, 2, 4), (0, 2, 5)], 3, [[0, 3, 5], [3, 0, 4], [5, 4, 0]], 5, 3.999999993),
    "diamond": ([(0, 1, 2), (1, 2, 3), (0, 3, 4), (3, 2, 1), (1, 3, 5)], 4, [[0, 2, 5, 4], [2, 0, 3, 4], [5, 3, 0, 1], [4, 4, 1, 0]], 5, 3.166666664),
    "disconnected": ([(0, 1, 1), (1, 2, 2), (3, 4, 3), (4, 5, 4)], 6, None, 7, 3.333333331),
    "line": ([(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4)], 5, [[0, 1, 3, 6, 10], [1, 0, 2, 5, 9], [3, 2, 0, 3, 7], [6, 5, 3, 0, 4], [10, 9, 7, 4, 0]], 10, 4.999999998),
    "star": ([(0, k, k) for k in range(1, 5)], 5, None, 7, 3.999999998),
}


@pytest.mark.parametrize("name", CASES)
def test_golden_distances(spark, name):
    edges, n, want, diameter, average = CASES[name]
    g = graph(spark, edges, n)
    d = paths.floyd_warshall(g)
    got = {(r["i"], r["j"]): r["v"] for r in d.collect()}
    if want:
        assert got == {(i, j): float(want[i][j]) for i in range(n) for j in range(n)}
    assert paths.diameter(d).first()[0] == diameter
    assert abs(paths.average_length(d).first()[0] - average) < 1e-8
    assert {(r["i"], r["j"]): r["v"] for r in paths.hop_bounded(g).collect()} == got
    assert {r["id"]: r["v"] for r in paths.single_source(g, 0).collect()} == {j: v for (i, j), v in got.items() if i == 0}


def test_single_node_loops_and_caps(spark):
    empty = PropertyGraph.from_edges(spark.createDataFrame([], "src long, dst long, weight double, pos long"), spark.range(1))
    d = paths.all_pairs(empty)
    assert [tuple(r) for r in d.collect()] == [(0, 0, 0.0)] and paths.diameter(d).first()[0] == -INF and paths.average_length(d).first()[0] == 0
    loop = PropertyGraph.from_edges(spark.createDataFrame([(0, 0, 3.0, 0), (0, 1, 1.0, 1), (1, 0, 1.0, 2)], "src long, dst long, weight double, pos long"))
    assert {(r["i"], r["j"]): r["v"] for r in paths.floyd_warshall(loop).collect()}[(0, 0)] == 2.0
    g = graph(spark, CASES["disconnected"][0], 6)
    capped = {(r["i"], r["j"]): r["v"] for r in paths.all_pairs(g, max_distance=5.0).collect()}
    assert capped[(0, 5)] == 5.0 and capped[(3, 5)] == 5.0 and len(capped) == 36
    assert {r["id"]: r["v"] for r in paths.single_source(g, 0, 2.5).collect()} == {0: 0.0, 1: 1.0, 2: 2.5, 3: 2.5, 4: 2.5, 5: 2.5}


def test_reachability(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 2), (3, 4, 3)], 5)
    assert [paths.path_exists(g, *p) for p in ((0, 1), (0, 2), (0, 3), (3, 4), (0, 0))] == [True, True, False, True, True]
    assert not paths.path_exists(g, 0, 2, 2.0) and paths.path_exists(g, 0, 2, 3.0)


def test_maximum_flow_against_every_cut(spark):
    import random
    from itertools import product

    r = random.Random(4)
    for directed in (True, False):
        edges = {(r.randrange(8), r.randrange(8)): r.randrange(1, 20) for _ in range(22)}
        edges = {k: v for k, v in edges.items() if k[0] != k[1]}
        g = PropertyGraph.from_edges(spark.createDataFrame([(*k, float(v), p) for p, (k, v) in enumerate(edges.items())], "src long, dst long, weight double, pos long"), spark.range(8))
        masks = spark.createDataFrame([(k, k < 2, k > 5) for k in range(8)], "id long, a boolean, b boolean")
        both = list(edges.items()) + ([] if directed else [((b, a), w) for (a, b), w in edges.items()])
        cuts = []
        for inside in product((False, True), repeat=4):
            side = dict(enumerate([True, True, *inside, False, False]))
            cuts.append(sum(w for (a, b), w in both if side[a] and not side[b]))
        assert flow.max_flow(g, masks, "a", "b", directed=directed) == pytest.approx(min(cuts))
    none = spark.createDataFrame([(0, True, False)], "id long, a boolean, b boolean")
    assert flow.max_flow(g, none, "a", "b") == 0.0
    with pytest.raises(ValueError):
        flow.max_flow(g, masks.selectExpr("id", "a", "a as b"), "a", "b")


def test_vulnerability_by_key(spark):
    row = spark.createDataFrame([(k, 0.1, 0.2, 0.05, 0.8, 0.5, 0.42 + k, 0.79) for k in range(3)], "id long, s12 double, s23 double, s13 double, alpha12 double, alpha23 double, p double, d double")
    s = flow.disruption_sweep(row, t_normal=5.0, t_disrupted=2.0)
    got = {r["id"]: r["stable_demand"] for r in flow.vulnerability(s, "id").collect()}
    assert got == pytest.approx({k: (0.42 + k) / 0.79 for k in range(3)})


def test_negative_cycle_is_reported(spark):
    g = PropertyGraph.from_edges(spark.createDataFrame([(0, 1, -2.0, 0), (1, 0, 1.0, 1)], "src long, dst long, weight double, pos long"))
    with pytest.raises(ValueError):
        paths.single_source(g, 0)


def test_ode_golden_and_order():
    q = {k: np.array([x]) for k, x in {"p": 0.42, "d": 0.79, "s12": 0.1, "s23": 0.2, "s13": 0.05, "alpha12": 0.8, "alpha23": 0.5}.items()}
    y = flow.integrate(q)[:, 0]
    assert np.allclose(y, [8.7042791491, 0.0, 11.1454065935], atol=1e-7)
    fine = flow.integrate(q, 2.0, 0.001)[:, 0]
    a, b = (np.abs(flow.integrate(q, 2.0, h)[:, 0] - fine).max() for h in (0.2, 0.1))
    assert a / b > 20  # fifth order
    huge = {k: v * (50 if k.startswith("s") else 1) for k, v in q.items()}
    big = flow.integrate({**huge, "p": np.array([1e6])}, constant=True)
    assert not np.isinf(big).any()  # overflow ends as nan, never as an error


def test_demand_and_failure(spark):
    row = spark.createDataFrame([(0.1, 0.2, 0.05, 0.8, 0.5, 0.42, 0.79), (0.1, 0.2, 0.05, 0.8, 0.5, 0.9, 0.79)], "s12 double, s23 double, s13 double, alpha12 double, alpha23 double, p double, d double")
    assert row.select(flow.max_stable_demand()).first()[0] == pytest.approx(0.375)
    a, b = flow.failure_time(row, 2.0).orderBy("p").collect()
    assert (a["tau"], a["qd"]) == (2.0, 1.0) and (b["tau"], b["qd"]) == (2.0, 1.0)
    s = flow.disruption_sweep(row.limit(1))
    assert s.count() == 11 and s.where("level = 1").first()["status"] == "SAFE"
    assert flow.vulnerability(s).count() == 1 and flow.threshold_counts(s).agg({"n": "sum"}).first()[0] == 11


def test_cuts(spark):
    g = PropertyGraph.from_edges(spark.createDataFrame([(0, 1, 2.0, 0), (1, 2, 3.0, 1), (0, 2, 5.0, 2), (2, 0, 7.0, 3)], "src long, dst long, weight double, pos long"), spark.range(3))
    m = spark.createDataFrame([(0, True, False), (1, False, False), (2, False, True)], "id long, a boolean, b boolean")
    assert flow.min_cut(g, m, "a", "b").first()[0] == 5.0
    assert flow.min_cut_matrix(g, m, "a", "b", edges_doubled=False).first()[0] == 5.0 + 7.0 + 2.0
    none = m.selectExpr("id", "a", "false as b")
    assert flow.min_cut_matrix(g, none, "a", "b").first()[0] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 20)), min_size=1, max_size=14))
def test_all_pairs_is_floyd_warshall(spark, edges):
    edges = [e for e in edges if e[0] != e[1]] or [(0, 1, 1)]
    d = np.full((7, 7), INF)
    np.fill_diagonal(d, 0)
    for u, v, w in edges:
        d[u, v] = d[v, u] = w
    for k in range(7):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    got = np.full((7, 7), INF)
    for r in paths.all_pairs(graph(spark, edges, 7)).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.array_equal(d, got)
