"""PageRank and shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from netframe.operators import centrality, matrix, paths
from netframe.operators.graph import PropertyGraph

from .tables import PURCHASE, TRADE, TRADE3, purchase, r, trade, trade3


def _scores(s):
    return s.select("id", r("score", 8).alias("score"))


def pagerank_trade(spark, d):
    return _scores(centrality.pagerank(trade(spark, d), max_iterations=10, tolerance=1e-15)[0])


def pagerank_purchase(spark, d):
    return _scores(centrality.pagerank(purchase(spark, d), max_iterations=5, tolerance=1e-15)[0])


def pagerank_topk(spark, d):
    return _scores(centrality.top(centrality.pagerank(purchase(spark, d), max_iterations=5, tolerance=1e-15)[0], 20))


def pagerank_converged(spark, d):
    scores, made = centrality.pagerank(trade3(spark, d), tolerance=1e-8)
    return scores.select("id", r("score", 6).alias("score"), (F.lit(made) < 100).alias("converged"))


def rank_compare(spark, d):
    a, b = (centrality.pagerank(trade(spark, d), max_iterations=k, tolerance=1e-15)[0] for k in (4, 10))
    out = centrality.compare_ranks(a, b)
    return out.select("rank", "id_a", r("score_a", 8).alias("score_a"), "id_b", r("score_b", 8).alias("score_b"), "same")


def score_errors(spark, d):
    a, b = (centrality.pagerank(trade(spark, d), max_iterations=k, tolerance=1e-15)[0] for k in (2, 10))
    out = centrality.score_errors(a, b)
    return out.select(r("max_error", 8).alias("max_error"), r("mean_error", 8).alias("mean_error"), "worst", r("correlation", 5).alias("correlation"))


def pagerank_after(spark, d):
    """Unweighted, stopping rule looked at after an iteration, tolerance by vertex."""
    scores, made = centrality.pagerank(paths.unit_costs(trade3(spark, d)), tolerance=1e-10, stop="after")
    return scores.select("id", r("score", 6).alias("score"), F.lit(made).between(1, 99).alias("settled"))


def betweenness(spark, d):
    return centrality.betweenness(trade3(spark, d)).select("id", r("score").alias("score"))


def eigenvector_centrality(spark, d):
    return centrality.eigenvector_centrality(trade3(spark, d), rounds=60).select("id", r("score", 4).alias("score"))


def apsp_floyd(spark, d):
    return paths.floyd_warshall(trade3(spark, d)).select("i", "j", r("v").alias("v"))


def apsp_minplus(spark, d):
    return paths.all_pairs(trade3(spark, d)).select("i", "j", r("v").alias("v"))


def apsp_hop_bounded(spark, d):
    return paths.hop_bounded(trade3(spark, d), 2).select("i", "j", r("v").alias("v"))


def apsp_capped(spark, d):
    return paths.all_pairs(trade3(spark, d), max_distance=200.0).select("i", "j", r("v").alias("v"))


def sssp(spark, d):
    return paths.single_source(trade3(spark, d), 0).select("id", r("v").alias("v"))


def sssp_purchase_hops(spark, d):
    """Hops from customer 0 over purchases in both directions."""
    from netframe.operators.graph import symmetrize

    g = purchase(spark, d)
    both = paths.unit_costs(PropertyGraph(g.vertices, symmetrize(g.edges)))
    return paths.single_source(both, 0).select("id", r("v").alias("v"))


def path_exists(spark, d):
    g = trade3(spark, d)
    ids = g.vertices.select("id")
    pairs = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j")))
    return paths.reachable(paths.all_pairs(g), pairs)


def diameter(spark, d):
    return paths.diameter(paths.all_pairs(trade3(spark, d)))


def avg_path(spark, d):
    return paths.average_length(paths.all_pairs(trade3(spark, d))).select(r("average").alias("average"))


def min_plus_multiply(spark, d):
    a = trade(spark, d).adjacency()
    return matrix.min_plus(a, a).select("i", "j", r("v").alias("v"))


def _pr_sql(cte: str, e: str, k: int, out: str) -> str:
    """PageRank unrolled: each round reads the one before."""
    parts = [f"""WITH {cte}, n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, sum(w) AS o FROM {e} GROUP BY ALL),
s AS (SELECT {e}.src, dst, w / o AS share FROM {e} JOIN o ON o.src = {e}.src),
h AS (SELECT id FROM v WHERE id NOT IN (SELECT src FROM o)), p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS x FROM v, n)"""]
    for i in range(1, k + 1):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(x), 0) FROM p{i - 1} JOIN h USING (id)) / n) AS x
FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(share * x) AS got FROM s JOIN p{i - 1} ON p{i - 1}.id = s.src GROUP BY ALL) g ON g.dst = v.id)""")
    return ",\n".join(parts) + "\n" + out


def _eigen_sql(rounds: int, out: str) -> str:
    """Power iteration on A + I of the undirected simple graph, unrolled."""
    parts = [f"""WITH RECURSIVE {TRADE3}, both_ways AS MATERIALIZED (SELECT src, dst FROM trade3 UNION SELECT dst, src FROM trade3), x0 AS MATERIALIZED (SELECT id, 1 / sqrt(count(*) OVER ()) AS x FROM v)"""]
    for k in range(1, rounds + 1):
        parts.append(f"""y{k} AS MATERIALIZED (SELECT a.id, a.x + coalesce(s.x, 0) AS x FROM x{k - 1} a LEFT JOIN (SELECT dst, sum(x) AS x FROM both_ways JOIN x{k - 1} ON id = src GROUP BY ALL) s ON s.dst = a.id),
x{k} AS MATERIALIZED (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM y{k})""")
    return ",\n".join(parts) + "\n" + out


#: Needs both_ways.  Walks of k edges; those of the fewest edges between two vertices are its shortest paths.
BETWEEN = """walks AS (SELECT id AS s, id AS t, 0 AS k, 1.0::DOUBLE AS n FROM v UNION ALL SELECT w.s, e.dst, w.k + 1, sum(w.n) FROM walks w JOIN both_ways e ON w.t = e.src WHERE w.k < 12 GROUP BY w.s, e.dst, w.k),
least_walks AS (SELECT s, t, min(k) AS k, arg_min(n, k) AS n FROM walks GROUP BY ALL),
between_ AS (SELECT v.id, coalesce(sum(b.n), 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2) AS x FROM v LEFT JOIN
(SELECT x.t AS id, x.n * y.n / z.n AS n FROM least_walks x JOIN least_walks y ON x.t = y.s JOIN least_walks z ON z.s = x.s AND z.t = y.t WHERE x.k + y.k = z.k AND x.s <> x.t AND y.s <> y.t) b USING (id) GROUP BY v.id)"""

_APSP = f"""WITH RECURSIVE {TRADE3}, e0 AS (SELECT src, dst, w FROM trade3 UNION ALL SELECT id, id, 0.0::DOUBLE FROM v),
d AS (SELECT src AS i, dst AS j, w AS v, 0 AS k FROM e0 UNION ALL SELECT d.i, e0.dst, min(d.v + e0.w), d.k + 1 FROM d JOIN e0 ON d.j = e0.src WHERE d.k < {{k}} GROUP BY d.i, e0.dst, d.k),
x AS (SELECT i, j, min(v) AS v FROM d GROUP BY ALL)
"""



def _hops_sql(most: int) -> str:
    """Levels of a search from customer 0, more of them than the graph is wide."""
    levels = [f"h{k} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM h{k - 1}) AND dst NOT IN (SELECT id FROM seen{k - 1})), seen{k} AS MATERIALIZED (SELECT id FROM seen{k - 1} UNION ALL SELECT id FROM h{k})" for k in range(1, most + 1)]
    return f"WITH {PURCHASE}, e AS (SELECT src, dst FROM purchase UNION SELECT dst, src FROM purchase), h0 AS (SELECT CAST(0 AS BIGINT) AS id), seen0 AS (SELECT id FROM h0), " + ", ".join(levels) + " " + " UNION ALL ".join(f"SELECT CAST(id AS BIGINT) AS id, CAST({k} AS DOUBLE) AS v FROM h{k}" for k in range(most + 1))


QUERIES = {
    "q_pagerank_trade": (pagerank_trade, _pr_sql(TRADE, "trade", 10, "SELECT id, round(x, 8) + 0.0 AS score FROM p10")),
    "q_pagerank_purchase": (pagerank_purchase, _pr_sql(PURCHASE, "purchase", 5, "SELECT id, round(x, 8) + 0.0 AS score FROM p5")),
    "q_pagerank_topk": (pagerank_topk, _pr_sql(PURCHASE, "purchase", 5, "SELECT id, round(x, 8) + 0.0 AS score FROM p5 ORDER BY x DESC, id LIMIT 20")),
    "q_pagerank_converged": (pagerank_converged, _pr_sql(TRADE3, "trade3", 60, "SELECT id, round(x, 6) + 0.0 AS score, true AS converged FROM p60")),
    "q_rank_compare": (rank_compare, _pr_sql(TRADE, "trade", 10, """, a AS (SELECT CAST(row_number() OVER (ORDER BY x DESC, id) AS INTEGER) AS rank, id, x FROM p4), b AS (SELECT CAST(row_number() OVER (ORDER BY x DESC, id) AS INTEGER) AS rank, id, x FROM p10)
SELECT a.rank, a.id AS id_a, round(a.x, 8) + 0.0 AS score_a, b.id AS id_b, round(b.x, 8) + 0.0 AS score_b, a.id = b.id AS same FROM a JOIN b USING (rank) WHERE a.rank <= 10""")),
    "q_score_errors": (score_errors, _pr_sql(TRADE, "trade", 10, """, e AS (SELECT id, p2.x AS x, p10.x AS y, abs(p2.x - p10.x) AS e FROM p2 JOIN p10 USING (id))
SELECT round(max(e), 8) + 0.0 AS max_error, round(avg(e), 8) + 0.0 AS mean_error, (SELECT id FROM e ORDER BY e DESC, id LIMIT 1) AS worst, round(corr(x, y), 5) + 0.0 AS correlation FROM e""")),
    "q_pagerank_after": (pagerank_after, _pr_sql(TRADE3 + ", ones AS (SELECT src, dst, 1.0::DOUBLE AS w FROM trade3)", "ones", 60, "SELECT id, round(x, 6) + 0.0 AS score, true AS settled FROM p60")),
    "q_betweenness": (betweenness, _eigen_sql(0, f", {BETWEEN} SELECT id, round(x, 6) + 0.0 AS score FROM between_")),
    "q_eigenvector_centrality": (eigenvector_centrality, _eigen_sql(60, "SELECT id, round(x, 4) + 0.0 AS score FROM x60")),
    "q_apsp_floyd": (apsp_floyd, _APSP.format(k=24) + "SELECT i, j, round(v, 6) + 0.0 AS v FROM x"),
    "q_apsp_minplus": (apsp_minplus, _APSP.format(k=24) + "SELECT i, j, round(v, 6) + 0.0 AS v FROM x"),
    "q_apsp_hop_bounded": (apsp_hop_bounded, _APSP.format(k=2) + "SELECT i, j, round(v, 6) + 0.0 AS v FROM x"),
    "q_apsp_capped": (apsp_capped, _APSP.format(k=24) + "SELECT a.id AS i, b.id AS j, least(coalesce(x.v, 200.0), 200.0)::DOUBLE AS v FROM v a CROSS JOIN v b LEFT JOIN x ON x.i = a.id AND x.j = b.id"),
    "q_sssp": (sssp, _APSP.format(k=24) + "SELECT j AS id, round(v, 6) + 0.0 AS v FROM x WHERE i = 0"),
    "q_sssp_purchase_hops": (sssp_purchase_hops, _hops_sql(12)),
    "q_path_exists": (path_exists, _APSP.format(k=24) + "SELECT a.id AS i, b.id AS j, x.v IS NOT NULL AS exists FROM v a CROSS JOIN v b LEFT JOIN x ON x.i = a.id AND x.j = b.id"),
    "q_diameter": (diameter, _APSP.format(k=24) + "SELECT max(v) AS diameter FROM x WHERE v > 0"),
    "q_avg_path": (avg_path, _APSP.format(k=24) + "SELECT round(sum(v) / (count(*) + 1e-8), 6) + 0.0 AS average FROM x WHERE v > 0"),
    "q_min_plus_multiply": (min_plus_multiply, f"WITH {TRADE} SELECT a.src AS i, b.dst AS j, round(min(a.w + b.w), 6) + 0.0 AS v FROM trade a JOIN trade b ON a.dst = b.src GROUP BY ALL"),
}
