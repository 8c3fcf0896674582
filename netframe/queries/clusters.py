"""Clustering, kernels and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netframe.functions import scalar as S
from netframe.operators import generate, kmeans, metrics, soft, spectral
from netframe.operators.graph import PropertyGraph, symmetrize

from .paths import _APSP
from .tables import CENTRES, EMB, EMB_LONG, TRADE, TRADE3, first_centres, points, r, table, trade, trade3, true_labels

K = 10


def assign_clusters(spark, d):
    return kmeans.assign_clusters(points(spark, d), first_centres(spark, d))


def update_centroids(spark, d):
    c = kmeans.update_centroids(points(spark, d), true_labels(spark, d), K)
    return c.select("cluster", F.posexplode("centroid").alias("f", "x")).select("cluster", "f", r("x").alias("x"))


def inertia(spark, d):
    p, c = points(spark, d), first_centres(spark, d)
    return kmeans.inertia(p, kmeans.assign_clusters(p, c), c).select(r("inertia", 4).alias("inertia"))


def lloyd(spark, d):
    """Three Lloyd steps from the ten lowest ids."""
    labels, _, _, _ = kmeans.lloyd(points(spark, d), first_centres(spark, d), max_iter=3, tol=0.0)
    return labels


def lloyd_weighted(spark, d):
    """Three weighted Lloyd steps from the ten lowest ids; a point weighs one more than its label."""
    w = points(spark, d).join(true_labels(spark, d).select("id", (F.col("cluster") + 1).cast("double").alias("w")), "id")
    _, centres, _, _ = kmeans.lloyd(w, first_centres(spark, d), max_iter=3, tol=0.0)
    return kmeans.frame_of(spark, centres).select("cluster", F.posexplode("centroid").alias("f", "x")).select("cluster", "f", r("x").alias("x"))


def kmeans_weighted(spark, d):
    w = points(spark, d).join(true_labels(spark, d).select("id", (F.col("cluster") + 1).cast("double").alias("w")), "id")
    return kmeans.kmeans(w, K, n_init=2, max_iter=20, weight_col="w")


def kmeans_run(spark, d):
    """One run, and whether it ends no worse than its random start assigned once."""
    p = points(spark, d)
    labels, _, cost, made = kmeans.kmeans_run(p, K, max_iter=20)
    start = kmeans.random_init(p, K)
    random_cost = kmeans.inertia(p, kmeans.assign_clusters(p, start), start).first()[0]
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.lit(cost) <= F.lit(random_cost)).alias("better"), F.lit(made).between(1, 20).alias("ended"))


def kmeans_best(spark, d):
    return kmeans.kmeans(points(spark, d), K, n_init=2, max_iter=20)


def minibatch(spark, d):
    return kmeans.mini_batch_kmeans(points(spark, d), K, batch_size=200, max_iter=5)[0]


def fuzzy_kmeans(spark, d):
    hard, u = kmeans.fuzzy_kmeans(points(spark, d), 4, max_iter=4, tol=0.0, centres=first_centres(spark, d, 4))
    return _long(hard.join(u, "id").withColumnRenamed("membership", "u"))


def _long(df):
    """(id, cluster, c, u): a row for each membership."""
    return df.select("id", "cluster", F.posexplode("u").alias("c", "x")).select("id", "cluster", "c", r("x").alias("u"))


def _start(df, k):
    """Memberships from the ids alone."""
    return df.select("id", S.shares(F.array(*(((F.col("id") * 7 + 3 * c * c) % 11 + 1).cast("double") for c in range(k)))).alias("u"))


def fcm_assign(spark, d):
    u = soft.memberships(points(spark, d), first_centres(spark, d))
    return u.select("id", F.posexplode("u").alias("cluster", "x")).select("id", "cluster", r("x").alias("u"))


def fcm_step(spark, d):
    """Centres from hard labels softened to 0.7 and 0.3 shares."""
    k = 4
    u = true_labels(spark, d).select("id", F.array(*(F.when(F.col("cluster") % k == c, 0.7).otherwise(0.1) for c in range(k))).alias("u"))
    c = soft.weighted_centres(points(spark, d), u, 2.0, k)
    return kmeans.frame_of(spark, c).select("cluster", F.posexplode("centroid").alias("f", "x")).select("cluster", "f", r("x").alias("x"))


def fcm_loss(spark, d):
    p, c = points(spark, d), first_centres(spark, d)
    return soft.fcm_loss(p, soft.memberships(p, c), c).select(r("loss", 4).alias("loss"))


def hard_labels(spark, d):
    return soft.hard_assignments(soft.memberships(points(spark, d), first_centres(spark, d)))


def cluster_quality(spark, d):
    q = soft.cluster_quality(soft.memberships(points(spark, d), first_centres(spark, d)))
    return q.select(*(r(c).alias(c) for c in q.columns))


def membership_entropy(spark, d):
    q = soft.membership_entropy(soft.memberships(points(spark, d), first_centres(spark, d)))
    return q.select(*(r(c).alias(c) for c in q.columns))


def _nations(spark, d):
    """Nations as points: counts of customers and suppliers."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("a"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("b"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return n.join(c, "id", "left").join(s, "id", "left").select("id", F.array(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("features"))


NATIONS = """np AS (SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY ALL) x ON x.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY ALL) y ON y.k = n_nationkey),
u AS (SELECT id, unnest([0, 1]) AS c, CASE WHEN id % 2 = 0 THEN unnest([0.8, 0.2]) ELSE unnest([0.3, 0.7]) END::DOUBLE AS u FROM np)"""


def _nation_u(spark, d):
    return _nations(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit(0.8), F.lit(0.2))).otherwise(F.array(F.lit(0.3), F.lit(0.7))).alias("u"))


def graph_fcm_smooth(spark, d):
    u = soft.smooth(_nation_u(spark, d), trade(spark, d).adjacency())
    return u.select("id", F.posexplode("u").alias("cluster", "x")).select("id", "cluster", r("x").alias("u"))


def graph_loss(spark, d):
    g = soft.graph_loss(_nations(spark, d), _nation_u(spark, d), [[50.0, 4.0], [60.0, 3.0]], trade(spark, d).adjacency())
    return g.select(r("loss", 4).alias("loss"))


def soft_clustering(spark, d):
    p = points(spark, d)
    s = soft.soft_clustering(p, 4, max_iter=5, tol=0.0, init=_start(p, 4))
    return _long(s.labels.join(s.membership, "id"))


def graph_soft_clustering(spark, d):
    p = _nations(spark, d)
    s = soft.soft_clustering(p, 3, max_iter=6, tol=0.0, init=_start(p, 3), adjacency=trade(spark, d).adjacency())
    return _long(s.labels.join(s.membership, "id"))


def temperature(spark, d):
    return spark.range(60).select(F.col("id").alias("iteration"), r(S.adaptive_temperature("id")).alias("temperature"))


def _v(df):
    return df.select("i", "j", r("v").alias("v"))


def euclid(spark, d):
    return _v(spectral.euclidean_distances(points(spark, d)))


def cosine(spark, d):
    return _v(spectral.cosine_similarities(points(spark, d)))


def rbf(spark, d):
    """span: at six places 130,001 different values, which Parquet's dictionary of 1 MB holds."""
    return _v(spectral.rbf_kernel(points(spark, d), 0.1, span=0.13))


def knn_graph(spark, d):
    return spectral.knn_graph(points(spark, d), 5)


def knn_graph_without_self(spark, d):
    return spectral.knn_graph(points(spark, d), 5, include_self=False)


def normalize_embedding(spark, d):
    return spectral.normalize_embedding(points(spark, d)).select("id", F.posexplode("features").alias("f", "x")).select("id", "f", r("x").alias("x"))


def z_scored(spark, d):
    return spectral.z_scored(points(spark, d)).select("id", F.posexplode("features").alias("f", "x")).select("id", "f", r("x").alias("x"))


def path_similarity(spark, d):
    from netframe.operators.paths import all_pairs

    return _v(spectral.path_similarity(all_pairs(trade3(spark, d)), 100.0))


def _normalized(method):
    def run(spark, d):
        from netframe.operators.paths import all_pairs

        g = trade3(spark, d)
        return _v(spectral.normalize_path_lengths(all_pairs(g), g.vertices, method))

    return run


def path_based_similarity(spark, d):
    return _v(spectral.path_based_similarity(trade3(spark, d)))


def spectral_labels(spark, d):
    g = trade(spark, d)
    labels, values = spectral.spectral_clustering(g.adjacency(), g.vertices, 3, n_init=2)
    return labels.withColumn("value", F.round(F.lit(float(values[1])), 6))


def affinity_laplacian(spark, d):
    g = trade(spark, d)
    return _v(spectral.affinity_laplacian(spectral.symmetric_affinity(g.adjacency()), g.vertices))


def random_walk_affinity(spark, d):
    g = trade(spark, d)
    return _v(spectral.random_walk_affinity(spectral.symmetric_affinity(g.adjacency()), g.vertices))


def silhouette(spark, d):
    return metrics.silhouette(points(spark, d), true_labels(spark, d)).select(r("silhouette").alias("silhouette"))


def _assigned(spark, d):
    return kmeans.assign_clusters(points(spark, d), first_centres(spark, d))


def ari(spark, d):
    return metrics.adjusted_rand(true_labels(spark, d), _assigned(spark, d)).select(r("ari").alias("ari"))


def nmi(spark, d):
    return metrics.normalized_mutual_information(true_labels(spark, d), _assigned(spark, d)).select(r("nmi").alias("nmi"))


def contingency(spark, d):
    return metrics.contingency(true_labels(spark, d), _assigned(spark, d)).select("t", "p", F.col("n").cast("long").alias("n"))


def label_ari(spark, d):
    """Agreement of quality and toxicity labels."""
    t = table(spark, d, "labels")
    a, b = t.select(F.col("doc_id").alias("id"), F.col("quality").alias("cluster")), t.select(F.col("doc_id").alias("id"), F.col("toxic").alias("cluster"))
    return metrics.adjusted_rand(a, b).crossJoin(metrics.normalized_mutual_information(a, b)).select(r("ari").alias("ari"), r("nmi").alias("nmi"))


def within_between(spark, d):
    p = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))
    w = metrics.within_between_cosine(p)
    return w.select(r("within").alias("within"), r("between").alias("between"), "n_clusters")


def _regions(spark, d):
    return trade(spark, d).vertices.select("id", F.col("region").alias("cluster"))


def cluster_metrics(spark, d):
    m = metrics.cluster_metrics(trade(spark, d).adjacency(), _regions(spark, d), _regions(spark, d))
    return m.select(*(r(c).alias(c) for c in m.columns if c != "n_clusters"), "n_clusters")


def modularity(spark, d):
    a, c = trade(spark, d).adjacency(), _regions(spark, d)
    return metrics.modularity(a, c).crossJoin(metrics.modularity(a, c, True).withColumnRenamed("modularity", "standard")).select(r("modularity").alias("modularity"), r("standard").alias("standard"))


def conductance(spark, d):
    return metrics.conductance(trade(spark, d).adjacency(), _regions(spark, d)).select(r("conductance").alias("conductance"))


def relabel(spark, d):
    return metrics.relabel(true_labels(spark, d).withColumn("cluster", F.col("cluster") * 7 + 3))


def merge_small(spark, d):
    """Regions, with nations 0 to 2 in clusters of their own."""
    c = trade(spark, d).vertices.select("id", F.when(F.col("id") < 3, 10 + F.col("id")).otherwise(F.col("region")).cast("int").alias("cluster"))
    return metrics.merge_small(c, trade(spark, d).adjacency(), 2)


def label_convergence(spark, d):
    return metrics.changed_fraction(true_labels(spark, d), _assigned(spark, d)).select(r("fraction").alias("fraction"))


def same_clustering(spark, d):
    t = true_labels(spark, d)
    other = t.withColumn("cluster", (F.col("cluster") * 3 + 1) % 10)
    return spark.createDataFrame([("renamed", kmeans.same_clustering(t, other)), ("assigned", kmeans.same_clustering(t, _assigned(spark, d)))], "name string, same boolean")


def balance(spark, d):
    return metrics.balance(true_labels(spark, d)).withColumn("ratio", r("ratio"))


def algorithms(spark, d):
    return metrics.available_algorithms(spark)


def planted(spark, d):
    """Spectral clusters of a generated graph against what was planted."""
    g, labels = generate.planted_partition(spark)
    found, _ = spectral.spectral_clustering(g.adjacency(), g.vertices, 5, n_init=3)
    return metrics.adjusted_rand(labels, found).select((F.col("ari") > 0.7).alias("found"))


def blobs(spark, d):
    p, labels = generate.blobs(spark)
    return metrics.adjusted_rand(labels, kmeans.kmeans(p, 4, n_init=3)).select((F.col("ari") > 0.8).alias("found"))


def eigen_embedding(spark, d):
    g = trade(spark, d)
    both = PropertyGraph(g.vertices, symmetrize(g.edges))
    values, x = spectral.spectral_embedding(spectral.symmetric_affinity(both.edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("weight").alias("v"))), g.vertices, 2, drop_first=True, recover="divide")
    return x.select("id", F.transform("features", lambda c: F.round(F.abs(c), 5)).alias("features"))


_NEAR = f"""WITH {EMB}, {CENTRES}, dist AS (SELECT p.id, c.cluster, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p CROSS JOIN c),
near AS (SELECT id, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2 FROM dist GROUP BY ALL)"""
_MEMBER = _NEAR + """, q AS (SELECT id, cluster, 1 / greatest(d2, 1e-20) AS q FROM dist), u AS (SELECT id, cluster, q / sum(q) OVER (PARTITION BY id) AS u FROM q)"""
_PAIRS = f"WITH {EMB}, d AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p a CROSS JOIN p b)"
_COS = f"WITH {EMB}, nn AS (SELECT id, label, x, sqrt(list_sum(list_transform(x, lambda z: z * z))) + 1e-8 AS n FROM p), s AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.n * b.n) AS v FROM nn a CROSS JOIN nn b)"
_ALL = _APSP.format(k=24) + ", c AS (SELECT a.id AS i, b.id AS j, x.v FROM v a CROSS JOIN v b LEFT JOIN x ON x.i = a.id AND x.j = b.id)"


def _lloyd_sql(steps: int) -> str:
    parts = [f"WITH {EMB_LONG}, c0 AS (SELECT CAST(dense_rank() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, f, x AS c FROM long WHERE id IN (SELECT id FROM p ORDER BY id LIMIT 10))"]
    for k in range(steps):
        parts.append(f"d{k} AS (SELECT id, cluster, sum((x - c) * (x - c)) AS d2 FROM long JOIN c{k} USING (f) GROUP BY ALL), a{k} AS MATERIALIZED (SELECT id, arg_min(cluster, (d2, cluster)) AS cluster FROM d{k} GROUP BY ALL)")
        parts.append(f"m{k} AS (SELECT cluster, f, avg(x) AS c FROM long JOIN a{k} USING (id) GROUP BY ALL), c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, c{k}.f, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.cluster = c{k}.cluster AND m{k}.f = c{k}.f)")
    return ",\n".join(parts) + f"\nSELECT id, cluster FROM a{steps - 1}"


def _lloyd_weighted_sql(steps: int) -> str:
    return _lloyd_sql(steps).replace("avg(x) AS c FROM long JOIN", "sum(long.x * (p.label + 1)) / sum(p.label + 1) AS c FROM long JOIN p USING (id) JOIN").rpartition("\n")[0] + f"\nSELECT cluster, CAST(f AS INTEGER) AS f, round(c, 6) + 0.0 AS x FROM c{steps}"


def _fuzzy_sql(first: str, rounds: int, k: int, floor: str, smooth: str = "", centres: bool = False) -> str:
    """Fuzzy c-means on long (id, f, x), unrolled: memberships u<t> of centres c<t - 1>, which come from u<t - 1> or, with centres, are there as c0."""
    parts = [first]
    for t in range(1, rounds + 1):
        if t > 1 or not centres:
            parts.append(f"c{t - 1} AS MATERIALIZED (SELECT c, f, sum(u * u * x) / greatest(sum(u * u), 1e-10) AS x FROM u{t - 1} JOIN long USING (id) GROUP BY ALL)")
        parts.append(f"d{t} AS MATERIALIZED (SELECT id, c, 1 / greatest(sum((a.x - b.x) * (a.x - b.x)), {floor}) AS q FROM long a JOIN c{t - 1} b USING (f) GROUP BY ALL)")
        plain = f"SELECT id, c, q / sum(q) OVER (PARTITION BY id) AS u FROM d{t}"
        parts.append(f"u{t} AS MATERIALIZED ({plain})" if not smooth else f"m{t} AS MATERIALIZED ({plain}), u{t} AS MATERIALIZED ({smooth.format(u=f'm{t}')})")
    return ",\n".join(parts) + f", best AS (SELECT id, arg_min(c, (-u, c)) AS cluster FROM u{rounds} GROUP BY ALL)\nSELECT id, CAST(cluster AS INTEGER) AS cluster, CAST(c AS INTEGER) AS c, round(u, 6) + 0.0 AS u FROM u{rounds} JOIN best USING (id)"


_START = "u0 AS MATERIALIZED (SELECT id, c, s / sum(s) OVER (PARTITION BY id) AS u FROM (SELECT id, c, CAST((id * 7 + 3 * c * c) % 11 + 1 AS DOUBLE) AS s FROM (SELECT DISTINCT id FROM long) CROSS JOIN (SELECT unnest(range(0, {k})) AS c)))"
_SMOOTH = "SELECT id, c, q / sum(q) OVER (PARTITION BY id) AS u FROM (SELECT m.id, m.c, 0.9 * m.u + 0.1 * coalesce(s.s, 0) AS q FROM {u} m LEFT JOIN (SELECT src AS id, c, sum(w * u) / greatest(sum(w), 1e-10) AS s FROM trade JOIN {u} n ON n.id = dst GROUP BY ALL) s ON s.id = m.id AND s.c = m.c)"

_ARI = """SELECT round((x - a * b / t) / ((a + b) / 2 - a * b / t), 6) + 0.0 AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY t)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY p)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM ct) AS t)"""
_NMI = """tot AS (SELECT sum(n) AS total FROM ct), tt AS (SELECT t, sum(n) AS n FROM ct GROUP BY ALL), pp AS (SELECT p, sum(n) AS n FROM ct GROUP BY ALL),
mi AS (SELECT sum(ct.n / total * ln(ct.n * total / (tt.n * pp.n))) AS mi FROM ct JOIN tt ON tt.t = ct.t JOIN pp ON pp.p = ct.p, tot), ht AS (SELECT sum(-n / total * ln(n / total + 1e-10)) AS h FROM tt, tot), hp AS (SELECT sum(-n / total * ln(n / total + 1e-10)) AS h FROM pp, tot)"""
_CT = _NEAR + ", ct AS (SELECT label AS t, cluster AS p, CAST(count(*) AS DOUBLE) AS n FROM near JOIN p USING (id) GROUP BY ALL)"

QUERIES = {
    "q_assign_clusters": (assign_clusters, _NEAR + " SELECT id, cluster FROM near"),
    "q_update_centroids": (update_centroids, f"WITH {EMB_LONG}, l AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS cluster), m AS (SELECT label, f, avg(long.x) AS x FROM long JOIN p USING (id) GROUP BY ALL), fs AS (SELECT DISTINCT f FROM long) SELECT cluster, CAST(fs.f AS INTEGER) AS f, round(coalesce(m.x, 0), 6) + 0.0 AS x FROM l CROSS JOIN fs LEFT JOIN m ON m.label = cluster AND m.f = fs.f"),
    "q_inertia": (inertia, _NEAR + " SELECT round(sum(d2), 4) + 0.0 AS inertia FROM near"),
    "q_lloyd": (lloyd, _lloyd_sql(3)),
    "q_lloyd_weighted": (lloyd_weighted, _lloyd_weighted_sql(3)),
    "q_kmeans_weighted": (kmeans_weighted, None),
    "q_kmeans_run": (kmeans_run, None),
    "q_kmeans": (kmeans_best, None),
    "q_minibatch_kmeans": (minibatch, None),
    "q_fuzzy_kmeans": (fuzzy_kmeans, _fuzzy_sql(f"WITH {EMB_LONG}, c0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY id) - 1 AS c, f, x FROM long WHERE id IN (SELECT id FROM p ORDER BY id LIMIT 4))", 4, 4, "1e-10", centres=True)),
    "q_fcm_assign": (fcm_assign, _MEMBER + " SELECT id, cluster, round(u, 6) + 0.0 AS u FROM u"),
    "q_fcm_step": (fcm_step, f"WITH {EMB_LONG}, w AS (SELECT id, CAST(c AS INTEGER) AS cluster, CASE WHEN label % 4 = c THEN 0.7::DOUBLE * 0.7 ELSE 0.1::DOUBLE * 0.1 END AS w FROM p CROSS JOIN (SELECT unnest(range(0, 4)) AS c)) SELECT cluster, CAST(f AS INTEGER) AS f, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM w JOIN long USING (id) GROUP BY ALL"),
    "q_fcm_loss": (fcm_loss, _MEMBER + " SELECT round(sum(u * u * d2), 4) + 0.0 AS loss FROM u JOIN dist USING (id, cluster)"),
    "q_hard_labels": (hard_labels, _NEAR + " SELECT id, cluster FROM near"),
    "q_cluster_quality": (cluster_quality, _MEMBER + ", s AS (SELECT cluster, sum(u) AS s FROM u GROUP BY ALL) SELECT round((SELECT avg(-u * ln(u + 1e-8)) FROM u), 6) + 0.0 AS entropy, round((SELECT avg(u * u) FROM u), 6) + 0.0 AS sparsity, round(stddev_pop(s) / (avg(s) + 1e-8), 6) + 0.0 AS balance FROM s"),
    "q_membership_entropy": (membership_entropy, _MEMBER + ", g AS (SELECT id, sum(-u * ln(u + 1e-10)) AS e, max(u) AS m, sum(u * u) AS q FROM u GROUP BY ALL) SELECT round(avg(e), 6) + 0.0 AS entropy, round(avg(m), 6) + 0.0 AS max_membership, round(avg(q), 6) + 0.0 AS partition_coefficient FROM g"),
    "q_graph_fcm_smooth": (graph_fcm_smooth, f"""WITH {TRADE}, {NATIONS}, s AS (SELECT src AS id, c, sum(w * u) / greatest(sum(w), 1e-10) AS s FROM trade JOIN u ON u.id = dst GROUP BY ALL),
q AS (SELECT u.id, u.c, 0.9 * u + 0.1 * coalesce(s, 0) AS q FROM u LEFT JOIN s ON s.id = u.id AND s.c = u.c) SELECT id, CAST(c AS INTEGER) AS cluster, round(q / sum(q) OVER (PARTITION BY id), 6) + 0.0 AS u FROM q"""),
    "q_graph_loss": (graph_loss, f"""WITH {TRADE}, {NATIONS}, base AS (SELECT sum(u * u * ((a - x) * (a - x) + (b - y) * (b - y))) AS l FROM u JOIN np USING (id) JOIN (VALUES (0, 50.0, 4.0), (1, 60.0, 3.0)) AS t(c, x, y) ON t.c = u.c),
rough AS (SELECT sum(w * (p.u - q.u) * (p.u - q.u)) AS r FROM trade JOIN u p ON p.id = src JOIN u q ON q.id = dst AND q.c = p.c), kl AS (SELECT sum(w * p.u * q.u) AS m FROM trade JOIN u p ON p.id = src JOIN u q ON q.id = dst), s AS (SELECT sum(u) AS s FROM u), t AS (SELECT sum(w) AS t FROM trade)
SELECT round(l + 0.1 * r / (25 * 25) - 0.05 * (m - s * s / t) / 4, 4) + 0.0 AS loss FROM base, rough, kl, s, t"""),
    "q_soft_clustering": (soft_clustering, _fuzzy_sql(f"WITH {EMB_LONG}, " + _START.format(k=4), 5, 4, "1e-20")),
    "q_graph_soft_clustering": (graph_soft_clustering, _fuzzy_sql(f"WITH {TRADE}, {NATIONS}, long AS (SELECT id, 0 AS f, a AS x FROM np UNION ALL SELECT id, 1, b FROM np), ".replace("u AS (SELECT id, unnest", "nu AS (SELECT id, unnest") + _START.format(k=3), 6, 3, "1e-20", smooth=_SMOOTH)),
    "q_adaptive_temperature": (temperature, "SELECT CAST(i AS BIGINT) AS iteration, round(greatest(2.0::DOUBLE * pow(0.95::DOUBLE, i), 0.1), 6) + 0.0 AS temperature FROM (SELECT unnest(range(0, 60)) AS i)"),
    "q_euclid": (euclid, _PAIRS + " SELECT i, j, round(sqrt(d2), 6) + 0.0 AS v FROM d"),
    "q_cosine": (cosine, _COS + " SELECT i, j, round(v, 6) + 0.0 AS v FROM s"),
    "q_rbf": (rbf, _PAIRS + " SELECT i, j, round(exp(-0.1 * d2), 6) + 0.0 AS v FROM d"),
    "q_knn_graph": (knn_graph, _PAIRS + ", k AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d2, 12), j) AS r FROM d) WHERE r <= 6) SELECT i, j, 1.0::DOUBLE AS v FROM k UNION SELECT j, i, 1.0::DOUBLE FROM k"),
    "q_knn_graph_without_self": (knn_graph_without_self, _PAIRS + ", k AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d2, 12), j) AS r FROM d) WHERE r <= 5 AND i <> j) SELECT i, j, 1.0::DOUBLE AS v FROM k UNION SELECT j, i, 1.0::DOUBLE FROM k"),
    "q_normalize_embedding": (normalize_embedding, f"WITH {EMB_LONG} SELECT id, CAST(f AS INTEGER) AS f, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-10), 6) + 0.0 AS x FROM long"),
    "q_z_scored": (z_scored, f"WITH {EMB_LONG} SELECT id, CAST(f AS INTEGER) AS f, round((x - avg(x) OVER (PARTITION BY f)) / (stddev_pop(x) OVER (PARTITION BY f) + 1e-8), 6) + 0.0 AS x FROM long"),
    "q_path_similarity": (path_similarity, _APSP.format(k=24) + "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE round(exp(-v * v / 20000.0), 6) + 0.0 END AS v FROM x"),
    "q_normalize_min_max": (_normalized("min_max"), _ALL + " SELECT i, j, CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE round((v - (SELECT min(v) FROM x)) / ((SELECT max(v) FROM x) - (SELECT min(v) FROM x)), 6) + 0.0 END AS v FROM c"),
    "q_normalize_z_score": (_normalized("z_score"), _ALL + ", z AS (SELECT i, j, (v - (SELECT avg(v) FROM x)) / (SELECT stddev_pop(v) FROM x) AS v FROM c) SELECT i, j, round(coalesce(v, (SELECT max(abs(v)) FROM z)), 6) + 0.0 AS v FROM z"),
    "q_normalize_robust": (_normalized("robust"), _ALL + ", z AS (SELECT i, j, (v - (SELECT median(v) FROM x)) / (1.4826 * (SELECT median(abs(v - (SELECT median(v) FROM x))) FROM x)) AS v FROM c) SELECT i, j, round(coalesce(greatest(-10.0, least(10.0, v)), 10.0), 6)::DOUBLE + 0.0 AS v FROM z"),
    "q_path_based_similarity": (path_based_similarity, _ALL + ", z AS (SELECT i, j, CASE WHEN v IS NULL THEN 1.0 ELSE (v - (SELECT min(v) FROM x)) / ((SELECT max(v) FROM x) - (SELECT min(v) FROM x)) END AS v FROM c) SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE round(exp(-v * v / 2), 6) + 0.0 END AS v FROM z"),
    "q_affinity_laplacian": (affinity_laplacian, f"""WITH {TRADE}, s AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT src AS i, dst AS j, w FROM trade UNION ALL SELECT dst, src, w FROM trade) WHERE i <> j GROUP BY ALL), d AS (SELECT i, sum(w) AS d FROM s GROUP BY ALL)
SELECT s.i, s.j, round(-w / sqrt(a.d * b.d), 6) + 0.0 AS v FROM s JOIN d a ON a.i = s.i JOIN d b ON b.i = s.j UNION ALL SELECT id, id, 1.0::DOUBLE FROM v"""),
    "q_random_walk_affinity": (random_walk_affinity, f"""WITH {TRADE}, s AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT src AS i, dst AS j, w FROM trade UNION ALL SELECT dst, src, w FROM trade) GROUP BY ALL), d AS (SELECT i, sum(w) AS d FROM s GROUP BY ALL),
l AS (SELECT s.i, s.j, -w / d AS v FROM s JOIN d ON d.i = s.i UNION ALL SELECT id, id, 1.0 FROM v) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM l GROUP BY ALL"""),
    "q_spectral": (spectral_labels, None),
    "q_spectral_embedding": (eigen_embedding, None),
    "q_silhouette": (silhouette, _PAIRS + """, g AS (SELECT i, li, lj, sum(sqrt(d2)) AS t, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM g GROUP BY ALL)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM k"""),
    "q_ari": (ari, _CT + " " + _ARI),
    "q_nmi": (nmi, _CT + ", " + _NMI + " SELECT round(2 * mi / (ht.h + hp.h), 6) + 0.0 AS nmi FROM mi, ht, hp"),
    "q_contingency": (contingency, _CT + " SELECT t, p, CAST(n AS BIGINT) AS n FROM ct"),
    "q_label_ari": (label_ari, "WITH ct AS (SELECT quality AS t, toxic AS p, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY ALL), " + _NMI + f", a AS ({_ARI}) SELECT ari, round(2 * mi / (ht.h + hp.h), 6) + 0.0 AS nmi FROM a, mi, ht, hp"),
    "q_within_between": (within_between, _COS + """, c AS (SELECT sum(n * n) AS same, sum(n) AS n, count(*) AS k FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL))
SELECT round(sum(CASE WHEN li = lj THEN v ELSE 0 END) / (any_value(same) + 1e-8), 6) + 0.0 AS within, round(sum(CASE WHEN li <> lj THEN v ELSE 0 END) / (any_value(n) * any_value(n) - any_value(same) + 1e-8), 6) + 0.0 AS between, any_value(k) AS n_clusters FROM s, c"""),
    "q_cluster_metrics": (cluster_metrics, f"""WITH {TRADE}, d AS (SELECT src AS i, a.region AS li, b.region AS lj, w FROM trade JOIN v a ON a.id = src JOIN v b ON b.id = dst), g AS (SELECT i, li, lj, sum(w) AS t, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM g GROUP BY ALL), c AS (SELECT sum(n * n) AS same, sum(n) AS n, count(*) AS k FROM (SELECT region, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL)),
wb AS (SELECT sum(CASE WHEN li = lj THEN w ELSE 0 END) AS w, sum(CASE WHEN li <> lj THEN w ELSE 0 END) AS b FROM d)
SELECT (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 FROM k) AS silhouette, round(w / (same + 1e-8), 6) + 0.0 AS within, round(b / (n * n - same + 1e-8), 6) + 0.0 AS between, 1.0::DOUBLE AS ari, 1.0::DOUBLE AS nmi, k AS n_clusters FROM wb, c"""),
    "q_modularity": (modularity, f"""WITH {TRADE}, p AS (SELECT a.region, sum(w) AS k, sum(CASE WHEN a.region = b.region THEN w ELSE 0 END) AS i FROM trade JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY ALL), t AS (SELECT sum(k) AS t FROM p)
SELECT round(sum((i - k * k / (2 * t)) / (2 * t)), 6) + 0.0 AS modularity, round(sum((i - k * k / t) / t), 6) + 0.0 AS standard FROM p, t"""),
    "q_conductance": (conductance, f"WITH {TRADE}, p AS (SELECT a.region, sum(w) AS k, sum(CASE WHEN a.region = b.region THEN w ELSE 0 END) AS i FROM trade JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY ALL) SELECT round(avg((k - i) / (2 * i + k - i + 1e-8)), 6) + 0.0 AS conductance FROM p"),
    "q_relabel": (relabel, "SELECT vec_id AS id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM embeddings"),
    "q_merge_small": (merge_small, f"""WITH {TRADE}, l AS (SELECT id, CASE WHEN id < 3 THEN 10 + id ELSE region END AS c FROM v), n AS (SELECT c, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT a.c AS ci, b.c AS cj, sum(w) AS s FROM trade JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.c <> b.c AND a.c IN (SELECT c FROM n WHERE n < 2) GROUP BY ALL),
b AS (SELECT ci, arg_min(cj, (-s / (x.n * y.n), cj)) AS t FROM s JOIN n x ON x.c = ci JOIN n y ON y.c = cj GROUP BY ALL), m AS (SELECT id, coalesce(t, c) AS c FROM l LEFT JOIN b ON b.ci = l.c)
SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS cluster FROM m"""),
    "q_label_convergence": (label_convergence, _NEAR + " SELECT round(avg(CASE WHEN cluster <> label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE + 0.0 AS fraction FROM near JOIN p USING (id)"),
    "q_same_clustering": (same_clustering, _CT + " SELECT 'renamed' AS name, true AS same UNION ALL SELECT 'assigned', (SELECT count(*) = count(DISTINCT t) AND count(*) = count(DISTINCT p) FROM ct)"),
    "q_balance": (balance, "WITH n AS (SELECT count(*) AS n FROM embeddings GROUP BY label) SELECT min(n) AS smallest, max(n) AS largest, round(min(n) / max(n), 6) + 0.0 AS ratio, CASE WHEN min(n) / max(n) > 0.5 THEN 'well' WHEN min(n) / max(n) > 0.2 THEN 'moderate' ELSE 'poor' END AS grade FROM n"),
    "q_algorithms": (algorithms, None),
    "q_planted_partition": (planted, None),
    "q_blobs": (blobs, None),
}
