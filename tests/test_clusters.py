from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netframe.functions import scalar as S
from netframe.operators import generate, kmeans, metrics, soft, spectral
from netframe.plans import storage
from netframe.queries import clusters
from netframe.streaming.degrees import windowed_edges


@pytest.fixture(scope="module")
def blobs(spark):
    p, labels = generate.blobs(spark, 120, 3, 3, 0.2)
    return p.cache(), labels.cache()


def arrays(p):
    rows = p.orderBy("id").collect()
    return np.array([r["features"] for r in rows])


def labels_of(df):
    return np.array([r["cluster"] for r in df.orderBy("id").collect()])


def test_kmeans_finds_blobs(blobs):
    p, true = blobs
    for init in ("k-means++", "random"):
        found = kmeans.kmeans(p, 3, n_init=4, init=init)
        assert metrics.adjusted_rand(true, found).first()[0] > 0.9
    assert kmeans.same_clustering(true, true.withColumn("cluster", 5 - F.col("cluster")))
    labels, centres = kmeans.mini_batch_kmeans(p, 3, 60, 5)
    assert labels.count() == 120 and len(centres) == 3
    weighted = kmeans.kmeans(p.withColumn("w", 1.0 + F.col("id") % 2), 3, n_init=2, weight_col="w")
    assert metrics.adjusted_rand(true, weighted).first()[0] > 0.9


def test_starts_and_single_runs(blobs):
    p, true = blobs
    a, b = kmeans.random_init(p, 5), kmeans.random_init(p, 5)
    rows = {tuple(x) for x in arrays(p)}
    assert a == b and len({tuple(x) for x in a}) == 5 and {tuple(x) for x in a} <= rows
    assert kmeans.random_init(p, 5, seed=7) != a
    labels, centres, cost, made = kmeans.kmeans_run(p, 3, max_iter=50)
    assert labels.count() == 120 and len(centres) == 3 and 1 <= made <= 50
    again = kmeans.lloyd(p, centres, max_iter=50)
    assert again[2] <= cost * (1 + 1e-9)


def test_weighted_lloyd_is_lloyd_on_repeated_points(spark):
    rows = [(k, [float(k % 5), float(k % 3)], 1.0 + k % 3) for k in range(20)]
    w = spark.createDataFrame(rows, "id long, features array<double>, w double")
    many = spark.createDataFrame([(100 * k + c, x) for k, x, n in rows for c in range(int(n))], "id long, features array<double>")
    start = [[0.0, 0.0], [4.0, 2.0]]
    a, b = (kmeans.lloyd(p, start, max_iter=4, tol=0.0)[1] for p in (w, many))
    assert np.allclose(a, b)


def test_silhouette_by_blocks_is_that_of_the_distances(blobs):
    p, true = blobs
    whole = metrics.silhouette_samples(spectral.euclidean_distances(p), true).agg(F.avg("s")).first()[0]
    assert abs(metrics.silhouette(p, true).first()[0] - whole) < 1e-9
    parts = spectral.distance_sums(p, true, block=17).groupBy("i", "cj").agg(F.sum("total"), F.sum("n")).count()
    assert parts == 120 * 3


def test_exact_median_without_one_task(spark):
    for values in ([3.0, 1.0, 2.0], [4.0, 1.0, 2.0, 2.0], [5.0], [1.0, 1.0, 1.0, 9.0, None]):
        d = spark.createDataFrame([(k, k, v) for k, v in enumerate(values)], "i long, j long, v double")
        assert spectral.median(d, "v", ["i", "j"]) == np.median([v for v in values if v is not None])
    assert spectral.median(d.limit(0), "v", ["i", "j"]) is None


def test_kmeans_ends_and_errors(spark, blobs):
    p, _ = blobs
    assert {r[0] for r in kmeans.kmeans(p, 1).select("cluster").collect()} == {0}
    few = p.where("id < 4")
    assert sorted(labels_of(kmeans.kmeans(few, 4))) == [0, 1, 2, 3]
    for bad in (lambda: kmeans.kmeans(few, 5), lambda: kmeans.kmeans(few, 0), lambda: kmeans.kmeans(few, 2, init="x"), lambda: kmeans.kmeans(few.limit(0), 1)):
        with pytest.raises(ValueError):
            bad()


def test_lloyd_keeps_an_empty_cluster(spark):
    p = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(4)], "id long, features array<double>")
    labels, centres, cost, made = kmeans.lloyd(p, [[0.0, 0.0], [3.0, 0.0], [100.0, 100.0]])
    assert centres[2] == [100.0, 100.0] and set(labels_of(labels)) == {0, 1} and cost == 1.0
    table = kmeans.update_centroids(p, labels, 3).where("cluster = 2").first()
    assert table["centroid"] == [0.0, 0.0]


def test_soft_clustering(blobs):
    p, true = blobs
    s = soft.soft_clustering(p, 3, max_iter=40)
    assert metrics.adjusted_rand(true, s.labels).first()[0] > 0.9
    assert all(abs(sum(r["u"]) - 1) < 1e-9 for r in s.membership.collect())
    assert s.loss_history[-1] <= s.loss_history[0] and s.iterations == len(s.loss_history)
    g = generate.similarity_graph(p.where("id < 30"))
    gs = soft.soft_clustering(p.where("id < 30"), 3, max_iter=10, adjacency=g.adjacency())
    assert all(abs(sum(r["u"]) - 1) < 1e-9 for r in gs.membership.collect())
    hard, u = kmeans.fuzzy_kmeans(p, 3, max_iter=30)
    assert metrics.adjusted_rand(true, hard).first()[0] > 0.9 and u.count() == 120
    with pytest.raises(ValueError):
        soft.soft_clustering(p, 3, temperature=1.0)


def test_memberships_by_definition(blobs):
    p, _ = blobs
    x, c = arrays(p), [[0.0, 0.0, 0.0], [1.0, 2.0, 3.0]]
    d = np.maximum(np.linalg.norm(x[:, None] - np.array(c)[None], axis=2), 1e-10)
    for m in (2.0, 1.5, 3.0):
        want = 1 / ((d[:, :, None] / d[:, None, :]) ** (2 / (m - 1))).sum(axis=2)
        got = np.array([r["u"] for r in soft.memberships(p, c, m).orderBy("id").collect()])
        assert np.allclose(got, want)


def test_spectral_clustering(spark):
    g, true = generate.planted_partition(spark, 60, 3, 0.7, 0.02)
    found, values = spectral.spectral_clustering(g.adjacency(), g.vertices, 3, n_init=3)
    assert metrics.adjusted_rand(true, found).first()[0] > 0.8 and values[0] == pytest.approx(0, abs=1e-9)
    plain, _ = spectral.spectral_clustering(g.adjacency(), g.vertices, 3, normalized=False, n_init=3)
    assert plain.count() == 60
    assert spectral.spectral_clustering(g.adjacency(), g.vertices, 3, assign="largest")[0].count() == 60
    with pytest.raises(ValueError):
        spectral.spectral_clustering(g.adjacency(), g.vertices, 61)


def test_kernels_in_blocks(blobs):
    p, _ = blobs
    x = arrays(p)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for block in (512, 17):
        got = np.zeros((120, 120))
        for r in spectral.pairwise(p, lambda a, b: np.sqrt(spectral._sq(a, b)), block).collect():
            got[r["i"], r["j"]] = r["v"]
        assert np.allclose(got, d)
    near = {(r["i"], r["j"]) for r in spectral.knn_graph(p, 4, block=17).collect()}
    own = {(i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), np.round(d[i] ** 2, 12)))[:5]}
    assert near == own | {(j, i) for i, j in own}
    assert not any(i == j for i, j in ((r["i"], r["j"]) for r in spectral.knn_graph(p, 4, include_self=False).collect()))


def silhouette(d, labels):
    out = []
    for i, c in enumerate(labels):
        same = labels == c
        if same.sum() == 1 or len(set(labels)) == 1:
            out.append(0.0)
            continue
        a, b = d[i][same].sum() / (same.sum() - 1), min(d[i][labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette(spark, blobs):
    p, true = blobs
    x = arrays(p)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    odd = true.withColumn("cluster", F.when(F.col("id") == 0, 9).otherwise(F.col("cluster")))
    for labels in (true, odd, true.withColumn("cluster", F.lit(1))):
        assert metrics.silhouette(p, labels).first()[0] == pytest.approx(silhouette(d, labels_of(labels)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=20))
def test_rand_and_information(spark, pairs):
    a = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(pairs)], "id long, cluster int")
    b = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(pairs)], "id long, cluster int")
    ab, ba = metrics.adjusted_rand(a, b).first()[0], metrics.adjusted_rand(b, a).first()[0]
    assert ab == pytest.approx(ba) and ab <= 1 + 1e-9
    assert metrics.adjusted_rand(a, a).first()[0] == 1.0
    assert metrics.normalized_mutual_information(a, a).first()[0] == pytest.approx(1.0, abs=1e-6)
    assert -1e-9 <= metrics.normalized_mutual_information(a, b).first()[0] <= 1 + 1e-6


def test_post_processing(spark):
    c = spark.createDataFrame([(0, 7), (1, 7), (2, 3), (3, 9), (4, 9)], "id long, cluster int")
    assert labels_of(metrics.relabel(c)).tolist() == [1, 1, 0, 2, 2]
    s = spark.createDataFrame([(2, 3, 0.9), (2, 0, 0.5), (2, 1, 0.6)], "i long, j long, v double")
    assert labels_of(metrics.merge_small(c, s)).tolist() == [0, 0, 0, 1, 1]
    assert metrics.converged(c, c) and not metrics.converged(c, c.withColumn("cluster", F.col("cluster") + 1))
    b = metrics.balance(c).first()
    assert (b["smallest"], b["largest"], b["grade"]) == (1, 2, "moderate")
    assert metrics.validate_input(c.select("id", F.array("cluster").alias("features")), 9) == 5
    with pytest.raises(ValueError):
        metrics.validate_input(c.withColumnRenamed("cluster", "features"), 2)
    assert metrics.available_algorithms(spark).count() == 5


def test_modularity_of_two_triangles(spark):
    e = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    m = spark.createDataFrame([(i, j, 1.0) for a, b in e for i, j in ((a, b), (b, a))], "i long, j long, v double")
    c = spark.createDataFrame([(k, k // 3) for k in range(6)], "id long, cluster int")
    assert metrics.modularity(m, c, standard=True).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert metrics.conductance(m, c).first()[0] == pytest.approx(1 / (2 * 6 + 1))


def test_scalars(spark):
    row = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0)).alias("a"), F.lit(-2.0).alias("x"))
    got = row.select(S.softmax("a").alias("s"), S.log_softmax("a").alias("l"), S.relu("x").alias("r"), S.leaky_relu("x").alias("k"), S.sigmoid("x").alias("g"), S.tanh("x").alias("t"), S.normalize(F.col("a")).alias("n"), S.safe_div(F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert got["s"] == [0.0, 0.0, 1.0] and got["l"][0] == -999.0 and got["r"] == 0.0 and got["k"] == -0.02 and got["z"] == 0.0
    assert got["g"] == pytest.approx(1 / (1 + np.exp(2))) and got["t"] == pytest.approx(np.tanh(-2)) and np.linalg.norm(got["n"]) == pytest.approx(1)
    one_hot = spark.createDataFrame([([1.0, 2.0], [0.0, 1.0], 1)], "x array<double>, y array<double>, k int")
    a, b = one_hot.agg(S.cross_entropy_loss("x", "y", True), S.cross_entropy_loss("x", "k")).first()
    assert a == pytest.approx(b) == pytest.approx(np.log(1 + np.exp(-1)))
    assert soft.adaptive_temperature_schedule()(100) == 0.1


def test_windows_drop_late_edges(spark, tmp_path):
    rows = [("2020-01-01 00:00:10", 1, 2), ("2020-01-01 00:10:00", 1, 2), ("2020-01-01 02:00:00", 3, 4)]
    df = spark.createDataFrame(rows, "t string, src long, dst long").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = windowed_edges(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "t", "1 hour", "10 minutes")
    q = s.writeStream.format("memory").queryName("w_edges").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["src"], r["dst"], r["weight"]) for r in spark.table("w_edges").collect()} <= {(1, 2, 2.0), (3, 4, 1.0)}


def test_within_between_cosine_counts_every_pair_and_makes_none(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist(), int(c)) for k, c in enumerate(rng.choice(4, 90, p=[0.7, 0.2, 0.05, 0.05]))]
    rows += [(90, [0.0] * 6, 1), (91, None, 2), (92, [], 3), (93, [1.0, None, 2.0], 0), (94, rows[0][1], None), (94, rows[1][1], 2)]
    p = spark.createDataFrame(rows, "id long, features array<double>, cluster int")
    got = metrics.within_between_cosine(p)
    x = np.array([[v or 0.0 for v in (f or [])] + [0.0] * (6 - len(f or [])) for _, f, _ in rows])
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    label = np.array([-1 if c is None else c for _, _, c in rows])
    same, known = label[:, None] == label, (label[:, None] >= 0) & (label >= 0)
    sims, n = unit @ unit.T, np.unique(label, return_counts=True)[1]
    want = (sims[same & known].sum() / (n * n).sum(), sims[~same & known].sum() / (len(rows) ** 2 - (n * n).sum()), len(n))
    assert got.first() == pytest.approx(want, abs=1e-9)
    one = metrics.within_between_cosine(p.where("cluster = 1")).first()
    assert one["between"] == 0 and one["n_clusters"] == 1


def test_within_between_query_joins_no_pairs(spark):
    plan = clusters.within_between(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Join") <= 1


def test_blocks_of_pairs_take_no_more_disk_than_the_points(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    p = spark.createDataFrame(list(enumerate(x.astype(float).tolist())), "id long, features array<double>")
    b = spectral._blocks(p, 128)
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
    b.write.parquet(f"{tmp_path}/blocks")
    assert sum(f.stat().st_size for f in (tmp_path / "blocks").glob("*.parquet")) < 1.1 * x.nbytes
    assert sorted(k for r in b.collect() for k in r["ids"]) == list(range(4000))


def test_blocks_of_pairs_keep_doubles_and_every_point(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    x[:20] = x[:20].astype(np.float32)
    x[20], x[21, 1] = [1e300, -1e300, 1e-300], 1 / 3
    for parts in (1, 2, 50):
        p = spark.createDataFrame(list(enumerate(x.tolist())), "id long, features array<double>").repartition(parts)
        blocks = spectral._blocks(p, 7).collect()
        assert max(len(r["ids"]) for r in blocks) <= 7
        assert {k: tuple(row) for r in blocks for k, row in zip(r["ids"], spectral._rows(r["ids"], r["kind"], r["rows"]))} == dict(enumerate(map(tuple, x)))
        got = {(r["i"], r["j"]): r["v"] for r in spectral.pairwise(p, lambda a, b: a @ b.T * 1e-300, 7).collect()}
        assert len(got) == 3600 and all(got[i, j] == pytest.approx(x[i] @ x[j] * 1e-300, rel=1e-9) for i in (0, 25, 59) for j in (0, 7, 40))
    assert spectral.cosine_similarities(p.where("id < 0")).count() == 0
    for odd in ([(1, None)], [(None, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(Exception, match="a point without|different lengths"):
            spectral.euclidean_distances(spark.createDataFrame(odd, "id long, features array<double>").coalesce(1)).collect()


@pytest.mark.parametrize("query", [clusters.cosine, clusters.euclid, clusters.rbf])
def test_kernel_queries_write_no_more_than_the_points(spark, monkeypatch, query):
    written = []
    monkeypatch.setattr(spectral, "materialize", lambda df, name: written.append(storage.materialize(df, name)) or written[-1])
    query(spark, "/root/testdata/sf0.01")
    (b,) = written
    points = [r["ids"] for r in b.collect()]
    assert sum(map(len, points)) == 500
    assert sum(f.stat().st_size for f in Path(b.nf_path.removeprefix("file://")).glob("*.parquet")) < 1.2 * 500 * 64 * 4


def test_symmetric_pairs_have_every_cell_once(spark):
    x = np.random.default_rng(4).normal(size=(100, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for parts, block in ((1, 7), (3, 45), (30, 7), (2, 512)):
        p = spark.createDataFrame(list(enumerate(x.tolist())), "id long, features array<double>").repartition(parts)
        got = [tuple(r) for r in spectral.symmetric_pairwise(p, lambda a, b: np.sqrt(spectral._sq(a, b)), block).collect()]
        assert len(got) == len({(i, j) for i, j, _ in got}) == 10000
        assert all(v == pytest.approx(d[i, j], abs=1e-12) for i, j, v in got)
    assert spectral.euclidean_distances(p.where("id < 0")).count() == 0


@pytest.mark.parametrize("query", [clusters.euclid, clusters.rbf])
def test_symmetric_tables_take_little_more_than_half_the_disk(spark, tmp_path, query):
    query(spark, "/root/testdata/sf0.1").write.parquet(f"{tmp_path}/pairs")
    t = spark.read.parquet(f"{tmp_path}/pairs")
    assert t.count() == t.select("i", "j").distinct().count() == 2000 * 2000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6.5 * 2000 * 2000  # a fourth lies within blocks and is written whole


def test_cosine_table_takes_little_more_than_half_the_disk(spark, tmp_path):
    clusters.cosine(spark, "/root/testdata/sf0.1").write.parquet(f"{tmp_path}/pairs")
    t = spark.read.parquet(f"{tmp_path}/pairs")
    assert t.count() == t.select("i", "j").distinct().count() == 2000 * 2000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6.5 * 2000 * 2000  # a fourth lies within blocks and is written whole


def test_symmetric_pairs_with_a_span_have_every_cell_once(spark):
    x = np.random.default_rng(6).normal(size=(1500, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    p = spark.createDataFrame(list(enumerate(x.tolist())), "id long, features array<double>")
    for parts, block, span, n in ((1, 512, 0.0, 1500), (3, 45, 1.5, 100), (2, 7, 0.5, 100), (1, 512, 100.0, 3)):
        some = p.where(F.col("id") < n).coalesce(parts)
        t = spectral.symmetric_pairwise(some, lambda a, b: np.sqrt(spectral._sq(a, b)), block, span).toPandas()
        assert len(t) == len(t[["i", "j"]].drop_duplicates()) == n * n
        assert np.allclose(t["v"], d[t["i"], t["j"]], atol=1e-12)
    assert spectral.rbf_kernel(p.where("id < 0"), span=0.1).count() == 0


def test_rbf_table_keeps_its_dictionary(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(7).normal(size=(4096, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame(list(enumerate(x.astype(float).tolist())), "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(spectral, "materialize", lambda df, name: storage.materialize(df.repartition(1), name))
    clusters.rbf(spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    t = spark.read.parquet(f"{tmp_path}/pairs")
    assert t.count() == t.select("i", "j").distinct().count() == 4096 * 4096
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2 * 4096 * 4096
