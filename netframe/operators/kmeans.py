"""k-means: points (id, features array), centroids (cluster int, centroid array).

k * d numbers of centroids travel by broadcast; their size does not grow with the points.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netframe.functions.scalar import sqdist
from netframe.plans.storage import materialize

Centres = list[list[float]]


def centres_of(centroids: DataFrame) -> Centres:
    return [list(r["centroid"]) for r in centroids.orderBy("cluster").toLocalIterator()]


def frame_of(spark, centres: Centres) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cluster int, centroid array<double>")


def table_of(centres: Centres) -> Column:
    """The centres as one array constant."""
    number = lambda x: f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)}')"
    return F.expr("array(" + ", ".join("array(" + ", ".join(map(number, c)) + ")" for c in centres) + ")")


def _distances(centres: Centres) -> Column:
    """Array of squared distances to each centre."""
    return F.transform(table_of(centres), lambda c: sqdist(F.col("features"), c))


def with_nearest(points: DataFrame, centres: Centres) -> DataFrame:
    """points with cluster int and d2: the nearest centre, the lowest of equals.  No shuffle."""
    d = points.withColumn("nf_d", _distances(centres))
    return d.withColumn("d2", F.array_min("nf_d")).withColumn("cluster", (F.array_position("nf_d", F.col("d2")) - 1).cast("int")).drop("nf_d")


def assign_clusters(points: DataFrame, centroids: DataFrame | Centres) -> DataFrame:
    """(id, cluster)."""
    c = centroids if isinstance(centroids, list) else centres_of(centroids)
    return with_nearest(points, c).select("id", "cluster")


def update_centroids(points: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(cluster, centroid): means by label; a cluster without points is the zero vector."""
    long = points.join(labels, "id").select("cluster", F.posexplode("features").alias("f", "x"))
    mean = long.groupBy("cluster", "f").agg(F.avg("x").alias("m"))
    width = long.select("f").distinct()
    grid = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).crossJoin(F.broadcast(width))
    full = grid.join(mean, ["cluster", "f"], "left").select("cluster", "f", F.coalesce("m", F.lit(0.0)).alias("m"))
    return full.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda x: x["m"]).alias("centroid"))


def inertia(points: DataFrame, labels: DataFrame, centroids: DataFrame | Centres) -> DataFrame:
    """One row, inertia: squared distances to the points' own centroids."""
    c = centroids if isinstance(centroids, list) else centres_of(centroids)
    j = points.join(labels, "id")
    return j.agg(F.coalesce(F.sum(sqdist(F.col("features"), table_of(c)[F.col("cluster")])), F.lit(0.0)).alias("inertia"))


def _means(points: DataFrame, centres: Centres) -> tuple[Centres, float, list[int]]:
    """One Lloyd step in one aggregate: new centres (an empty cluster keeps its own), inertia before it, sizes."""
    d = len(centres[0])
    w = F.col("w") if "w" in points.columns else F.lit(1.0)
    near = with_nearest(points, centres)
    rows = near.groupBy("cluster").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.sum(F.col("d2") * w).alias("cost"), *(F.sum(F.col("features")[p] * w).alias(f"s{p}") for p in range(d))).collect()  # k rows
    new, sizes, cost = [list(c) for c in centres], [0] * len(centres), 0.0
    for r in rows:
        if r["w"]:
            new[r["cluster"]] = [r[f"s{p}"] / r["w"] for p in range(d)]
        sizes[r["cluster"]] = r["n"]
        cost += r["cost"]
    return new, cost, sizes


def lloyd(points: DataFrame, centres: DataFrame | Centres, max_iter: int = 300, tol: float = 1e-4) -> tuple[DataFrame, Centres, float, int]:
    """((id, cluster), centres, inertia, iterations) from given centres.

    A step's inertia is that before its update; it stops when the inertia changes by less than
    tol of the last one.  An empty cluster keeps its centre.
    """
    c = centres if isinstance(centres, list) else centres_of(centres)
    before, made, cost = math.inf, 0, math.inf
    labels_from = c
    for _ in range(max_iter):
        labels_from = c
        c, cost, _ = _means(points, c)
        made += 1
        if abs(before - cost) < tol * abs(before) and before < math.inf:
            break
        before = cost
    return with_nearest(points, labels_from).select("id", "cluster"), c, cost, made


def random_init(points: DataFrame, k: int, seed: int = 42) -> Centres:
    """k rows without replacement, by hash of id and seed."""
    return [list(r["features"]) for r in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()]


def plus_plus_init(points: DataFrame, k: int, seed: int = 42) -> Centres:
    """k-means++: each next centre is drawn in proportion to its squared distance to the nearest one.

    A weighted draw is the row with the largest log(u) / weight (u a hash of id, seed and step), which
    needs one aggregate and no ordering of the points.
    """
    centres = random_init(points, 1, seed)
    while len(centres) < k:
        u = (F.xxhash64("id", F.lit(seed), F.lit(len(centres))).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float((1 << 53) + 1)
        near = with_nearest(points, centres)
        key = F.when(F.col("d2") > 0, F.log(u) / F.col("d2")).otherwise(F.lit(float("-inf")))
        best = near.agg(F.max_by("features", F.struct(key, -F.col("id"))).alias("c")).first()["c"]
        centres.append(list(best))
    return centres


def same_clustering(a: DataFrame, b: DataFrame) -> bool:
    """Whether two labellings (id, cluster) are one up to names."""
    pairs = a.select("id", F.col("cluster").alias("x")).join(b.select("id", F.col("cluster").alias("y")), "id").select("x", "y").distinct()
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("x"), F.countDistinct("y").alias("y")).first()
    return r["n"] == r["x"] == r["y"]


def _checked(points: DataFrame, k: int) -> int:
    if k <= 0:
        raise ValueError("n_clusters must be positive")
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if r["n"] == 0:
        raise ValueError("there are no points")
    if r["a"] != r["b"]:
        raise ValueError("points differ in length")
    if k > r["n"]:
        raise ValueError("more clusters than points")
    return r["n"]


def kmeans(points: DataFrame, k: int, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, init: str = "k-means++", seed: int = 42, weight_col: str | None = None) -> DataFrame:
    """(id, cluster) of the best of n_init runs, by inertia.

    Weights are scaled to mean 1.  Runs that only rename the best one's clusters do not replace it.
    """
    if init not in ("k-means++", "random"):
        raise ValueError(init)
    n = _checked(points, k)
    if k == 1:
        return points.select("id", F.lit(0).alias("cluster"))
    if k == n:
        from netframe.plans.indexing import with_dense_index

        return with_dense_index(points.select("id"), ["id"], "cluster").select("id", F.col("cluster").cast("int").alias("cluster"))
    own = [F.col(weight_col).cast("double").alias("w")] if weight_col else []
    p = materialize(points.select("id", F.col("features").cast("array<double>").alias("features"), *own), "points")
    if weight_col:
        low, mean = p.agg(F.min("w"), F.avg("w")).first()
        if low < 0 or mean <= 0:
            raise ValueError("weights must not be negative, nor all zero")
        p = p.withColumn("w", F.col("w") / mean)
    best, best_cost, best_centres = None, math.inf, None
    for run in range(n_init):
        start = plus_plus_init(p, k, seed + run) if init == "k-means++" else random_init(p, k, seed + run)
        labels, centres, cost, _ = lloyd(p, start, max_iter, tol)
        if best is None or (cost < best_cost and not same_clustering(labels, best)):
            best, best_cost, best_centres = materialize(labels, "labels"), cost, centres
    if len({tuple(c) for c in best_centres}) < k:
        warnings.warn("fewer distinct clusters than asked for", stacklevel=2)
    return best


def kmeans_run(points: DataFrame, k: int, max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> tuple[DataFrame, Centres, float, int]:
    """One k-means++ run to convergence: (labels, centres, inertia, iterations)."""
    _checked(points, k)
    return lloyd(points, plus_plus_init(points, k, seed), max_iter, tol)


def mini_batch_kmeans(points: DataFrame, k: int, batch_size: int = 100, max_iter: int = 100, seed: int = 42) -> tuple[DataFrame, Centres]:
    """((id, cluster), centres): each step sets the centres to the means of a batch picked by hash.

    A batch is chosen by a threshold on a hash (about batch_size rows), which reads the points once and orders nothing.
    """
    n = _checked(points, k)
    p = materialize(points.select("id", F.col("features").cast("array<double>").alias("features")), "points")
    centres = plus_plus_init(p, k, seed)
    for step in range(max_iter):
        u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(step)), F.lit(1 << 30)) / float(1 << 30)
        batch = p.where(u < min(1.0, batch_size / n))
        centres, _, _ = _means(batch, centres)
    return with_nearest(p, centres).select("id", "cluster"), centres


def fuzzy_kmeans(points: DataFrame, k: int, fuzziness: float = 2.0, max_iter: int = 100, tol: float = 1e-4, seed: int = 42, centres: Centres | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (id, membership array)): fuzzy c-means on squared distances.

    Stops when no membership changes by tol or more, and returns those before the last update.
    """
    from .soft import memberships, weighted_centres

    if fuzziness <= 1:
        raise ValueError("fuzziness must be above 1")
    c = centres or plus_plus_init(points, k, seed)
    u = None
    for _ in range(max_iter):
        new = materialize(memberships(points, c, fuzziness, floor=1e-5), "membership")
        if u is not None:
            change = new.select("id", F.col("u").alias("a")).join(u.select("id", F.col("u").alias("b")), "id").agg(F.max(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))))).first()[0]
            if change < tol:
                break
        u = new
        c = weighted_centres(points, u, fuzziness, k)
    hard = u.select("id", (F.array_position("u", F.array_max("u")) - 1).cast("int").alias("cluster"))
    return hard, u.select("id", F.col("u").alias("membership"))
