"""Clustering metrics and post-processing of labels (id, cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectral import distance_sums, length


def contingency(true: DataFrame, pred: DataFrame) -> DataFrame:
    """(t, p, n) of two labellings."""
    j = true.select("id", F.col("cluster").alias("t")).join(pred.select("id", F.col("cluster").alias("p")), "id")
    return j.groupBy("t", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _marginals(true: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, n): cells, rows, columns and the total of the contingency table in one pass."""
    c = contingency(true, pred)
    kinds = c.cube("t", "p").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    return kinds.select(F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "t").when(F.col("g") == 2, "p").otherwise("all").alias("kind"), "n")


def adjusted_rand(true: DataFrame, pred: DataFrame) -> DataFrame:
    """One row, ari; 1 where expected and largest index agree."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = _marginals(true, pred).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, pairs)), F.lit(0.0)).alias(f"x_{k}") for k in ("cell", "t", "p", "all")))
    expected = F.coalesce(F.try_divide(F.col("x_t") * F.col("x_p"), F.col("x_all")), F.lit(0.0))
    most = (F.col("x_t") + F.col("x_p")) / 2
    return s.select(F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("x_cell") - expected, most - expected)).alias("ari"))


def normalized_mutual_information(true: DataFrame, pred: DataFrame) -> DataFrame:
    """One row, nmi = 2 MI / (H_t + H_p), entropies with log(p + 1e-10); 1 if both are 0."""
    c = contingency(true, pred)
    t, p = c.groupBy("t").agg(F.sum("n").alias("nt")), c.groupBy("p").agg(F.sum("n").alias("np"))
    total = c.agg(F.sum("n").alias("total"))
    h = lambda m, col, name: m.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col(col) / F.col("total")) * F.log(F.col(col) / F.col("total") + 1e-10)).alias(name))
    mi = (
        c.join(t, "t").join(p, "p").crossJoin(F.broadcast(total))  # one row
        .agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nt") * F.col("np")))).alias("mi"))
    )
    j = mi.crossJoin(h(t, "nt", "ht")).crossJoin(h(p, "np", "hp"))  # one row each
    return j.select(F.when(F.col("ht") + F.col("hp") <= 1e-9, 1.0).otherwise(F.try_divide(2 * F.col("mi"), F.col("ht") + F.col("hp"))).alias("nmi"))


def silhouette_samples(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, s) from a distance table: (b - a) / max(a, b); 0 for a cluster of one."""
    other = labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    return _silhouettes(distances.join(other, "j").groupBy("i", "cj").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")), labels)


def _silhouettes(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, s) from the sum and number of distances of each point to each cluster: (i, cj, total, n)."""
    own = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci"))
    per = sums.join(own, "i").groupBy("i").agg(
        F.max(F.when(F.col("ci") == F.col("cj"), F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("ci") != F.col("cj"), F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(F.col("i").alias("id"), s.alias("s"))


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, silhouette, of points with Euclidean distances.

    Blocks of points hand on a sum for each point and cluster; no table of distances is made.
    """
    sums = distance_sums(points, labels).groupBy("i", "cj").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _silhouettes(sums, labels).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette"))


def within_between(similarity: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean similarity inside clusters (diagonal included) and between, and the number of clusters."""
    a, b = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    same = F.col("ci") == F.col("cj")
    j = similarity.join(a, "i").join(b, "j")
    s = j.agg(F.coalesce(F.sum(F.when(same, F.col("v"))), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.when(~same, F.col("v"))), F.lit(0.0)).alias("b"))
    return _means(s, labels)


def _means(s: DataFrame, labels: DataFrame) -> DataFrame:
    """within and between from the sums w and b of all similarities inside clusters and between."""
    n = labels.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"))
    x = s.crossJoin(n)  # one row each
    return x.select((F.col("w") / (F.col("same") + 1e-8)).alias("within"), (F.col("b") / (F.col("n") * F.col("n") - F.col("same") + 1e-8)).alias("between"), F.col("clusters").alias("n_clusters"))


def within_between_cosine(points: DataFrame) -> DataFrame:
    """within_between of the cosine similarities of all pairs of points (features, cluster), in one pass over the points.

    The product of two clusters' sums of unit vectors is the sum of the similarities between their points, so
    every pair counts and no table of pairs is made.  Points without a cluster count as a cluster whose similarities are 0.
    """
    size = length(F.filter("features", lambda x: x.isNotNull())) + 1e-8
    sized = points.where(F.col("cluster").isNotNull()).select("cluster", "features", size.alias("size"))  # once a point, not once a coordinate
    long = sized.select("cluster", "size", F.posexplode("features").alias("f", "x"))
    sums = long.groupBy("cluster", "f").agg(F.sum(F.col("x") / F.col("size")).alias("x"))
    own, all_ = F.sum(F.col("x") * F.col("x")), F.sum("x")
    by = sums.groupBy("f").agg(own.alias("w"), F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(all_ * all_ - own).alias("b"))
    return _means(by.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b")), points)


def cluster_metrics(similarity: DataFrame, labels: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """One row: silhouette (of the table as distances), within, between, n_clusters and, with true labels, ari and nmi."""
    out = silhouette_samples(similarity, labels).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette")).crossJoin(within_between(similarity, labels))
    if true is not None:
        out = out.crossJoin(adjusted_rand(true, labels)).crossJoin(normalized_mutual_information(true, labels))
    return out


def modularity(adjacency: DataFrame, labels: DataFrame, standard: bool = False) -> DataFrame:
    """One row, modularity: sum over clusters of (internal - K^2 / T') / T', K the degrees' sum.

    T' is twice the sum of A; standard=True takes the sum itself, as textbooks do.
    """
    a, b = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    j = adjacency.join(a, "i").join(b, "j")
    per = j.groupBy("ci").agg(F.sum("v").alias("k"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("v")).otherwise(0.0)).alias("inside"))
    total = per.agg((F.sum("k") * (1.0 if standard else 2.0)).alias("t"))
    terms = per.crossJoin(F.broadcast(total))  # one row
    return terms.agg(F.coalesce(F.sum(F.try_divide(F.col("inside") - F.col("k") * F.col("k") / F.col("t"), F.col("t"))), F.lit(0.0)).alias("modularity"))


def conductance(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, conductance: mean over clusters of ext / (2 int + ext + 1e-8); a cluster of all vertices is left out."""
    a, b = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    edges = adjacency.join(a, "i").join(b, "j").groupBy("ci").agg(F.sum("v").alias("k"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("v")).otherwise(0.0)).alias("inside"))
    sizes = labels.groupBy(F.col("cluster").alias("ci")).agg(F.count(F.lit(1)).alias("size"))
    n = sizes.agg(F.sum("size").alias("n"))
    j = sizes.crossJoin(F.broadcast(n)).where("size < n").join(edges, "ci", "left")
    k, inside = F.coalesce("k", F.lit(0.0)), F.coalesce("inside", F.lit(0.0))
    return j.agg(F.coalesce(F.avg((k - inside) / (2 * inside + (k - inside) + 1e-8)), F.lit(0.0)).alias("conductance"))


def relabel(labels: DataFrame) -> DataFrame:
    """(id, cluster): ranks of the labels, from 0 without gaps."""
    ranks = labels.select("cluster").distinct().withColumn("new", (F.dense_rank().over(Window.orderBy("cluster")) - 1).cast("int"))  # one row for each label
    return labels.join(F.broadcast(ranks), "cluster").select("id", F.col("new").alias("cluster"))


def merge_small(labels: DataFrame, similarity: DataFrame, min_size: int = 2) -> DataFrame:
    """(id, cluster): each cluster under min_size goes to the other one it is most similar to on average, then relabelled.

    Targets are chosen by the labels given; a target that is small itself moves on only under its own choice.
    """
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < min_size).select("cluster")
    a = labels.join(small, "cluster", "left_semi").select(F.col("id").alias("i"), F.col("cluster").alias("ci"))
    b = labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    sums = similarity.join(a, "i").join(b, "j").where("ci <> cj").groupBy("ci", "cj").agg(F.sum("v").alias("s"))
    # absent cells count as 0: divide by all pairs
    sized = sums.join(sizes.select(F.col("cluster").alias("ci"), F.col("n").alias("ni")), "ci").join(sizes.select(F.col("cluster").alias("cj"), F.col("n").alias("nj")), "cj")
    best = sized.groupBy("ci").agg(F.min_by("cj", F.struct((-F.col("s") / (F.col("ni") * F.col("nj"))).alias("s"), "cj")).alias("to"))
    moved = labels.join(best.withColumnRenamed("ci", "cluster"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
    return relabel(moved)


def changed_fraction(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row, fraction of ids whose label differs."""
    j = old.select("id", F.col("cluster").alias("a")).join(new.select("id", F.col("cluster").alias("b")), "id")
    return j.agg(F.coalesce(F.avg((F.col("a") != F.col("b")).cast("double")), F.lit(0.0)).alias("fraction"))


def converged(old: DataFrame, new: DataFrame, tol: float = 1e-4) -> bool:
    f = changed_fraction(old, new).first()[0]
    return f == 0 or f < tol


def balance(labels: DataFrame) -> DataFrame:
    """One row: smallest and largest size, their ratio and its grade."""
    r = F.col("smallest") / F.col("largest")
    s = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return s.select("smallest", "largest", r.alias("ratio"), F.when(r > 0.5, "well").when(r > 0.2, "moderate").otherwise("poor").alias("grade"))


def validate_input(points: DataFrame, k: int) -> int:
    """k, cut to the number of points; ValueError for what cannot be clustered."""
    if not points.schema["features"].dataType.simpleString().startswith("array"):
        raise ValueError("features must be arrays")
    if k <= 0:
        raise ValueError("the number of clusters must be positive")
    return min(k, points.count())


def available_algorithms(spark) -> DataFrame:
    rows = [
        ("kmeans", "hard", "Lloyd iterations from k-means++ or random centres, best of several runs"),
        ("mini_batch_kmeans", "hard", "k-means on batches picked by hash"),
        ("fuzzy_kmeans", "soft", "fuzzy c-means on squared distances"),
        ("soft_clustering", "soft", "fuzzy c-means, optionally smoothed over a graph"),
        ("spectral_clustering", "hard", "k-means on eigenvectors of an affinity's Laplacian"),
    ]
    return spark.createDataFrame(rows, "name string, kind string, description string")
