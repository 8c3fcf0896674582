"""PageRank and other vertex scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netframe.plans.fixpoint import iterate
from netframe.plans.storage import materialize

from .graph import PropertyGraph, symmetrize, weight


def pagerank(g: PropertyGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, stop: str = "total") -> tuple[DataFrame, int]:
    """((id, score), iterations): scores sum to 1; dangling mass is spread evenly.

    stop says when the scores' L1 change is small enough:
        total       at most tolerance, whatever the number n of vertices (default)
        per_vertex  at most n * tolerance; looked at before the first iteration too, where the change counts
                    as 1: with a million vertices and the default tolerance there is no iteration
        after       below n * tolerance, after an iteration

    An iteration is one join with the normalised edges, one group-by, and one
    aggregate that watches the change and the dangling mass of the next one.
    """
    n = g.vertices.count()
    start = g.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("score"))
    small = {"total": lambda x: x <= tolerance, "per_vertex": lambda x: x <= n * tolerance, "after": lambda x: x < n * tolerance}.get(stop)
    if small is None:
        raise ValueError(stop)
    if n == 0 or max_iterations == 0 or (stop == "per_vertex" and small(1.0)):
        return start, 0
    out = g.edges.groupBy("src").agg(F.sum(weight()).alias("total"))
    # loop invariants: w / out-weight by edge, and which vertices dangle
    share = g.edges.join(out, "src").groupBy("src", "dst").agg(F.sum(weight() / F.col("total")).alias("share"))
    share = materialize(share.where("share is not null"), "share")
    marked = g.vertices.select("id").join(out.where("total > 0").select(F.col("src").alias("id"), F.lit(False).alias("no")), "id", "left")
    marked = materialize(marked.select("id", F.coalesce("no", F.lit(True)).alias("dangling")), "vertices")
    hanging = marked.agg(F.sum(F.col("dangling").cast("long"))).first()[0] or 0
    state = marked.select("id", "dangling", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("before"))

    def step(state: DataFrame, seen, k: int) -> DataFrame:
        loose = hanging / n if seen is None else (seen["loose"] or 0.0) / seen["total"]
        scale = 1.0 if seen is None else seen["total"]
        cur = state.select("id", "dangling", (F.col("score") / scale).alias("score"))
        came = share.join(cur.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
        return cur.join(came, "id", "left").select("id", "dangling", new.alias("score"), F.col("score").alias("before"))

    def watch():
        return [F.sum("score").alias("total"), F.sum(F.when(F.col("dangling"), F.col("score"))).alias("loose"), F.sum(F.abs(F.col("score") - F.col("before"))).alias("change")]

    state, seen, made = iterate(state, step, watch, lambda s, k: small(s["change"]), max_iterations)
    return state.select("id", (F.col("score") / seen["total"]).alias("score")), made


def top(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k highest scores, ties by id."""
    return scores.orderBy(F.col("score").desc(), "id").limit(k)


def compare_ranks(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(rank, id_a, score_a, id_b, score_b, same) of both tops."""
    w = Window.orderBy(F.col("score").desc(), "id")  # k rows

    def ranked(s: DataFrame, x: str) -> DataFrame:
        return top(s, k).select(F.row_number().over(w).cast("int").alias("rank"), F.col("id").alias(f"id_{x}"), F.col("score").alias(f"score_{x}"))

    return ranked(a, "a").join(ranked(b, "b"), "rank").withColumn("same", F.col("id_a") == F.col("id_b"))


def score_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: max_error, mean_error, id with the largest error, correlation."""
    j = a.select("id", F.col("score").alias("x")).join(b.select("id", F.col("score").alias("y")), "id").withColumn("e", F.abs(F.col("x") - F.col("y")))
    return j.agg(F.max("e").alias("max_error"), F.avg("e").alias("mean_error"), F.max_by("id", F.struct("e", -F.col("id"))).alias("worst"), F.corr("x", "y").alias("correlation"))


def _simple(g: PropertyGraph) -> DataFrame:
    """Undirected simple edges (a < b)."""
    return g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def clustering_coefficients(g: PropertyGraph) -> DataFrame:
    """(id, triangles, coefficient) of the undirected simple graph.

    Each edge points from the end with fewer neighbours to the other, so no vertex has more than
    sqrt(2 m) out-edges and a hub does not square.
    """
    e = _simple(g)
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    d = e.join(deg.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    forward = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    o = materialize(d.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    pairs = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x <> y")
    found = pairs.join(o.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"])
    t = found.select(F.explode(F.array("u", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    j = g.vertices.select("id").join(deg, "id", "left").join(t, "id", "left")
    k, n = F.coalesce("k", F.lit(0)), F.coalesce("t", F.lit(0))
    return j.select("id", n.cast("long").alias("triangles"), F.when(k > 1, 2.0 * n / (k * (k - 1))).otherwise(0.0).alias("coefficient"))


def eigenvector_centrality(g: PropertyGraph, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(id, score): power iteration on A + I of the undirected graph, length 1."""
    e = materialize(symmetrize(_simple(g).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("pos"))).select("src", "dst"), "both")
    n = max(1, g.vertices.count())
    state = g.vertices.select("id", F.lit(n**-0.5).alias("score"), F.lit(0.0).alias("before"))

    def step(state, seen, k):
        cur = state.select("id", (F.col("score") / (seen["size"] if seen else 1.0)).alias("score"))
        came = e.join(cur.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        return cur.join(came, "id", "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("before"))

    watch = lambda: [F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("size"), (F.sum(F.col("score") * F.col("before")) / F.sqrt(F.sum(F.col("score") * F.col("score")))).alias("turn")]
    state, seen, _ = iterate(state, step, watch, lambda s, k: 1 - s["turn"] < tolerance * tolerance, rounds)
    return state.select("id", (F.col("score") / seen["size"]).alias("score"))


def betweenness(g: PropertyGraph, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """(id, score): shares of shortest paths (in edges) between others that a vertex of the undirected simple graph is on.

    All sources advance together, a level of neighbours a round, and what depends on a vertex is added up from
    the farthest level back, so there are as many rounds as the graph is wide.  With every vertex as a source (the
    default) the work and the tables are n * m by their nature; `sources` (id) restricts the sum to paths from
    those, scaled up to all.
    """
    pairs = _simple(g)
    e = materialize(symmetrize(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("pos"))).select("src", "dst"), "both")
    n = g.vertices.count()
    start = (g.vertices if sources is None else sources).select(F.col("id").alias("s")).distinct()
    begun = start.count()
    levels = [materialize(start.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        out = levels[-1].join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        # what was met before is on the last two levels
        for seen in levels[-2:]:
            out = out.join(seen.select("s", "v"), ["s", "v"], "left_anti")
        out = materialize(out, "level")
        if out.isEmpty():
            break
        levels.append(out)
    gained, later = None, levels[-1].withColumn("rests", F.lit(0.0))
    for k in range(len(levels) - 1, 0, -1):
        gained = later if gained is None else gained.unionByName(later)
        back = later.select("s", F.col("v").alias("src"), ((1 + F.col("rests")) / F.col("paths")).alias("part")).join(e, "src")
        sums = back.groupBy("s", F.col("dst").alias("v")).agg(F.sum("part").alias("part"))
        here = levels[k - 1].join(sums, ["s", "v"], "left")
        later = materialize(here.select("s", "v", "paths", F.coalesce(F.col("paths") * F.col("part"), F.lit(0.0)).alias("rests")), "level")
    ids = g.vertices.select("id")
    if gained is None:
        return ids.select("id", F.lit(0.0).alias("score"))
    by = max(1, (n - 1) * (n - 2)) if normalized else 2
    total = gained.groupBy(F.col("v").alias("id")).agg((F.sum("rests") * (n / begun) / by).alias("score"))
    return ids.join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


#: Vertices up to which node_features takes the betweenness itself.
SMALL = 100


def node_features(g: PropertyGraph, small: int = SMALL) -> DataFrame:
    """(id, features): degree, clustering coefficient, betweenness, eigenvector centrality, z-scored by column.

    Beyond `small` vertices the degree stands in for the betweenness, whose work grows with n * m.
    """
    deg = _simple(g).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("k"))
    j = g.vertices.select("id").join(deg, "id", "left").join(clustering_coefficients(g).select("id", "coefficient"), "id").join(eigenvector_centrality(g), "id")
    j = j.select("id", F.coalesce("k", F.lit(0.0)).alias("k"), "coefficient", "score")
    between = betweenness(g).select("id", F.col("score").alias("between")) if g.vertices.count() <= small else j.select("id", F.col("k").alias("between"))
    raw = materialize(j.join(between, "id"), "features")
    cols = ["k", "coefficient", "between", "score"]
    s = raw.agg(*(F.avg(c).alias(f"m_{c}") for c in set(cols)), *(F.stddev_pop(c).alias(f"s_{c}") for c in set(cols))).first()
    return raw.select("id", F.array(*((F.col(c) - (s[f"m_{c}"] or 0.0)) / ((s[f"s_{c}"] or 0.0) + 1e-8) for c in cols)).alias("features"))
