"""Fuzzy c-means and its graph-aware form: memberships (id, u array<double>) of k clusters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netframe.functions.scalar import let, shares, sqdist, sum_array
from netframe.plans.storage import materialize

from .kmeans import Centres, table_of


class SoftState(NamedTuple):
    labels: DataFrame
    membership: DataFrame
    centroids: Centres
    loss_history: list[float]
    final_loss: float
    iterations: int


def _lit(centre: list[float]) -> Column:
    return table_of([centre])[0]


def memberships(points: DataFrame, centres: Centres, temperature: float = 2.0, floor: float = 1e-10) -> DataFrame:
    """(id, u): u_i in proportion to d_i ** (-2 / (m - 1)), summing to 1; distances have a floor."""
    return points.select("id", _membership(centres, temperature, floor).alias("u"))


def _membership(centres: Centres, temperature: float, floor: float = 1e-10) -> Column:
    """Of the column features."""
    power = F.lit(-2.0 / (temperature - 1.0))
    d = F.transform(table_of(centres), lambda c: F.greatest(F.sqrt(sqdist(F.col("features"), c)), F.lit(floor)))
    # scaled by the least distance, so that powers stay finite
    return let(d, lambda own: let(F.array_min(own), lambda least: shares(F.transform(own, lambda x: F.pow(x / least, power)))))


def _width(points: DataFrame) -> int:
    first = points.select(F.size("features").alias("d")).first()
    return first["d"] if first else 0


def _sums(k: int, d: int) -> list[Column]:
    """Aggregates of the columns w (weights by cluster) and features: w<c> and s<c>_<p>."""
    w = F.col("w")
    return [*(F.sum(w[c]).alias(f"w{c}") for c in range(k)), *(F.sum(w[c] * F.col("features")[p]).alias(f"s{c}_{p}") for c in range(k) for p in range(d))]


def _centres(row, k: int, d: int) -> Centres:
    return [[(row[f"s{c}_{p}"] or 0.0) / max(row[f"w{c}"] or 0.0, 1e-10) for p in range(d)] for c in range(k)]


def weighted_centres(points: DataFrame, u: DataFrame, temperature: float, k: int, d: int | None = None) -> Centres:
    """Means weighted by u ** m: one aggregate with k * (d + 1) sums."""
    d = _width(points) if d is None else d
    j = points.join(u, "id").select("features", F.transform("u", lambda x: F.pow(x, F.lit(temperature))).alias("w"))
    return _centres(j.agg(*_sums(k, d)).first(), k, d)


def smooth(u: DataFrame, adjacency: DataFrame, graph_weight: float = 0.1) -> DataFrame:
    """(id, u): (1 - g) u + g (A u) / max(row sum of A, 1e-10), summing to 1 again."""
    k = F.size("u")
    n = adjacency.join(u.select(F.col("id").alias("j"), "u"), "j")
    width = u.select(k.alias("k")).first()
    cols = range(width["k"] if width else 0)
    sums = n.groupBy(F.col("i").alias("id")).agg(F.sum("v").alias("deg"), *(F.sum(F.col("v") * F.col("u")[c]).alias(f"s{c}") for c in cols))
    j = u.join(sums, "id", "left")
    near = F.array(*(F.coalesce(f"s{c}", F.lit(0.0)) / F.greatest(F.coalesce("deg", F.lit(0.0)), F.lit(1e-10)) for c in cols))
    mixed = j.select("id", F.zip_with("u", near, lambda a, b: (1 - graph_weight) * a + graph_weight * b).alias("r"))
    return mixed.select("id", shares(F.col("r")).alias("u"))


def hard_assignments(u: DataFrame) -> DataFrame:
    """(id, cluster): the largest membership, the lowest cluster of equals."""
    return u.select("id", (F.array_position("u", F.array_max("u")) - 1).cast("int").alias("cluster"))


def fcm_loss(points: DataFrame, u: DataFrame, centres: Centres, temperature: float = 2.0) -> DataFrame:
    """One row, loss: sum of u ** m times squared distance."""
    terms = sum((F.pow(F.col("u")[c], F.lit(temperature)) * sqdist(F.col("features"), _lit(x)) for c, x in enumerate(centres)), F.lit(0.0))
    return points.join(u, "id").agg(F.sum(terms).alias("loss"))


def graph_loss(points: DataFrame, u: DataFrame, centres: Centres, adjacency: DataFrame, temperature: float = 2.0) -> DataFrame:
    """One row, loss: fuzzy loss + 0.1 * mean A_ij |u_i - u_j|^2 - 0.05 * mean (U'AU - s's / sum A)."""
    k = len(centres)
    n = F.lit(points.count())
    e = adjacency.join(u.select(F.col("id").alias("i"), F.col("u").alias("a")), "i").join(u.select(F.col("id").alias("j"), F.col("u").alias("b")), "j")
    edge = e.agg(F.sum(F.col("v") * sqdist(F.col("a"), F.col("b"))).alias("rough"), F.sum(F.col("v") * sum_array(F.col("a")) * sum_array(F.col("b"))).alias("within"), F.sum("v").alias("total"))
    size = u.agg(F.sum(sum_array(F.col("u"))).alias("s"))
    base = fcm_loss(points, u, centres, temperature)
    total = F.coalesce("total", F.lit(0.0))
    j = base.crossJoin(edge).crossJoin(size)  # one row each
    modular = (F.coalesce("within", F.lit(0.0)) - F.coalesce(F.try_divide(F.col("s") * F.col("s"), total), F.lit(0.0))) / (k * k)
    return j.select((F.col("loss") + 0.1 * F.coalesce("rough", F.lit(0.0)) / (n * n) - 0.05 * modular).alias("loss"))


def start_memberships(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, u): random rows by hash, summing to 1."""
    raw = F.array(*((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(c)), F.lit(1 << 40)) + 1) / float(1 << 40) for c in range(k)))
    return points.select("id", shares(raw).alias("u"))


def update_step(points: DataFrame, u: DataFrame, k: int, temperature: float = 2.0, adjacency: DataFrame | None = None, graph_weight: float = 0.1) -> tuple[DataFrame, Centres]:
    """One iteration: centres from memberships, memberships from centres."""
    c = weighted_centres(points, u, temperature, k)
    new = memberships(points, c, temperature)
    return (new if adjacency is None else smooth(new, adjacency, graph_weight)), c


def soft_clustering(points: DataFrame, k: int, temperature: float = 2.0, max_iter: int = 300, tol: float = 1e-4, seed: int = 42, init: DataFrame | None = None, adjacency: DataFrame | None = None, graph_weight: float = 0.1) -> SoftState:
    """Fuzzy c-means until no membership changes by more than tol; with adjacency (i, j, v) the graph-aware form.

    Without a graph memberships follow from the centres, so a round is one aggregate over the points: loss,
    change, and the sums of the next centres.  With one they are written every round.
    """
    if temperature <= 1:
        raise ValueError("temperature must be above 1")
    if k <= 0 or k > points.count():
        raise ValueError("k must be between 1 and the number of points")
    p = materialize(points.select("id", F.col("features").cast("array<double>").alias("features")), "points")
    adj = None if adjacency is None else materialize(adjacency, "adjacency")
    u = materialize(init if init is not None else start_memberships(p, k, seed), "membership")
    if adj is None:
        return _plain(p, u, k, temperature, max_iter, tol)
    losses, c, made = [], [], 0
    for _ in range(max_iter):
        new, c = update_step(p, u, k, temperature, adj, graph_weight)
        new = materialize(new, "membership")
        made += 1
        loss = graph_loss(p, new, c, adj, temperature)
        losses.append(float(loss.first()[0]))
        change = new.select("id", F.col("u").alias("a")).join(u.select("id", F.col("u").alias("b")), "id").agg(F.max(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))))).first()[0]
        u = new
        if change <= tol:
            break
    return SoftState(hard_assignments(u), u, c, losses, losses[-1] if losses else float("nan"), made)


def _plain(p: DataFrame, u: DataFrame, k: int, temperature: float, max_iter: int, tol: float) -> SoftState:
    d = _width(p)
    c, before, losses = weighted_centres(p, u, temperature, k, d), None, []
    now = p
    for made in range(1, max_iter + 1):
        # the first round compares with the memberships given, later ones with what the last centres give
        old = F.col("u0") if before is None else _membership(before, temperature)
        now = p.join(u.select("id", F.col("u").alias("u0")), "id") if before is None else p
        each = now.select("features", _membership(c, temperature).alias("u"), old.alias("b"))
        each = each.select("features", F.zip_with("u", "b", lambda x, y: F.abs(x - y)).alias("b"), F.transform("u", lambda x: F.pow(x, F.lit(temperature))).alias("w"))
        loss = sum((F.col("w")[x] * sqdist(F.col("features"), _lit(centre)) for x, centre in enumerate(c)), F.lit(0.0))
        row = each.agg(F.sum(loss).alias("loss"), F.max(F.array_max("b")).alias("change"), *_sums(k, d)).first()
        losses.append(float(row["loss"]))
        if row["change"] <= tol or made == max_iter:
            break
        before, c = c, _centres(row, k, d)
    out = materialize(memberships(p, c, temperature), "membership") if losses else u
    return SoftState(hard_assignments(out), out, c, losses, losses[-1] if losses else float("nan"), len(losses))


def adaptive_temperature_schedule(initial: float = 2.0, final: float = 0.1, decay: float = 0.95):
    return lambda iteration: max(initial * decay**iteration, final)


def cluster_quality(u: DataFrame) -> DataFrame:
    """One row: entropy (mean over cells), sparsity (mean square), balance (spread of soft sizes)."""
    cells = u.select("id", F.posexplode("u").alias("c", "x"))
    per = cells.groupBy("c").agg(F.sum("x").alias("size"), F.sum(-F.col("x") * F.log(F.col("x") + 1e-8)).alias("e"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("e") / F.sum("n")).alias("entropy"), (F.sum("q") / F.sum("n")).alias("sparsity"), (F.stddev_pop("size") / (F.avg("size") + 1e-8)).alias("balance"))


def membership_entropy(u: DataFrame) -> DataFrame:
    """One row: mean row entropy and mean largest membership, and the partition coefficient."""
    e = sum_array(F.transform("u", lambda x: -x * F.log(x + 1e-10)))
    return u.agg(F.avg(e).alias("entropy"), F.avg(F.array_max("u")).alias("max_membership"), F.avg(sum_array(F.transform("u", lambda x: x * x))).alias("partition_coefficient"))
