"""Pairwise kernels, nearest-neighbour graphs and spectral clustering.

All-pairs tables have n * n rows by their nature.  They are computed in blocks: points are packed
into blocks of BLOCK rows at most, blocks are paired, and each pair of blocks is one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.functions.scalar import normalize, sum_array
from netframe.plans.indexing import with_dense_index
from netframe.plans.storage import materialize

from .kmeans import kmeans
from .matrix import add, eigensystem, identity, random_walk_of, row_sums, scale, transpose

BLOCK = 512
STRETCH = 32
LATE = 1 << 20
GROUP = 8


def _blocks(points: DataFrame, block: int) -> DataFrame:
    """(block, ids, kind, rows): stretches of at most block points, made where the points lie.

    rows: the features one after the other as floats if these hold them exactly, else as doubles; kind says which.
    block tells stretches apart; once written, neighbours of a part differ by one.  Points are dealt anew only where they lie in fewer parts than cores could work on.
    """
    n, parts = points.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), F.countDistinct("p")).first()
    n_blocks = max(1, -(-n // block))
    least = min(n_blocks, points.sparkSession.sparkContext.defaultParallelism)
    p = points.select("id", F.col("features").cast("array<double>").alias("features"))

    def packed(t: pa.Table, place: int) -> pa.RecordBatch:
        ids, features = t["id"].to_numpy(), [c for c in t["features"].chunks if len(c)]
        if t["id"].null_count or t["features"].null_count:
            raise ValueError("a point without an id or features")
        if len({n for c in features for n in c.value_lengths().unique().to_pylist()}) > 1:
            raise ValueError("features of different lengths")
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in features])
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        kind = "f4" if np.array_equal(short, x, equal_nan=True) else "f8"
        return pa.RecordBatch.from_pydict({"block": [place], "ids": [ids], "kind": [kind], "rows": [(short if kind == "f4" else x).tobytes()]})

    def run(batches):
        rest, place = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            while rest.num_rows >= block:
                yield packed(rest.slice(0, block), place)
                rest, place = rest.slice(block), place + 1
        if rest is not None and rest.num_rows:
            yield packed(rest, place)

    return (p.repartition(least) if parts < least else p.coalesce(n_blocks)).mapInArrow(run, "block long, ids array<long>, kind string, rows binary")


def _rows(ids: np.ndarray, kind: str, rows: bytes) -> np.ndarray:
    return np.frombuffer(rows, kind).astype(np.float64).reshape(len(ids), -1)


def _block_pairs(points: DataFrame, block: int, once: bool = False) -> DataFrame:
    """Every block against every block: what all-pairs tables are asked for.

    once: two blocks meet in one order only, which one changes from block to block, so that tasks get equal shares.
    """
    b = materialize(_blocks(points, block), "blocks")
    pairs = b.crossJoin(b.select(*(F.col(c).alias(f"{c}2") for c in b.columns)))
    if not once:
        return pairs
    up, even = F.col("block") < F.col("block2"), (F.col("block") + F.col("block2")) % 2 == 0
    return pairs.where((F.col("block") == F.col("block2")) | (up == even))


def _unpacked(parts):
    """(ids, rows, ids2, rows2) of each pair of blocks."""
    for pdf in parts:
        for ids, kind, rows, ids2, kind2, rows2 in zip(*(pdf[c] for c in ("ids", "kind", "rows", "ids2", "kind2", "rows2"))):
            ids, ids2 = np.asarray(ids), np.asarray(ids2)
            yield ids, _rows(ids, kind, rows), ids2, _rows(ids2, kind2, rows2)


def pairwise(points: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(i, j, v): f(X, Y) gives the cells of a block of rows X against a block of rows Y."""

    def run(parts):
        for ids, rows, ids2, rows2 in _unpacked(parts):
            yield pd.DataFrame({"i": np.repeat(ids, len(ids2)), "j": np.tile(ids2, len(ids)), "v": f(rows, rows2).ravel()})

    return _block_pairs(points, block).mapInPandas(run, "i long, j long, v double")


def symmetric_pairwise(points: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = BLOCK, span: float | None = None) -> DataFrame:
    """pairwise for f(X, Y) = f(Y, X)': a cell is computed once for both its places.

    Each stretch of STRETCH cells is followed by the same cells at their other places.  So near, a
    writer's compression finds them equal, and the table takes little more than half the disk.
    span: cells further than half of it from the median of a task's first ones come after the others, LATE at a time.
    A writer's dictionary, which ends at some number of different values, then lasts for nearly all.
    GROUP neighbours go together, so that packed numbers of the ids keep their places in bytes and stay equal from row to row.
    """

    def frame(i: np.ndarray, j: np.ndarray, v: np.ndarray, width: int) -> pd.DataFrame:
        i, j, v = (x.reshape(-1, width) for x in (i, j, v))
        return pd.DataFrame({name: np.concatenate(x, axis=1).ravel() for name, x in (("i", (i, j)), ("j", (j, i)), ("v", (v, v)))})

    def stretches(cells: list[np.ndarray]):
        for k in range(0, len(cells[0]), STRETCH * BLOCK):
            part = [x[k : k + STRETCH * BLOCK] for x in cells]
            whole = len(part[0]) // STRETCH * STRETCH
            if whole:
                yield frame(*(x[:whole] for x in part), STRETCH)
            if whole < len(part[0]):
                yield frame(*(x[whole:] for x in part), len(part[0]) - whole)

    def run(parts):
        middle, rest, late, n_late = None, None, [], 0
        for pdf in parts:
            for same, (ids, rows, ids2, rows2) in zip(pdf["block"] == pdf["block2"], _unpacked([pdf])):
                cells = f(rows, rows2)
                own = np.triu(np.ones(cells.shape, bool), 1) if same else np.ones(cells.shape, bool)
                if same:
                    if not np.array_equal(ids, ids2):
                        raise ValueError("two blocks of one number")
                    yield pd.DataFrame({"i": ids, "j": ids, "v": cells.diagonal()})
                if span is not None:
                    middle = np.median(cells) if middle is None else middle
                    far = np.logical_or.reduceat(np.abs(cells - middle) > span / 2, range(0, len(ids2), GROUP), axis=1).repeat(GROUP, axis=1)[:, : len(ids2)]
                    far, own = own & far, own & ~far
                    a, b = np.nonzero(far)
                    late.append((ids[a], ids2[b], cells[far]))
                    n_late += len(a)
                a, b = np.nonzero(own)
                new = (ids[a], ids2[b], cells[own])
                rest = [np.concatenate(x) for x in zip(rest, new)] if rest else list(new)
                whole = len(rest[0]) // STRETCH * STRETCH
                yield from stretches([x[:whole] for x in rest])
                rest = [x[whole:] for x in rest]
                if n_late >= LATE:
                    yield from stretches([np.concatenate(x) for x in zip(*late)])
                    late, n_late = [], 0
        if rest:
            yield from stretches(rest)
        if late:
            yield from stretches([np.concatenate(x) for x in zip(*late)])

    return _block_pairs(points, block, once=True).mapInPandas(run, "i long, j long, v double")


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2) if x.shape[1] * len(x) * len(y) <= 1 << 22 else np.stack([((x - r) ** 2).sum(axis=1) for r in y], axis=1)


def distance_sums(points: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, cj, total, n): for each point and block, the Euclidean distances to the block's points of each cluster added up."""
    kind = labels.schema["cluster"].dataType.simpleString()
    marked = points.select("id", "features").join(labels.select("id", "cluster"), "id")
    n = max(1, -(-marked.count() // block))
    lists = (F.collect_list(c).alias(name) for c, name in (("id", "ids"), (F.col("features").cast("array<double>"), "rows"), ("cluster", "clusters")))
    b = materialize(marked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part")).agg(*lists), "blocks")
    pairs = b.select("ids", "rows").crossJoin(b.select(F.col("rows").alias("rows2"), "clusters"))

    def run(parts):
        for pdf in parts:
            for ids, rows, rows2, clusters in zip(pdf["ids"], pdf["rows"], pdf["rows2"], pdf["clusters"]):
                names, code = np.unique(np.asarray(clusters), return_inverse=True)
                member = np.zeros((len(code), len(names)))
                member[np.arange(len(code)), code] = 1.0
                total = np.sqrt(_sq(np.stack(list(rows)), np.stack(list(rows2)))) @ member
                yield pd.DataFrame({"i": np.repeat(np.asarray(ids), len(names)), "cj": np.tile(names, len(ids)), "total": total.ravel(), "n": np.tile(member.sum(axis=0).astype(np.int64), len(ids))})

    return pairs.mapInPandas(run, f"i long, cj {kind}, total double, n long")


def euclidean_distances(points: DataFrame) -> DataFrame:
    return symmetric_pairwise(points, lambda x, y: np.sqrt(_sq(x, y)))


def cosine_similarities(points: DataFrame) -> DataFrame:
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    return symmetric_pairwise(points, lambda x, y: unit(x) @ unit(y).T)


def rbf_kernel(points: DataFrame, gamma: float = 1.0, span: float | None = None) -> DataFrame:
    return symmetric_pairwise(points, lambda x, y: np.exp(-gamma * _sq(x, y)), span=span)


def knn_graph(points: DataFrame, n_neighbors: int = 10, include_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(i, j, v=1): each point's nearest ones, made symmetric.

    include_self: n_neighbors others and the point itself; otherwise n_neighbors slots of which
    the point takes one, which is then left out.  Each pair of blocks hands on its nearest ones only.
    """
    k = n_neighbors + 1 if include_self else n_neighbors

    def run(parts):
        for ids, rows, ids2, rows2 in _unpacked(parts):
            d = np.round(_sq(rows, rows2), 12)
            own = np.lexsort((np.broadcast_to(ids2, d.shape), d), axis=1)[:, :k]
            yield pd.DataFrame({"i": np.repeat(ids, own.shape[1]), "j": ids2[own].ravel(), "v": np.take_along_axis(d, own, 1).ravel()})

    near = _block_pairs(points, block).mapInPandas(run, "i long, j long, v double")
    w = Window.partitionBy("i").orderBy("v", "j")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    if not include_self:
        best = best.where("i <> j")
    one = best.select("i", "j")
    return one.unionByName(transpose(one.withColumn("v", F.lit(1.0))).select("i", "j")).distinct().select("i", "j", F.lit(1.0).alias("v"))


def path_similarity(d: DataFrame, sigma: float = 1.0) -> DataFrame:
    """exp(-D^2 / (2 sigma^2)), 1 on the diagonal; absent pairs are infinitely far and stay absent (0)."""
    return d.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).when(F.col("v") == float("inf"), 0.0).otherwise(F.exp(-F.col("v") * F.col("v") / (2 * sigma * sigma))).alias("v"))


def normalize_path_lengths(d: DataFrame, vertices: DataFrame, method: str = "min_max") -> DataFrame:
    """All cells: finite ones scaled by min_max, z_score or robust; pairs out of reach get the far end.

    min_max: out of reach 1, all 0 if the finite ones are equal.  z_score: the largest absolute score.
    robust: (x - median) / (1.4826 MAD) cut at +-10, out of reach 10.
    """
    ids = vertices.select("id")
    cells = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j"))).join(d.where(F.col("v") < float("inf")), ["i", "j"], "left")
    if method == "min_max":
        s = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        x = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        far = F.when(F.col("hi").isNull(), 0.0).otherwise(1.0)
    elif method == "z_score":
        s = d.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        z = lambda c: F.when(F.col("sd") > 0, (c - F.col("m")) / F.col("sd")).otherwise(0.0)
        x, far = z(F.col("v")), F.coalesce(F.greatest(F.abs(z(F.col("lo"))), F.abs(z(F.col("hi")))), F.lit(0.0))
    elif method == "robust":
        m = median(d, "v", ["i", "j"])
        mad = median(d.select("i", "j", F.abs(F.col("v") - F.lit(m)).alias("v")), "v", ["i", "j"])
        s = d.sparkSession.createDataFrame([(m, mad)], "m double, mad double")
        x = F.when(F.col("mad") > 0, F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("v") - F.col("m")) / (1.4826 * F.col("mad"))))).otherwise(0.0)
        far = F.when(F.col("m").isNull(), 0.0).otherwise(10.0)
    else:
        raise ValueError(method)
    return cells.crossJoin(F.broadcast(s)).select("i", "j", F.when(F.col("v").isNull(), far).otherwise(x).alias("v"))


def median(d: DataFrame, column: str, key: list[str]) -> float | None:
    """The exact median of a column; rows are numbered by range, so that no task sees them all.  key tells equal values apart."""
    d = d.where(F.col(column).isNotNull())
    placed = with_dense_index(d.select(column, *key), [column, *key], "nf_place")
    n = placed.count()
    return placed.where(F.col("nf_place").isin((n - 1) // 2, n // 2)).agg(F.avg(column)).first()[0] if n else None


def symmetric_affinity(m: DataFrame) -> DataFrame:
    """(A + A') / 2, never below 0."""
    return scale(add(m, transpose(m)), 0.5).select("i", "j", F.greatest("v", F.lit(0.0)).alias("v"))


def affinity_laplacian(a: DataFrame, vertices: DataFrame, normalized: bool = True) -> DataFrame:
    """Laplacian of an affinity without its diagonal; a degree of 0 counts as 1 where it divides."""
    off = a.where("i <> j")
    d = row_sums(off, vertices)
    if not normalized:
        return add(d.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("v")), scale(off, -1.0))
    h = d.select("id", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(1.0).alias("h"))
    s = off.join(h.select(F.col("id").alias("i"), F.col("h").alias("hi")), "i").join(h.select(F.col("id").alias("j"), F.col("h").alias("hj")), "j")
    return add(identity(vertices), s.select("i", "j", (-F.col("hi") * F.col("v") * F.col("hj")).alias("v")))


def random_walk_affinity(a: DataFrame, vertices: DataFrame) -> DataFrame:
    return random_walk_of(a, vertices)


def spectral_embedding(affinity: DataFrame, vertices: DataFrame, k: int, normalized: bool = True, drop_first: bool = False, recover: str | None = None) -> tuple[list[float], DataFrame]:
    """(eigenvalues, (id, features)): the k smallest eigenvectors of the affinity's Laplacian.

    drop_first leaves out the trivial one.  recover scales rows: "divide" by the square root of the degree
    (eigenvectors of the random walk), "multiply" by it.
    """
    a = materialize(affinity, "affinity")
    lap = affinity_laplacian(a, vertices, normalized)
    top = 2.0 if normalized else 2.0 * (row_sums(a.where("i <> j"), vertices).agg(F.max("d")).first()[0] or 1.0)
    values, x = eigensystem(lap, vertices, k + int(drop_first), shift=top)
    if drop_first:
        values, x = values[1:], x.select("id", F.slice("features", 2, k).alias("features"))
    if recover and normalized:
        d = row_sums(a.where("i <> j"), vertices).select("id", F.sqrt(F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).alias("h"))
        by = (lambda c: c * F.col("h")) if recover == "multiply" else (lambda c: c / F.col("h"))
        x = x.join(d, "id").select("id", F.transform("features", by).alias("features"))
    return values, x


def normalize_embedding(x: DataFrame) -> DataFrame:
    return x.select("id", normalize(F.col("features")).alias("features"))


def spectral_clustering(affinity: DataFrame, vertices: DataFrame, k: int = 2, normalized: bool = True, assign: str = "kmeans", seed: int = 42, n_init: int = 10, recover: str | None = "multiply") -> tuple[DataFrame, list[float]]:
    """((id, cluster), eigenvalues): k-means (or the largest coordinate) on the spectral embedding."""
    n = vertices.count()
    if k > n:
        raise ValueError("more clusters than rows")
    a = symmetric_affinity(affinity)
    values, x = spectral_embedding(a, vertices, k, normalized, recover=recover)
    x = materialize(x, "embedding")
    if assign == "kmeans":
        return kmeans(x, k, n_init=n_init, seed=seed), values
    return x.select("id", (F.array_position("features", F.array_max("features")) - 1).cast("int").alias("cluster")), values


def path_based_similarity(g, normalization: str = "min_max", sigma: float = 1.0) -> DataFrame:
    """Shortest paths -> normalised lengths -> similarities."""
    from .paths import floyd_warshall

    return path_similarity(normalize_path_lengths(floyd_warshall(g), g.vertices, normalization), sigma)


def z_scored(points: DataFrame) -> DataFrame:
    """Columns of the features as (x - mean) / (population deviation + 1e-8)."""
    long = points.select("id", F.posexplode("features").alias("f", "x"))
    s = long.groupBy("f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    j = long.join(F.broadcast(s), "f")  # one row for each feature
    return j.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", ((F.col("x") - F.col("m")) / (F.col("sd") + 1e-8)).alias("z")))), lambda c: c["z"]).alias("features"))


def length(a: Column) -> Column:
    return F.sqrt(sum_array(F.transform(a, lambda x: x * x)))
