"""Long matrices (i, j, v): an absent cell is the semiring's zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.functions.scalar import safe_div
from netframe.plans.storage import materialize

from .graph import PropertyGraph

#: Largest matrix whose eigensystem one task computes.
DENSE_LIMIT = 4096
#: An eigenvector's largest coordinate, to so many digits and of the lowest id, is positive.
LEAD_DIGITS = 4


def identity(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.select("i", "j", (F.col("v") * by).alias("v"))


def add(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def matmul(a: DataFrame, b: DataFrame, times=lambda x, y: x * y, plus=F.sum) -> DataFrame:
    """Product over a semiring: plus over k of times(a_ik, b_kj)."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(plus(times(F.col("x"), F.col("y"))).alias("v"))


#: Rows and columns of a block.
BLOCK = 256
#: Sums of one cell in a row join cost about as much as this many in a block product.
ROW_COST = 64
#: Sums up to which a row join costs less than starting the tasks of a block product.
FEW_SUMS = 5_000_000


def min_plus(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """C_ij = min over k of A_ik + B_kj; an absent cell is infinite.

    Sparse factors are joined row by row, dense ones multiplied block by block; the number of sums that
    a join would make decides, and both ways give the same.
    """
    ks = a.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("x")).join(b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("y")), "k")
    sums = ks.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("sums"), F.count(F.lit(1)).alias("k")).first()
    made = sums["sums"] or 0.0
    if made <= FEW_SUMS:
        return matmul(a, b, lambda x, y: x + y, F.min)
    n = a.select("i").distinct().count(), sums["k"], b.select("j").distinct().count()
    if made * ROW_COST <= float(n[0]) * n[1] * n[2]:
        return matmul(a, b, lambda x, y: x + y, F.min)
    return blocked_min_plus(a, b, max(n), block)


def blocked_min_plus(a: DataFrame, b: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """min_plus of tables over about n ids: a task for each block of the result, which meets a row and a column of blocks.

    Each factor's cells are sent n / block times; no cell of the product is made twice.
    """
    parts = max(1, -(-n // block))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = a.select(part("i").alias("bi"), part("j").alias("bk"), "i", F.col("j").alias("k"), "v").groupBy("bi", "bk").agg(F.collect_list(F.struct("i", "k", "v")).alias("cells"))
    right = b.select(part("i").alias("bk"), part("j").alias("bj"), F.col("i").alias("k"), "j", "v").groupBy("bk", "bj").agg(F.collect_list(F.struct("k", "j", "v")).alias("cells"))

    def cells(column: pa.ChunkedArray) -> list[tuple[np.ndarray, ...]]:
        lists = column.combine_chunks()
        out = []
        for x in range(len(lists)):
            s = lists[x].values
            out.append(tuple(s.field(f).to_numpy(zero_copy_only=False) for f in range(3)))
        return out

    def product(rows: pa.Table, cols: pa.Table) -> pa.Table:
        have = dict(zip(cols.column("bk").to_pylist(), cells(cols.column("cells")))) if cols.num_rows else {}
        pairs = [(x, have[k]) for k, x in zip(rows.column("bk").to_pylist(), cells(rows.column("cells"))) if k in have] if rows.num_rows else []
        if not pairs:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
        ids_i, ids_j = np.unique(np.concatenate([x[0] for x, _ in pairs])), np.unique(np.concatenate([y[1] for _, y in pairs]))
        best = np.full((len(ids_i), len(ids_j)), np.inf)
        for (i, k, v), (k2, j, v2) in pairs:
            ks = np.intersect1d(k, k2)
            if not len(ks):
                continue
            x, y = np.full((len(ids_i), len(ks)), np.inf), np.full((len(ks), len(ids_j)), np.inf)
            for out, at, on, row, col, value in ((x, k, ks, ids_i, i, v), (y, k2, ks, ids_j, j, v2)):
                own = np.isin(at, on)
                p, q = np.searchsorted(on, at[own]), np.searchsorted(row, col[own])
                np.minimum.at(out, (q, p) if out is x else (p, q), value[own])
            for p in range(len(ks)):
                np.minimum(best, x[:, p, None] + y[p], out=best)
        p, q = np.nonzero(np.isfinite(best))
        return pa.table({"i": ids_i[p], "j": ids_j[q], "v": best[p, q]})

    spread = left.withColumn("bj", each).groupBy("bi", "bj").cogroup(right.withColumn("bi", each).groupBy("bi", "bj"))
    return spread.applyInArrow(product, "i long, j long, v double")


def densify(m: DataFrame, vertices: DataFrame, fill: float = 0.0) -> DataFrame:
    """All cells over vertices: the result has n * n rows by its nature."""
    ids = vertices.select("id")
    cells = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j")))
    return cells.join(m, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(fill)).alias("v"))


def in_degrees(g: PropertyGraph) -> DataFrame:
    """(id, degree): edges that come in, unweighted."""
    n = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return g.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def node_degrees(g: PropertyGraph) -> DataFrame:
    """(id, degree): edges that come in plus edges that go out."""
    n = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return g.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_matrix(g: PropertyGraph) -> DataFrame:
    return in_degrees(g).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("degree").cast("double").alias("v"))


def row_sums(m: DataFrame, vertices: DataFrame) -> DataFrame:
    s = m.groupBy(F.col("i").alias("id")).agg(F.sum("v").alias("d"))
    return vertices.select("id").join(s, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))


def laplacian(g: PropertyGraph) -> DataFrame:
    """diag(row sums) - A, weighted."""
    a = g.adjacency()
    return add(row_sums(a, g.vertices).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("v")), scale(a, -1.0))


def normalized_laplacian(g: PropertyGraph, add_self_loops: bool = True, use_weights: bool = False) -> DataFrame:
    """I - D^-1/2 A' D^-1/2 with the degrees of A, and A' = A + I with self-loops; 1/sqrt(0) is 0."""
    a = g.adjacency() if use_weights else g.unweighted_adjacency()
    d = row_sums(a, g.vertices).select("id", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("h"))
    loops = add(a, identity(g.vertices)) if add_self_loops else a
    scaled = (
        loops.join(d.select(F.col("id").alias("i"), F.col("h").alias("hi")), "i")
        .join(d.select(F.col("id").alias("j"), F.col("h").alias("hj")), "j")
        .select("i", "j", (-F.col("hi") * F.col("v") * F.col("hj")).alias("v"))
    )
    return add(identity(g.vertices), scaled)


def random_walk_laplacian(g: PropertyGraph, add_self_loops: bool = True) -> DataFrame:
    """I - D^-1 A, weighted; self-loops come before the degrees."""
    a = add(g.adjacency(), identity(g.vertices)) if add_self_loops else g.adjacency()
    return random_walk_of(a, g.vertices)


def random_walk_of(a: DataFrame, vertices: DataFrame) -> DataFrame:
    d = row_sums(a, vertices).select(F.col("id").alias("i"), "d")
    return add(identity(vertices), a.join(d, "i").select("i", "j", (-safe_div(F.col("v"), F.col("d"))).alias("v")))


def eigensystem(m: DataFrame, vertices: DataFrame, k: int, dense_limit: int = DENSE_LIMIT, shift: float = 2.0, rounds: int = 200) -> tuple[list[float], DataFrame]:
    """The k smallest eigenpairs of a symmetric matrix: (values, (id, features array)); either way with the same signs.

    Up to dense_limit rows (a checked size) one task solves it; beyond, orthogonal iteration on
    shift * I - M runs distributed and only k * k numbers reach the driver.  shift must be at
    least the largest eigenvalue (2 for a normalised Laplacian).
    """
    n = vertices.count()
    if n <= dense_limit:
        ids = [r["id"] for r in vertices.select("id").orderBy("id").toLocalIterator()]
        at = {x: p for p, x in enumerate(ids)}

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            a = np.zeros((len(ids), len(ids)))
            np.add.at(a, (pdf["i"].map(at).to_numpy(int), pdf["j"].map(at).to_numpy(int)), pdf["v"].to_numpy())
            values, vectors = np.linalg.eigh((a + a.T) / 2)
            lead = np.argmax(np.round(np.abs(vectors), LEAD_DIGITS), axis=0)
            vectors = vectors * np.sign(vectors[lead, np.arange(len(ids))])
            return pd.DataFrame({"id": ids, "features": list(vectors[:, :k]), "values": [values[:k]] * len(ids)})

        # a row for each vertex, so that an all-zero matrix has its group too
        full = m.unionByName(vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")))
        out = materialize(full.withColumn("nf_all", F.lit(0)).groupBy("nf_all").applyInPandas(solve, "id long, features array<double>, values array<double>"), "eigen")
        first = out.select("values").first()
        return (list(first[0]) if first else []), out.select("id", "features")
    return orthogonal_iteration(m, vertices, k, shift, rounds)


def _gram(x: DataFrame, y: DataFrame, k: int) -> np.ndarray:
    cells = [F.sum(F.col("a")[p] * F.col("b")[q]).alias(f"c{p}_{q}") for p in range(k) for q in range(k)]
    row = x.select("id", F.col("features").alias("a")).join(y.select("id", F.col("features").alias("b")), "id").agg(*cells).first()
    return np.array([[row[f"c{p}_{q}"] for q in range(k)] for p in range(k)], float)


def _turn(x: DataFrame, r: np.ndarray) -> DataFrame:
    cols = [sum((F.col("features")[p] * float(r[p, q]) for p in range(r.shape[0])), F.lit(0.0)) for q in range(r.shape[1])]
    return x.select("id", F.array(*cols).alias("features"))


def apply_matrix(m: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """M times the columns of x (id, features)."""
    terms = m.join(x.select(F.col("id").alias("j"), "features"), "j")
    sums = terms.groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("v") * F.col("features")[p]).alias(f"s{p}") for p in range(k)))
    return x.select("id").join(sums, "id", "left").select("id", F.array(*(F.coalesce(f"s{p}", F.lit(0.0)) for p in range(k))).alias("features"))


def orthogonal_iteration(m: DataFrame, vertices: DataFrame, k: int, shift: float = 2.0, rounds: int = 200, tol: float = 1e-10) -> tuple[list[float], DataFrame]:
    w = min(k + min(4, k), vertices.count())
    k = min(k, w)
    unit = lambda p: F.xxhash64("id", F.lit(p)).cast("double") / float(1 << 63)
    x = materialize(vertices.select("id", F.array(*(unit(p) for p in range(w))).alias("features")), "eigen")
    m = materialize(m, "eigen")
    shift *= 1.05  # where the largest eigenvalue is the shift itself, its vector must not vanish
    last = None
    for _ in range(rounds):
        y = apply_matrix(m, x, w)
        moved = x.alias("x").join(y.alias("y"), "id").select("id", F.zip_with("x.features", "y.features", lambda a, b: shift * a - b).alias("features"))
        moved = materialize(moved, "eigen")
        x = materialize(_turn(moved, np.linalg.inv(np.linalg.cholesky(_gram(moved, moved, w))).T), "eigen")
        values, turn = np.linalg.eigh(_gram(x, apply_matrix(m, x, w), w))
        if last is not None and np.abs(values[:k] - last).max() < tol:
            break
        last = values[:k]
    out = materialize(_turn(x, turn[:, :k]), "eigen")
    lead = out.agg(*(F.max_by(F.signum(F.col("features")[p]), F.struct(F.round(F.abs(F.col("features")[p]), LEAD_DIGITS), -F.col("id"))).alias(f"s{p}") for p in range(k))).first()
    signs = F.array(*(F.lit(float(lead[f"s{p}"] or 1.0)) for p in range(k)))
    return list(values[:k]), out.select("id", F.zip_with("features", signs, lambda a, b: a * b).alias("features"))
