"""Cuts between vertex sets, layered capacity models and their dynamics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.plans.storage import materialize

from .graph import PropertyGraph

PARAMS = ("s12", "s23", "s13", "alpha12", "alpha23", "p", "d")
EPS = 1e-8


def _ends(g: PropertyGraph, masks: DataFrame, cols: list[str], keys: list[str], capacity: Column) -> DataFrame:
    """Edges with the masks of both ends as s_<col> and t_<col>."""
    m = lambda x, end: masks.select(*keys, F.col("id").alias(end), *(F.coalesce(c, F.lit(False)).alias(f"{x}_{c}") for c in cols))
    e = g.edges.select("src", "dst", capacity.cast("double").alias("cap"))
    return e.join(m("s", "src"), "src").join(m("t", "dst"), ["dst", *keys])


def min_cut(g: PropertyGraph, masks: DataFrame, source: str, sink: str, capacity: Column | None = None) -> DataFrame:
    """One row, cut: capacity of the edges that lead from the source set into the sink set."""
    e = _ends(g, masks, [source, sink], [], F.coalesce(F.col("weight"), F.lit(1.0)) if capacity is None else capacity)
    return e.agg(F.coalesce(F.sum(F.when(F.col(f"s_{source}") & F.col(f"t_{sink}"), F.col("cap"))), F.lit(0.0)).alias("cut"))


def max_flow(g: PropertyGraph, masks: DataFrame, source: str, sink: str, capacity: Column | None = None, directed: bool = True, max_rounds: int = 10_000) -> float:
    """The largest flow from the source set to the sink set, which is the capacity of a minimum cut between them.

    Push and relabel with all vertices at once: in a round every vertex with excess pushes it down its admissible
    edges in the order of their ends, and one that has excess left but no such edge is lifted.  Heights start, and are
    set again every REHEIGHT rounds, as distances to the sinks in the residual graph, found by levels; what
    cannot reach a sink any more takes no part.  A round is two joins over the residual edges; nothing is collected
    but counts.  Sets that share a vertex raise ValueError; capacities must not be negative; absent ones are 1.
    """
    w = (F.coalesce(F.col("weight"), F.lit(1.0)) if capacity is None else capacity).cast("double")
    m = masks.select("id", F.coalesce(source, F.lit(False)).alias("s"), F.coalesce(sink, F.lit(False)).alias("t"))
    if not m.where("s and t").isEmpty():
        raise ValueError("a vertex is source and sink")
    if m.where("s").isEmpty() or m.where("t").isEmpty():
        return 0.0
    ends = materialize(m.where("s or t"), "ends")
    e = g.edges.where("src <> dst").select("src", "dst", w.alias("r"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("r") if directed else F.col("r"))
    e = e.unionByName(back).groupBy("src", "dst").agg(F.sum("r").alias("r"))
    sources, sinks = ends.where("s").select("id"), ends.where("t").select("id")
    # edges into sources and out of sinks carry nothing that counts
    e = e.join(sources.withColumnRenamed("id", "dst"), "dst", "left_anti").join(sinks.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "r")
    first = e.join(sources.withColumnRenamed("id", "src"), "src", "left_semi")
    excess = materialize(first.groupBy(F.col("dst").alias("id")).agg(F.sum("r").alias("x")), "excess")
    e = materialize(e.join(sources.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "r"), "residual")

    def heights(e: DataFrame) -> DataFrame:
        level = seen = sinks.select("id", F.lit(0).cast("long").alias("h"))
        open_edges = e.where("r > 1e-12").select("src", F.col("dst").alias("id"))
        k = 0
        while True:
            k += 1
            level = materialize(open_edges.join(level.select("id"), "id").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(k).cast("long").alias("h")), "heights")
            if level.isEmpty():
                return seen
            seen = materialize(seen.unionByName(level), "heights")

    h = None
    for k in range(max_rounds):
        if k % REHEIGHT == 0:
            h = heights(e)
        active = excess.where("x > 1e-12").join(h, "id").join(sinks, "id", "left_anti").select("id", "x", "h")
        active = materialize(active, "active")
        if active.isEmpty():
            if k % REHEIGHT == 0:
                break
            h = heights(e)
            if excess.where("x > 1e-12").join(h, "id").join(sinks, "id", "left_anti").isEmpty():
                break
            continue
        down = e.where("r > 1e-12").join(active.select(F.col("id").alias("src"), "x", "h"), "src").join(h.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst").where("h = hd + 1")
        before = F.coalesce(F.sum("r").over(Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        pushed = materialize(down.withColumn("p", F.least("r", F.col("x") - before)).where("p > 0").select("src", "dst", "p"), "pushed")
        moved = pushed.select("src", "dst", (-F.col("p")).alias("r")).unionByName(pushed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("r")))
        moved = moved.join(sinks.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "r")
        e = materialize(e.unionByName(moved).groupBy("src", "dst").agg(F.sum("r").alias("r")), "residual")
        change = pushed.select(F.col("src").alias("id"), (-F.col("p")).alias("x")).unionByName(pushed.select(F.col("dst").alias("id"), F.col("p").alias("x")))
        excess = materialize(excess.unionByName(change).groupBy("id").agg(F.sum("x").alias("x")), "excess")
        left = active.select("id", "h").join(excess.where("x > 1e-12").select("id"), "id", "left_semi")
        way = e.where("r > 1e-12").join(left.select(F.col("id").alias("src")), "src").join(h.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst")
        lifted = way.groupBy(F.col("src").alias("id")).agg((F.min("hd") + 1).alias("to"))
        h = materialize(h.join(lifted, "id", "left").select("id", F.greatest("h", F.coalesce("to", "h")).alias("h")), "heights")
    else:
        raise RuntimeError("the flow did not settle")
    total = excess.join(sinks, "id").agg(F.sum("x")).first()[0]
    return float(total or 0.0)


#: Rounds of push and relabel between two searches for the heights.
REHEIGHT = 8


def _matrix_cut(a: str, b: str, doubled: bool) -> Column:
    """Aggregate: direct capacity both ways, and through vertices in neither set the smaller of both sides."""
    sa, sb, ta, tb = (F.col(x) for x in (f"s_{a}", f"s_{b}", f"t_{a}", f"t_{b}"))
    s_mid, t_mid = ~sa & ~sb, ~ta & ~tb
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("cap"))), F.lit(0.0))
    direct = total((sa & tb) | (sb & ta))
    indirect = F.least(total((sa & t_mid) | (s_mid & ta)), total((s_mid & tb) | (sb & t_mid)))
    return (direct + indirect) / (2.0 if doubled else 1.0)


def min_cut_matrix(g: PropertyGraph, masks: DataFrame, source: str, sink: str, capacity: Column | None = None, edges_doubled: bool = True) -> DataFrame:
    """One row, cut: a cut estimate (direct + indirect), halved for graphs that hold each edge twice.

    0 if either set is empty.  One pass over the edges, whatever their number.
    """
    e = _ends(g, masks, [source, sink], [], F.coalesce(F.col("weight"), F.lit(1.0)) if capacity is None else capacity)
    any_ = masks.agg(F.coalesce(F.bool_or(source), F.lit(False)).alias("any_a"), F.coalesce(F.bool_or(sink), F.lit(False)).alias("any_b"))
    cut = e.agg(_matrix_cut(source, sink, edges_doubled).alias("c"))
    return cut.crossJoin(any_).select(F.when(F.col("any_a") & F.col("any_b"), F.col("c")).otherwise(0.0).alias("cut"))


def capacity_params(g: PropertyGraph, masks: DataFrame, keys: tuple[str, ...] = (), C1: float = 38.2, C2: float = 31.0, C3: float = 0.035, edge_cap: float = 28.0, capacity: Column | None = None, edges_doubled: bool = True, p: float = 0.42, d: float = 0.79) -> DataFrame:
    """One row for each key: N1, N2, N3, W12, W23, W13, s12, s23, s13, alpha12, alpha23, p, d.

    masks: (keys..., id, ref, term, gas[, alive]).  Every edge has edge_cap unless capacity, an
    expression over the edges, is given.  Many scenarios are many keys in one pass.
    """
    alive = F.coalesce(F.col("alive"), F.lit(True)) if "alive" in masks.columns else F.lit(True)
    ks = list(keys)
    n = masks.groupBy(*ks).agg(*(F.sum((alive & F.coalesce(c, F.lit(False))).cast("double")).alias(f"N{i}") for i, c in ((1, "ref"), (2, "term"), (3, "gas"))))
    e = _ends(g, masks, ["ref", "term", "gas"], ks, F.lit(edge_cap) if capacity is None else capacity)
    w = e.groupBy(*ks).agg(*(_matrix_cut(a, b, edges_doubled).alias(f"w{x}") for x, a, b in (("12", "ref", "term"), ("23", "term", "gas"), ("13", "ref", "gas"))))
    j = n.join(w, ks, "left") if ks else n.crossJoin(w)
    n1, n2, n3 = (F.col(f"N{i}") for i in (1, 2, 3))
    cut = lambda x, a, b: F.when((a > 0) & (b > 0), F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    j = j.select(*ks, n1, n2, n3, cut("w12", n1, n2).alias("W12"), cut("w23", n2, n3).alias("W23"), cut("w13", n1, n3).alias("W13"))
    return j.select(
        "*",
        (F.col("W12") / (n1 * C1 + EPS)).alias("s12"),
        (F.col("W23") / (n2 * C2 + EPS)).alias("s23"),
        (F.col("W13") / (n1 * C1 + EPS)).alias("s13"),
        (n2 * C2 / (n1 * C1 + EPS)).alias("alpha12"),
        (n3 * C3 / (n2 * C2 + EPS)).alias("alpha23"),
        F.lit(p).alias("p"),
        F.lit(d).alias("d"),
    )


def scaled_flows(params: DataFrame, top: float = 0.1) -> DataFrame:
    """params with s12, s23, s13 scaled so that the largest is `top`."""
    most = F.greatest("s12", "s23", "s13")
    out = params.withColumn("nf_most", most)
    for c in ("s12", "s23", "s13"):
        out = out.withColumn(c, F.when(F.col("nf_most") > 0, F.col(c) * top / F.col("nf_most")).otherwise(F.col(c)))
    return out.drop("nf_most")


def max_stable_demand() -> Column:
    a, b = F.col("alpha12"), F.col("alpha23")
    return F.try_divide(F.col("s13") + F.least(F.col("s12"), b * F.col("s23")), a * b)


#: The Tsitouras 5(4) tableau (Tsitouras, 2011), rows a_ij; the last row is also b.
TSIT5 = (
    (0.161,),
    (-0.008480655492356989, 0.335480655492357),
    (2.8971530571054935, -6.359448489975075, 4.3622954328695815),
    (5.325864828439257, -11.748883564062828, 7.4955393428898365, -0.09249506636175525),
    (5.86145544294642, -12.92096931784711, 8.159367898576159, -0.071584973281401, -0.028269050394068383),
    (0.09646076681806523, 0.01, 0.4798896504144996, 1.379008574103742, -3.290069515436081, 2.324710524099774),
)


def field(y: np.ndarray, q: dict[str, np.ndarray], constant: bool) -> np.ndarray:
    """dy/dt of the three layers, for many parameter rows at once."""
    y1, y2, y3 = y
    s12, s23, s13, a12, a23, p, d = (q[k] for k in PARAMS)
    return np.stack([
        (p if constant else p * y1) - s12 * y1 * y2 - s13 * y1 * y3,
        s12 / a12 * y1 * y2 - s23 * y2 * y3,
        -d * y3 + s13 / (a12 * a23) * y1 * y3 + s23 / a23 * y2 * y3,
    ])


def integrate(q: dict[str, np.ndarray], t_max: float = 50.0, dt: float = 0.1, constant: bool = False) -> np.ndarray:
    """y(t_max) from (1, 1, 1) with fixed steps; rows that overflow end as nan."""
    y = np.ones((3, len(q["p"])))
    with np.errstate(all="ignore"):
        for _ in range(round(t_max / dt)):
            k = [field(y, q, constant)]
            for row in TSIT5:
                k.append(field(y + dt * sum(a * s for a, s in zip(row, k)), q, constant))
            y = y + dt * sum(a * s for a, s in zip(TSIT5[-1], k))
    return np.where(np.isfinite(y), y, np.nan)


def steady_state(params: DataFrame, t_max: float = 50.0, dt: float = 0.1, production: str = "proportional") -> DataFrame:
    """params with y1, y2, y3: each row is a scenario; rows are independent and integrated in Arrow batches."""
    if production not in ("proportional", "constant"):
        raise ValueError(production)
    names = params.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema) + ", y1 double, y2 double, y3 double"

    def run(parts):
        for pdf in parts:
            y = integrate({k: pdf[k].to_numpy(float) for k in PARAMS}, t_max, dt, production == "constant")
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(y.T, columns=["y1", "y2", "y3"])], axis=1)

    return params.mapInPandas(run, schema)


def failure_time(params: DataFrame, delta_t: float, branch: bool = True, **solver) -> DataFrame:
    """params with y3, tau and qd: how long stocks last, and the share of demand met.

    branch=False leaves out the shortcut for production that covers demand.
    """
    s = steady_state(params, **solver).drop("y1", "y2")
    tau = F.least(F.lit(float(delta_t)), F.try_divide(F.col("y3"), F.col("d")))
    qd = F.when(F.col("nf_tau") >= delta_t, 1.0).otherwise(F.try_divide(F.col("y3") - 0.5 * F.col("d") * F.col("nf_tau"), F.col("y3")))
    covered = F.col("p") >= F.col("d") if branch else F.lit(False)
    return s.withColumn("nf_tau", tau).select(*params.columns, "y3", F.when(covered, float(delta_t)).otherwise(F.col("nf_tau")).alias("tau"), F.when(covered, 1.0).otherwise(qd).alias("qd"))


#: Production levels of the disruption sweep.
LEVELS = (1.0, 0.99, 0.9, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.0)


def disruption_sweep(params: DataFrame, levels: tuple[float, ...] = LEVELS, delta_t: float = 14.0, t_normal: float = 200.0, t_disrupted: float = 50.0, **solver) -> DataFrame:
    """params x levels: normal and disrupted y3, tau, qd, status.

    A layer collapses if its stock falls under a tenth of the normal one; at level 1 nothing is disrupted.
    """
    normal = steady_state(params, t_normal, **solver).select(*params.columns, F.col("y3").alias("y3_normal"))
    each = normal.withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    cut = each.withColumn("p_full", F.col("p")).withColumn("p", F.col("p") * F.col("level"))
    hit = steady_state(cut, t_disrupted, **solver).withColumn("p", F.col("p_full")).drop("p_full", "y1", "y2").withColumnRenamed("y3", "y3_disrupted")
    n, y = F.col("y3_normal"), F.col("y3_disrupted")
    gone = (F.col("level") < 1) & (y < 0.1 * n) & ~F.isnan(y) & ~F.isnan(n)
    tau = F.when(gone, F.least(F.lit(delta_t), F.try_divide(n, n - y) * 10)).otherwise(delta_t)
    qd = F.when(F.col("d") > 0, F.least(F.lit(1.0), F.try_divide(F.col("p") * F.col("level"), F.col("d")))).otherwise(1.0)
    return hit.withColumn("tau", tau).withColumn("qd", qd).withColumn("status", threshold_status())


def threshold_status() -> Column:
    t = F.col("tau")
    return F.when(t <= 1, "CRITICAL").when(t <= 7, "WARNING").otherwise("SAFE")


def threshold_counts(sweep: DataFrame) -> DataFrame:
    """(status, n, levels): how many and which levels."""
    return sweep.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("level")).alias("levels"))


RATIOS = {"alpha12": ("alpha12", None), "alpha23": ("alpha23", None), "s12/s13": ("s12", "s13"), "s23/s13": ("s23", "s13"), "s12/s23": ("s12", "s23")}


def vulnerability(sweep: DataFrame, *keys: str) -> DataFrame:
    """A row for each key (one without any): stable demand p / d, mean level under 1, the largest ratio's name, the highest critical level (percent), and the grade.

    High if production of more than 50 % is already critical, Medium from 20 %, else Low.
    """
    ratio = F.array(*(F.struct(F.coalesce(F.try_divide(F.col(a), F.col(b)) if b else F.col(a), F.lit(0.0)).alias("x"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, (a, b)) in enumerate(RATIOS.items())))
    out = sweep.groupBy(*keys).agg(
        F.max(F.try_divide(F.col("p"), F.col("d"))).alias("stable_demand"),
        F.avg(F.when(F.col("level") < 1, F.col("level"))).alias("mean_level"),
        F.max(F.array_max(ratio))["name"].alias("top_ratio"),
        F.coalesce(F.max(F.when(F.col("tau") <= 1, F.col("level") * 100)), F.lit(0.0)).alias("critical_level"),
    )
    return out.withColumn("vulnerability", F.when(F.col("critical_level") > 50, "High").when(F.col("critical_level") > 20, "Medium").otherwise("Low"))


def flow_curve(params: DataFrame, times: Column) -> DataFrame:
    """(params..., t, y1, y2, y3): closed-form approach of the layers at the times in an array column."""
    t = F.col("t")
    rise = lambda tau: 1 - F.exp(-t / tau)
    y1 = F.col("p") / (F.col("s12") + F.col("s13") + EPS) * rise(5)
    a12, a23 = F.col("alpha12") + EPS, F.col("alpha23") + EPS
    at = params.withColumn("t", F.explode(times)).withColumn("y1", y1)
    return at.select(*params.columns, "t", "y1", (F.col("s12") / a12 * F.col("y1") * rise(3)).alias("y2"), (F.col("s13") / (a12 * a23) * F.col("y1") * rise(2)).alias("y3"))
