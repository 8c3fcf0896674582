"""Cuts, capacities and dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netframe.operators import flow, generate, message

from .tables import SUPPLY, TRADE, TRADE3, r, supply, trade, trade3


def min_cut_direct(spark, d):
    g, masks = supply(spark, d)
    return flow.min_cut(g, masks, "ref", "gas")


def min_cut_weighted(spark, d):
    g = trade(spark, d)
    masks = g.vertices.select("id", (F.col("region") == 0).alias("a"), (F.col("region") == 3).alias("b"))
    return flow.min_cut(g, masks, "a", "b")


def min_cut_matrix(spark, d):
    g, masks = supply(spark, d)
    return flow.min_cut_matrix(g, masks, "ref", "gas", edges_doubled=False)


def capacity_params(spark, d):
    g, masks = supply(spark, d)
    p = flow.capacity_params(g, masks)
    return p.select(*(r(c, 5).alias(c.lower()) for c in p.columns))


def _regions(spark, d):
    """Five scenarios: each region in turn is the first layer, the next the second, the others the third."""
    v = trade(spark, d).vertices
    each = v.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(4))))
    turn = (F.col("region") - F.col("scenario") + 5) % 5
    return each.select("scenario", "id", (turn == 0).alias("ref"), (turn == 1).alias("term"), (turn >= 2).alias("gas"))


REGIONS = """m AS (SELECT s AS scenario, id, (region - s + 5) % 5 = 0 AS a, (region - s + 5) % 5 = 1 AS b, (region - s + 5) % 5 >= 2 AS c FROM v CROSS JOIN (SELECT unnest(range(0, 5)) AS s))"""


def capacity_batch(spark, d):
    p = flow.capacity_params(trade(spark, d), _regions(spark, d), ("scenario",), C1=50.0, C2=100.0, C3=200.0, capacity=F.col("weight"), edges_doubled=False, p=0.1, d=0.05)
    return p.select("scenario", *(r(c, 6).alias(c.lower()) for c in p.columns if c != "scenario"))


def max_stable_demand(spark, d):
    p = flow.capacity_params(trade(spark, d), _regions(spark, d), ("scenario",))
    return p.select("scenario", r(flow.max_stable_demand(), 5).alias("demand"))


def _scenarios(spark, d):
    """One parameter row for each nation, from its customers and suppliers."""
    c = trade(spark, d).edges.groupBy("src").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("w").alias("total"))
    x = F.col("w") / F.col("total")
    j = c.crossJoin(F.broadcast(total))  # one row
    return j.select(
        F.col("src").alias("id"), (0.05 + x).alias("s12"), (0.1 + x).alias("s23"), (0.02 + x / 2).alias("s13"), F.lit(0.8).alias("alpha12"), F.lit(0.5).alias("alpha23"), (0.3 + x).alias("p"), F.lit(0.79).alias("d")
    )


SCENARIOS = """t AS (SELECT src, sum(w) AS w FROM trade GROUP BY ALL), q AS (SELECT src AS id, w / (SELECT sum(w) FROM t) AS x FROM t),
par AS (SELECT id, 0.05 + x AS s12, 0.1 + x AS s23, 0.02 + x / 2 AS s13, 0.8::DOUBLE AS a12, 0.5::DOUBLE AS a23, 0.3 + x AS p, 0.79::DOUBLE AS d FROM q)"""


def _tsit5_sql(steps: int, constant: bool = False, name: str = "z", start: str = "par", more: str = "") -> str:
    """Fixed steps of the same tableau as a recursive query: one row for each scenario and step.

    more: further columns of the start table that go along, each with a comma behind.
    """
    made = "p" if constant else "p * ({a})"
    dt = 0.1
    names = ("y1", "y2", "y3")

    def slope(y: list[str]) -> list[str]:
        a, b, c = y
        return [f"{made.format(a=a)} - s12 * ({a}) * ({b}) - s13 * ({a}) * ({c})", f"s12 / a12 * ({a}) * ({b}) - s23 * ({b}) * ({c})", f"-d * ({c}) + s13 / (a12 * a23) * ({a}) * ({c}) + s23 / a23 * ({b}) * ({c})"]

    inner, stage = name, list(names)
    for k in range(6):
        own = ", ".join(f"{x}::DOUBLE AS k{k}_{i}" for i, x in enumerate(slope(stage)))
        inner = f"(SELECT *, {own} FROM {inner})"
        stage = [f"{n} + {dt}::DOUBLE * (" + " + ".join(f"({a!r})::DOUBLE * k{m}_{i}" for m, a in enumerate(flow.TSIT5[k])) + ")" for i, n in enumerate(names)]
    new = ", ".join(f"({x})::DOUBLE AS {n}" for x, n in zip(stage, names))
    cols = f"{more}id, s12, s23, s13, a12, a23, p, d"
    return f"""{name} AS (SELECT {cols}, 1.0::DOUBLE AS y1, 1.0::DOUBLE AS y2, 1.0::DOUBLE AS y3, 0 AS step FROM {start} UNION ALL
SELECT {cols}, {new}, step + 1 FROM {inner} WHERE step < {steps})"""


def steady_state(spark, d):
    return flow.steady_state(_scenarios(spark, d), t_max=5.0).select("id", *(r(c, 6).alias(c) for c in ("y1", "y2", "y3")))


def max_flow_min_cut(spark, d):
    """The cheapest cut between the nations of two regions, in the graph of each nation's heaviest edges."""
    g = trade3(spark, d)
    masks = g.vertices.select("id", (F.col("region") == 0).alias("a"), (F.col("region") == 3).alias("b"))
    return spark.createDataFrame([(round(flow.max_flow(g, masks, "a", "b"), 4),)], "cut double")


def steady_state_constant(spark, d):
    return flow.steady_state(_scenarios(spark, d), production="constant").select("id", *(r(c, 4).alias(c) for c in ("y1", "y2", "y3")))


def failure_time(spark, d):
    return flow.failure_time(_scenarios(spark, d), 2.0, t_max=5.0).select("id", *(r(c, 6).alias(c) for c in ("y3", "tau", "qd")))


def disruption_sweep(spark, d):
    return flow.disruption_sweep(_scenarios(spark, d), t_normal=20.0, t_disrupted=5.0).select("id", "level", r("qd").alias("qd"), r("tau", 3).alias("tau"), "status")


def threshold_classes(spark, d):
    s = _scenarios(spark, d).withColumn("tau", F.col("s12") * 60).withColumn("level", F.col("id"))
    return flow.threshold_counts(s.withColumn("status", flow.threshold_status())).select("status", "n", F.array_join("levels", ",").alias("ids"))


def key_metrics(spark, d):
    p = flow.scaled_flows(_scenarios(spark, d))
    each = p.withColumn("level", F.explode(F.array(*(F.lit(x) for x in flow.LEVELS)))).withColumn("tau", F.col("level") * 14)
    v = flow.vulnerability(each, "id")
    return v.select("id", r("stable_demand").alias("stable_demand"), r("mean_level").alias("mean_level"), "top_ratio", r("critical_level").alias("critical_level"), "vulnerability")


def scaled_flows(spark, d):
    return flow.scaled_flows(_scenarios(spark, d)).select("id", *(r(c).alias(c) for c in ("s12", "s23", "s13")))


def flow_curve(spark, d):
    c = flow.flow_curve(_scenarios(spark, d), F.transform(F.sequence(F.lit(0), F.lit(24)), lambda t: t.cast("double")))
    return c.select("id", "t", *(r(x).alias(x) for x in ("y1", "y2", "y3")))


def layer_capacity_by_degree(spark, d):
    """Direct capacity between degree layers, an edge counting the degrees of its ends."""
    g, _ = supply(spark, d)
    layers = message.degree_layers(g)
    masks = layers.select("id", (F.col("layer") == "ref").alias("ref"), (F.col("layer") == "gas").alias("gas"))
    caps = message.edge_capacities(g)
    from netframe.operators.graph import PropertyGraph

    own = PropertyGraph(g.vertices, caps.select("src", "dst", F.col("capacity").alias("weight"), F.lit(0).alias("pos")))
    return flow.min_cut(own, masks, "ref", "gas")


def supply_chain_model(spark, d):
    """Capacities of a generated three-layer chain."""
    g, masks = generate.supply_chain(spark)
    p = flow.capacity_params(g, masks, capacity=F.col("weight"), edges_doubled=False)
    return p.select(*(r(c, 4).alias(c.lower()) for c in p.columns))


_CUT = """x AS (SELECT {keys}sum(CASE WHEN (sa AND tb) OR (sb AND ta) THEN cap END) AS dab, sum(CASE WHEN (sb AND tc) OR (sc AND tb) THEN cap END) AS dbc, sum(CASE WHEN (sa AND tc) OR (sc AND ta) THEN cap END) AS dac,
 sum(CASE WHEN (sa AND NOT ta AND NOT tb) OR (ta AND NOT sa AND NOT sb) THEN cap END) AS a_ab, sum(CASE WHEN (sb AND NOT ta AND NOT tb) OR (tb AND NOT sa AND NOT sb) THEN cap END) AS b_ab,
 sum(CASE WHEN (sb AND NOT tb AND NOT tc) OR (tb AND NOT sb AND NOT sc) THEN cap END) AS b_bc, sum(CASE WHEN (sc AND NOT tb AND NOT tc) OR (tc AND NOT sb AND NOT sc) THEN cap END) AS c_bc,
 sum(CASE WHEN (sa AND NOT ta AND NOT tc) OR (ta AND NOT sa AND NOT sc) THEN cap END) AS a_ac, sum(CASE WHEN (sc AND NOT ta AND NOT tc) OR (tc AND NOT sa AND NOT sc) THEN cap END) AS c_ac FROM ends {group}),
w AS (SELECT {keys}(coalesce(dab, 0) + least(coalesce(a_ab, 0), coalesce(b_ab, 0))) / {by} AS w12, (coalesce(dbc, 0) + least(coalesce(b_bc, 0), coalesce(c_bc, 0))) / {by} AS w23, (coalesce(dac, 0) + least(coalesce(a_ac, 0), coalesce(c_ac, 0))) / {by} AS w13 FROM x)"""

_SUPPLY_ENDS = f"WITH {SUPPLY}, ends AS (SELECT src % 3 = 0 AS sa, src % 3 = 1 AS sb, src % 3 = 2 AS sc, dst % 3 = 0 AS ta, dst % 3 = 1 AS tb, dst % 3 = 2 AS tc, 28.0::DOUBLE AS cap FROM e), n AS (SELECT CAST(count(*) FILTER (WHERE id % 3 = 0) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE id % 3 = 1) AS DOUBLE) AS n2, CAST(count(*) FILTER (WHERE id % 3 = 2) AS DOUBLE) AS n3 FROM v), "
_SCEN_ENDS = f"WITH {TRADE}, {REGIONS}, ends AS (SELECT x.scenario, x.a AS sa, x.b AS sb, x.c AS sc, y.a AS ta, y.b AS tb, y.c AS tc, {{cap}} AS cap FROM trade JOIN m x ON x.id = src JOIN m y ON y.id = dst AND y.scenario = x.scenario), n AS (SELECT scenario, CAST(sum(a::INT) AS DOUBLE) AS n1, CAST(sum(b::INT) AS DOUBLE) AS n2, CAST(sum(c::INT) AS DOUBLE) AS n3 FROM m GROUP BY ALL), "


def _param_sql(c1: float, c2: float, c3: float) -> str:
    return f"w12 / (n1 * {c1} + 1e-8) AS s12, w23 / (n2 * {c2} + 1e-8) AS s23, w13 / (n1 * {c1} + 1e-8) AS s13, n2 * {c2} / (n1 * {c1} + 1e-8) AS alpha12, n3 * {c3} / (n2 * {c2} + 1e-8) AS alpha23"


_COLS = ("n1", "n2", "n3", "w12", "w23", "w13", "s12", "s23", "s13", "alpha12", "alpha23", "p", "d")

QUERIES = {
    "q_min_cut_direct": (min_cut_direct, f"WITH {SUPPLY} SELECT CAST(count(*) AS DOUBLE) AS cut FROM e WHERE src % 3 = 0 AND dst % 3 = 2"),
    "q_min_cut_weighted": (min_cut_weighted, f"WITH {TRADE} SELECT sum(w) AS cut FROM trade JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.region = 0 AND b.region = 3"),
    "q_min_cut_matrix": (min_cut_matrix, f"""WITH {SUPPLY} SELECT CAST(count(*) FILTER (WHERE src % 3 = 0 AND dst % 3 = 2) + least(count(*) FILTER (WHERE src % 3 = 0 AND dst % 3 = 1), count(*) FILTER (WHERE src % 3 = 1 AND dst % 3 = 2)) AS DOUBLE) AS cut FROM e"""),
    "q_capacity_params": (capacity_params, _SUPPLY_ENDS + _CUT.format(keys="", group="", by="2.0") + f", o AS (SELECT n1, n2, n3, w12, w23, w13, {_param_sql(38.2, 31.0, 0.035)}, 0.42::DOUBLE AS p, 0.79::DOUBLE AS d FROM n, w) SELECT " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _COLS) + " FROM o"),
    "q_capacity_batch": (capacity_batch, _SCEN_ENDS.format(cap="w") + _CUT.format(keys="scenario, ", group="GROUP BY ALL", by="1.0") + f", o AS (SELECT n.scenario, n1, n2, n3, w12, w23, w13, {_param_sql(50.0, 100.0, 200.0)}, 0.1::DOUBLE AS p, 0.05::DOUBLE AS d FROM n JOIN w USING (scenario)) SELECT CAST(scenario AS INTEGER) AS scenario, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _COLS) + " FROM o"),
    "q_max_stable_demand": (max_stable_demand, _SCEN_ENDS.format(cap="28.0::DOUBLE") + _CUT.format(keys="scenario, ", group="GROUP BY ALL", by="2.0") + f", o AS (SELECT n.scenario, {_param_sql(38.2, 31.0, 0.035)} FROM n JOIN w USING (scenario)) SELECT CAST(scenario AS INTEGER) AS scenario, round((s13 + least(s12, alpha23 * s23)) / (alpha12 * alpha23), 5) + 0.0 AS demand FROM o"),
    "q_steady_state": (steady_state, f"WITH RECURSIVE {TRADE}, {SCENARIOS}, {_tsit5_sql(50)} SELECT id, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3 FROM z WHERE step = 50"),
    "q_steady_state_constant": (steady_state_constant, f"WITH RECURSIVE {TRADE}, {SCENARIOS}, {_tsit5_sql(500, True)} SELECT id, round(y1, 4) + 0.0 AS y1, round(y2, 4) + 0.0 AS y2, round(y3, 4) + 0.0 AS y3 FROM z WHERE step = 500"),
    "q_max_flow_min_cut": (max_flow_min_cut, f"""WITH {TRADE3}, free AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS bit FROM v WHERE region NOT IN (0, 3)), sets AS (SELECT unnest(range(0, CAST(1 << (SELECT CAST(count(*) AS INTEGER) FROM free) AS BIGINT))) AS m),
e AS (SELECT w, a.region = 0 AS sa, a.region = 3 AS sb, x.bit AS sbit, b.region = 0 AS ta, b.region = 3 AS tb, y.bit AS tbit FROM trade3 JOIN v a ON a.id = src JOIN v b ON b.id = dst LEFT JOIN free x ON x.id = src LEFT JOIN free y ON y.id = dst),
cuts AS (SELECT m, sum(w) FILTER (WHERE (sa OR (NOT sb AND (m >> sbit) & 1 = 1)) AND (tb OR (NOT ta AND (m >> tbit) & 1 = 0))) AS cut FROM sets CROSS JOIN e GROUP BY m)
SELECT round(min(coalesce(cut, 0)), 4) + 0.0 AS cut FROM cuts"""),
    "q_failure_time": (failure_time, f"""WITH RECURSIVE {TRADE}, {SCENARIOS}, {_tsit5_sql(50)}, f AS (SELECT *, least(2.0, y3 / d) AS tau0 FROM z WHERE step = 50)
SELECT id, round(y3, 6) + 0.0 AS y3, round(CASE WHEN p >= d THEN 2.0 ELSE tau0 END, 6) + 0.0::DOUBLE AS tau, round(CASE WHEN p >= d OR tau0 >= 2.0 THEN 1.0 ELSE (y3 - 0.5 * d * tau0) / y3 END, 6) + 0.0::DOUBLE AS qd FROM f"""),
    "q_disruption_sweep": (disruption_sweep, f"""WITH RECURSIVE {TRADE}, {SCENARIOS}, {_tsit5_sql(200)}, hit AS (SELECT y3 AS n, p AS p_full, level, id, s12, s23, s13, a12, a23, p * level AS p, d FROM z CROSS JOIN (SELECT CAST(unnest([1.0, 0.99, 0.9, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.0]) AS DOUBLE) AS level) WHERE step = 200),
{_tsit5_sql(50, False, "z2", "hit", "n, p_full, level, ")}, tt AS (SELECT id, level, p_full, d, CASE WHEN level < 1 AND y3 < 0.1 * n THEN least(14.0, n / nullif(n - y3, 0) * 10) ELSE 14.0 END AS tau FROM z2 WHERE step = 50)
SELECT id, level, round(least(1.0, p_full * level / d), 6)::DOUBLE + 0.0 AS qd, round(tau, 3)::DOUBLE + 0.0 AS tau, CASE WHEN tau <= 1 THEN 'CRITICAL' WHEN tau <= 7 THEN 'WARNING' ELSE 'SAFE' END AS status FROM tt"""),
    "q_threshold_classes": (threshold_classes, f"WITH {TRADE}, {SCENARIOS}, s AS (SELECT id, CASE WHEN s12 * 60 <= 1 THEN 'CRITICAL' WHEN s12 * 60 <= 7 THEN 'WARNING' ELSE 'SAFE' END AS status FROM par) SELECT status, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM s GROUP BY ALL"),
    "q_key_metrics": (key_metrics, f"""WITH {TRADE}, {SCENARIOS}, k AS (SELECT p / d AS sd, a12, a23, s12 / s13 AS r1, s23 / s13 AS r2, s12 / s23 AS r3, id FROM par), l AS (SELECT unnest([1.0, 0.99, 0.9, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.0]) AS level),
m AS (SELECT avg(level) FILTER (WHERE level < 1) AS ml, coalesce(max(level * 100) FILTER (WHERE level * 14 <= 1), 0) AS cl FROM l)
SELECT id, round(sd, 6) + 0.0 AS stable_demand, round(ml, 6)::DOUBLE + 0.0 AS mean_level, CASE greatest(a12, a23, r1, r2, r3) WHEN a12 THEN 'alpha12' WHEN a23 THEN 'alpha23' WHEN r1 THEN 's12/s13' WHEN r2 THEN 's23/s13' ELSE 's12/s23' END AS top_ratio, CAST(cl AS DOUBLE) AS critical_level, CASE WHEN cl > 50 THEN 'High' WHEN cl > 20 THEN 'Medium' ELSE 'Low' END AS vulnerability FROM k, m"""),
    "q_scaled_flows": (scaled_flows, f"WITH {TRADE}, {SCENARIOS}, g AS (SELECT *, greatest(s12, s23, s13) AS m FROM par) SELECT id, round(s12 * 0.1 / m, 6) + 0.0 AS s12, round(s23 * 0.1 / m, 6) + 0.0 AS s23, round(s13 * 0.1 / m, 6) + 0.0 AS s13 FROM g"),
    "q_flow_curve": (flow_curve, f"""WITH {TRADE}, {SCENARIOS}, t5 AS (SELECT par.*, CAST(t AS DOUBLE) AS t, p / (s12 + s13 + 1e-8) * (1 - exp(-t / 5.0::DOUBLE)) AS y FROM par CROSS JOIN (SELECT CAST(unnest(range(0, 25)) AS DOUBLE) AS t))
SELECT id, t, round(y, 6) + 0.0 AS y1, round(s12 / (a12 + 1e-8) * y * (1 - exp(-t / 3)), 6) + 0.0 AS y2, round(s13 / ((a12 + 1e-8) * (a23 + 1e-8)) * y * (1 - exp(-t / 2)), 6) + 0.0 AS y3 FROM t5"""),
    "q_layer_capacity_by_degree": (layer_capacity_by_degree, f"""WITH {SUPPLY}, d AS (SELECT v.id, count(u.id) AS d FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) u ON u.id = v.id GROUP BY ALL), q AS (SELECT quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.75) AS b FROM d)
SELECT CAST(coalesce(sum(x.d + y.d), 0) AS DOUBLE) AS cut FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst, q WHERE x.d <= a AND y.d >= b AND NOT y.d <= a"""),
    "q_supply_chain_model": (supply_chain_model, None),
}
