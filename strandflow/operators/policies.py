"""Repair policies on lineage graphs: division filter, confidence pruning, gap and bridge recovery, cleanup.

Each takes and returns DataFrames over all datasets at once. Thresholds are those of Config; gates on angles fail for NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import greedy, spatial, topology
from strandflow.sources.shared import save


@dataclass(frozen=True)
class Config:
    """Fixed values of the frozen policies (probabilities, micrometres, degrees)."""

    p2: float = 0.80
    separation: float = 6.0
    angle: float = 120.0
    arm: float = 8.0
    balance: float = 0.50
    prune_size: int = 9
    residual: float = 4.0
    step: float = 8.0
    step_balance: float = 0.5
    turn: float = 60.0
    margin: float = 1.0
    bridge_radius: float = 8.0
    pair_length: float = 3.5


CONFIG = Config()
#: The radius (micrometres) in which the census first looks for the two nearest; what finds fewer there meets its whole frame.
CENSUS_RING = 32.0


def _at(nodes: DataFrame, key: str, prefix: str) -> DataFrame:
    return nodes.select("dataset", F.col("node_id").alias(key), *[F.col(u).alias(f"{prefix}{u}") for u in g.AXES])


def _v(prefix: str):
    return tuple(F.col(f"{prefix}{u}") for u in g.AXES)


def fork_geometry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources with exactly two edges: the better daughter c1, the other c2, and the fork's geometry."""
    per = Window.partitionBy("dataset", "source_id")
    ranked = edges.withColumn("rn", F.row_number().over(per.orderBy(F.desc("edge_prob"), "edge_id"))).withColumn("n", F.count(F.lit(1)).over(per)).where("n = 2")
    pick = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    f = ranked.groupBy("dataset", "source_id").agg(
        pick("target_id", 1).alias("c1"), pick("target_id", 2).alias("c2"), pick("edge_id", 2).alias("e2"), pick("edge_prob", 1).alias("p1"), pick("edge_prob", 2).alias("p2")
    )
    f = f.join(_at(nodes, "source_id", "p").join(nodes.select("dataset", F.col("node_id").alias("source_id"), "t"), ["dataset", "source_id"]), ["dataset", "source_id"])
    f = f.join(_at(nodes, "c1", "a"), ["dataset", "c1"]).join(_at(nodes, "c2", "b"), ["dataset", "c2"])
    va, vb = g.sub(_v("a"), _v("p")), g.sub(_v("b"), _v("p"))
    f = f.withColumns({"d1": g.norm(va), "d2": g.norm(vb), "sep": g.norm(g.sub(_v("a"), _v("b"))), "angle": g.angle(va, vb)})
    return f.select(
        "dataset", "source_id", "t", "c1", "c2", "e2", "p1", "p2", "d1", "d2", "sep", "angle", F.greatest("d1", "d2").alias("arm"), g.division_balance(F.col("d1"), F.col("d2")).alias("balance")
    )


def gates(c: Config = CONFIG) -> dict:
    """The division gates by name."""
    return {
        "p2_ok": F.col("p2") >= c.p2, "sep_ok": F.col("sep") >= c.separation, "angle_ok": g.finite_at_least(F.col("angle"), c.angle), "arm_ok": F.col("arm") <= c.arm, "balance_ok": F.col("balance") <= c.balance,
    }


def division_candidates(forks: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Forks with each gate's flag, accepted, the kind of reject and the failed gates."""
    f = forks.withColumns(gates(c))
    geometry = F.col("sep_ok") & F.col("angle_ok") & F.col("arm_ok") & F.col("balance_ok")
    kind = F.when(F.col("p2_ok") & geometry, "accepted").when(geometry, "p2_only").when(F.col("p2_ok"), "geometry_only").otherwise("p2_and_geometry")
    failed = F.concat_ws(",", *[F.when(~F.col(k), F.lit(k[:-3])) for k in gates(c)])
    return f.withColumns({"accepted": F.col("p2_ok") & geometry, "reject_kind": kind, "failed": failed})


def division_filter(nodes: DataFrame, edges: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Edges without the second daughter of forks that fail a gate; sources with three or more edges stay as they are."""
    bad = division_candidates(fork_geometry(nodes, edges), c).where(~F.col("accepted")).select("dataset", F.col("e2").alias("edge_id"))
    return edges.join(bad, ["dataset", "edge_id"], "left_anti")


def with_component_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = topology.components(nodes, edges)
    return n.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("dataset", "component")))


def keep_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ids = nodes.select("dataset", "node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"], "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), ["dataset", "target_id"], "left_semi")


def confidence_pruning(nodes: DataFrame, edges: DataFrame, size: int = CONFIG.prune_size) -> DataFrame:
    """Nodes without the low-confidence ones of components of at most so many nodes."""
    return with_component_size(nodes, edges).where((F.col("size") > size) | F.col("high_conf")).select(*nodes.columns)


def gap_census(nodes: DataFrame, edges: DataFrame, residual: float | None = None) -> DataFrame:
    """Track starts (LEFT_MISSING) and ends (RIGHT_MISSING) with the nearest track end or start at the place that constant motion predicts.

    With a residual bound only points that could win or spoil the margin are joined, through the grid; without one the census is complete.
    """
    deg = save(topology.degrees(nodes, edges).select("dataset", "node_id", "t", *g.AXES, "in_degree", "out_degree"))
    frames = save(deg.groupBy("dataset").agg(F.min("t").alias("t0"), F.max("t").alias("t1")))
    end = lambda k: deg.select("dataset", F.col("node_id").alias(f"{k}_id"), F.struct(F.col("node_id").alias("id"), "t", *g.AXES).alias(k), F.col("in_degree").alias(f"{k}_in"), F.col("out_degree").alias(f"{k}_out"))
    links = edges.select("dataset", F.col("source_id").alias("s_id"), F.col("target_id").alias("e_id")).join(end("s"), ["dataset", "s_id"]).join(end("e"), ["dataset", "e_id"]).where("e.t = s.t + 1")
    side = lambda cond, kind, b, n, shift: F.when(F.expr(cond), F.struct(F.lit(kind).alias("type"), F.lit(shift).alias("shift"), F.col(b).alias("b"), F.col(n).alias("n")))
    both = F.array_compact(F.array(side("s_in = 0 AND s_out = 1", "LEFT_MISSING", "s", "e", -1), side("e_in = 1 AND e_out = 0", "RIGHT_MISSING", "e", "s", 1)))
    q = links.select("dataset", F.explode(both).alias("q")).select("dataset", "q.*").join(frames, "dataset").where("b.t + shift BETWEEN t0 AND t1")
    at = lambda k, p: [F.col(f"{k}.{u}").alias(f"{p}{u}") for u in g.AXES]
    q = q.select("dataset", "type", (F.col("b.t") + F.col("shift")).alias("t"), F.col("b.id").alias("b_id"), F.col("n.id").alias("n_id"), *[(2.0 * F.col(f"b.{u}") - F.col(f"n.{u}")).alias(u) for u in g.AXES], *at("b", "B"), *at("n", "N"))
    kinds = F.array_compact(F.array(F.when(F.col("out_degree") == 0, "LEFT_MISSING"), F.when(F.col("in_degree") == 0, "RIGHT_MISSING")))
    o = deg.select("dataset", F.explode(kinds).alias("type"), "t", F.col("node_id").alias("o_id"), *g.AXES, *[F.col(u).alias(f"O{u}") for u in g.AXES])
    keys = ["dataset", "type", "t"]
    pairs = spatial.within(q, o, keys, residual) if residual else spatial.knn(q, o, keys, ["dataset", "b_id"], "o_id", 2, CENSUS_RING, 1).drop("rk")
    w = Window.partitionBy("dataset", "b_id").orderBy("dist", "o_id")  # a node is a start or an end of links, so a query of one type
    best = pairs.withColumn("rk", F.row_number().over(w)).withColumn("second", F.lead("dist").over(w)).where("rk = 1")
    vo, vn = g.sub(_v("B"), _v("O")), g.sub(_v("N"), _v("B"))
    s1, s2 = g.norm(vo), g.norm(vn)
    left = F.col("type") == "LEFT_MISSING"
    return best.select(
        "dataset", "type", F.when(left, F.col("o_id")).otherwise(F.col("n_id")).alias("a_id"), "b_id", F.when(left, F.col("n_id")).otherwise(F.col("o_id")).alias("c_id"),
        F.col("dist").alias("residual"), (F.coalesce("second", F.lit(float("inf"))) - F.col("dist")).alias("margin"),
        F.greatest(s1, s2).alias("max_step"), g.step_balance(s1, s2).alias("step_balance"), g.angle(vo, vn).alias("turn"),
    )


def mutual_policy(census: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Edges (dataset, source_id, target_id) that pass the gates and are proposed from both sides."""
    ok = census.where((F.col("residual") <= c.residual) & (F.col("max_step") <= c.step) & (F.col("step_balance") <= c.step_balance) & (F.col("turn") <= c.turn) & (F.col("margin") >= c.margin))
    left = F.col("type") == "LEFT_MISSING"
    ends = ok.select("dataset", F.when(left, F.col("a_id")).otherwise(F.col("b_id")).alias("source_id"), F.when(left, F.col("b_id")).otherwise(F.col("c_id")).alias("target_id"), "type")
    both = ends.groupBy("dataset", "source_id", "target_id").agg(F.max((F.col("type") == "LEFT_MISSING").cast("int")).alias("l"), F.max((F.col("type") == "RIGHT_MISSING").cast("int")).alias("r"))
    return both.where("l = 1 AND r = 1").select("dataset", "source_id", "target_id")


def bridge_pairs(nodes: DataFrame, edges: DataFrame, radius: float = CONFIG.bridge_radius) -> DataFrame:
    """All pairs of a track end A before and a track start C after each isolated middle B, both within the radius, with their geometry."""
    deg = save(topology.degrees(nodes, edges).where("in_degree = 0 OR out_degree = 0").select("dataset", "node_id", "t", *g.AXES, "in_degree", "out_degree"))
    b = deg.where("in_degree = 0 AND out_degree = 0").select("dataset", "t", F.col("node_id").alias("b_id"), *g.AXES)
    a = deg.where("out_degree = 0").select("dataset", (F.col("t") + 1).alias("t"), F.col("node_id").alias("a_id"), *g.AXES, *[F.col(u).alias(f"A{u}") for u in g.AXES])
    c = deg.where("in_degree = 0").select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("c_id"), *g.AXES, *[F.col(u).alias(f"C{u}") for u in g.AXES])
    b2 = b.select(*b.columns, *[F.col(u).alias(f"B{u}") for u in g.AXES])
    ab = spatial.within(b2, a, ["dataset", "t"], radius).withColumnRenamed("dist", "ab")
    bc = spatial.within(b, c, ["dataset", "t"], radius).withColumnRenamed("dist", "bc").drop("t")
    p = ab.join(bc, ["dataset", "b_id"])
    va, vc = g.sub(_v("B"), _v("A")), g.sub(_v("C"), _v("B"))
    return p.withColumns({"residual": g.norm(g.sub(vc, va)), "max_step": F.greatest("ab", "bc"), "step_balance": g.step_balance(F.col("ab"), F.col("bc")), "turn": g.angle(va, vc)})


def bridge_census(nodes: DataFrame, edges: DataFrame, radius: float = CONFIG.bridge_radius) -> DataFrame:
    """Isolated middles B with the best pair of a track end A before and a track start C after, both within the radius."""
    p = bridge_pairs(nodes, edges, radius)
    per = Window.partitionBy("dataset", "b_id")
    w = per.orderBy("residual", "max_step", "a_id", "c_id")
    p = p.withColumns({"rk": F.row_number().over(w), "next": F.lead("residual").over(w), "pair_count": F.count(F.lit(1)).over(per)}).where("rk = 1")
    return p.select("dataset", "t", "a_id", "b_id", "c_id", "residual", (F.coalesce("next", F.lit(float("inf"))) - F.col("residual")).alias("margin"), "max_step", "step_balance", "turn", "pair_count")


def strict_bridges(census: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Bridges that pass the gates, whose ends serve one middle each after the gates, and which are their middle's only pair."""
    ok = census.where((F.col("residual") <= c.residual) & (F.col("max_step") <= c.step) & (F.col("step_balance") <= c.step_balance) & (F.col("turn") <= c.turn))
    use = lambda k: F.count(F.lit(1)).over(Window.partitionBy("dataset", k))  # noqa: E731  one row per middle
    return ok.withColumns({"a_use": use("a_id"), "c_use": use("c_id")}).where("a_use = 1 AND c_use = 1 AND pair_count = 1").drop("a_use", "c_use")


def _static(proposed: DataFrame, nodes: DataFrame, edges: DataFrame, ends: list[str], links: list[tuple[str, str]]) -> DataFrame:
    """Adds reason: why a proposal can't be added to the graph as it is (missing_endpoint, existing_edge, degree_conflict, in this order), else null."""
    ids = nodes.select("dataset", "node_id")
    p, there, busy, missing = proposed, F.lit(False), F.lit(False), F.lit(False)
    for k in ends:
        p = p.join(ids.select("dataset", F.col("node_id").alias(k), F.lit(True).alias(f"_n{k}")), ["dataset", k], "left")
        missing = missing | F.col(f"_n{k}").isNull()
    for s, t in links:
        p = p.join(edges.select("dataset", F.col("source_id").alias(s), F.col("target_id").alias(t), F.lit(True).alias(f"_e{s}")).distinct(), ["dataset", s, t], "left")
        p = p.join(edges.select("dataset", F.col("source_id").alias(s), F.lit(True).alias(f"_o{s}")).distinct(), ["dataset", s], "left")
        p = p.join(edges.select("dataset", F.col("target_id").alias(t), F.lit(True).alias(f"_i{t}")).distinct(), ["dataset", t], "left")
        there = there | F.col(f"_e{s}").isNotNull()
        busy = busy | F.col(f"_o{s}").isNotNull() | F.col(f"_i{t}").isNotNull()
    # the inner node of a bridge must have no edge at all
    for k in {t for _, t in links} & {s for s, _ in links}:
        p = p.join(edges.select("dataset", F.col("source_id").alias(k), F.lit(True).alias("_out")).distinct(), ["dataset", k], "left")
        busy = busy | F.col("_out").isNotNull()
    reason = F.when(missing, "missing_endpoint").when(there, "existing_edge").when(busy, "degree_conflict")
    return p.select(*proposed.columns, reason.alias("reason"))


def _applied(proposed: DataFrame, nodes: DataFrame, edges: DataFrame, ends: list[str], links: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """Proposals with the outcome that a loop in order would give: added, or the reason for which they are refused."""
    p = save(_static(proposed, nodes, edges, ends, links))
    # an end serves one edge out and one in; a negative number stands for an edge in
    uses = {f"r{i}": (F.col(s) + 1 if k == 0 else -F.col(t) - 1) for i, (s, t, k) in enumerate((s, t, k) for s, t in links for k in (0, 1))}
    free = p.where("reason IS NULL").withColumns(uses)
    won = save(greedy.ordered_greedy(free.select("dataset", *ends, *[c for c in order if c not in ends], *uses), ["dataset"], order, list(uses)).select("dataset", *ends, *[c for c in order if c not in ends]))
    p = p.join(won.select("dataset", *order, F.lit(True).alias("won")), ["dataset", *order], "left")
    # a refused proposal meets its own edge, added before it, or an end that is taken
    made = None
    for i, (s, t) in enumerate(links):
        for x, y in links:
            mine = p.where("won IS NULL AND coalesce(reason, 'degree_conflict') = 'degree_conflict'").select("dataset", *order, F.col(s).alias("_s"), F.col(t).alias("_t"))
            one = won.select("dataset", F.col(x).alias("_s"), F.col(y).alias("_t"), F.struct(*order).alias("before")).join(mine, ["dataset", "_s", "_t"]).where(F.col("before") < F.struct(*order)).select("dataset", *order)
            made = one if made is None else made.unionByName(one)
    p = p.join(made.distinct().withColumn("made", F.lit(True)), ["dataset", *order], "left")
    outcome = F.when(F.col("won"), "added").when(F.col("made"), "existing_edge").otherwise(F.coalesce("reason", F.lit("degree_conflict")))
    return p.select(*proposed.columns, outcome.alias("reason"))


def repair_reasons(proposed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed single edges (dataset, source_id, target_id) with their outcome, tried by source and target; the first of rivals wins."""
    return _applied(proposed.select("dataset", "source_id", "target_id"), nodes, edges, ["source_id", "target_id"], [("source_id", "target_id")], ["source_id", "target_id"])


def bridge_reasons(bridges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed bridges (dataset, t, a_id, b_id, c_id) with their outcome, tried by t and middle."""
    b = bridges.select("dataset", "t", "a_id", "b_id", "c_id")
    return _applied(b, nodes, edges, ["a_id", "b_id", "c_id"], [("a_id", "b_id"), ("b_id", "c_id")], ["t", "b_id"])


def bridge_edges(bridges: DataFrame) -> DataFrame:
    """The two edges (dataset, source_id, target_id) of each bridge."""
    two = F.array(F.struct(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id")), F.struct(F.col("b_id").alias("source_id"), F.col("c_id").alias("target_id")))
    return bridges.select("dataset", F.explode(two).alias("e")).select("dataset", "e.source_id", "e.target_id")


def added_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges (probability 0) in the form of edges, with their length on the model's grid."""
    at = lambda k, p: nodes.select("dataset", F.col("node_id").alias(k), *[F.col(v).alias(f"{p}{v}") for v in "zyx"])
    j = pairs.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"])
    length = g.norm(tuple((F.col(f"b{v}") - F.col(f"a{v}")) / F.lit(k) for v, k in zip("zyx", g.GRID, strict=True)))
    return j.select("dataset", (F.col("source_id") * 100000000 + F.col("target_id")).alias("edge_id"), "source_id", "target_id", F.lit(0.0).alias("edge_prob"), length.alias("edge_dist"))


def with_edges(edges: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.unionByName(added_edges(pairs, nodes), allowMissingColumns=True)


def component_cleanup(nodes: DataFrame, edges: DataFrame, length: float = CONFIG.pair_length) -> DataFrame:
    """Nodes without singletons and without components of two nodes farther apart than the length; degrees alone tell both."""
    deg = topology.degrees(nodes, edges).withColumn("deg", F.col("in_degree") + F.col("out_degree"))
    end = lambda k, p: deg.select("dataset", F.col("node_id").alias(k), F.col("deg").alias(f"{p}deg"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    pairs = edges.join(end("source_id", "a"), ["dataset", "source_id"]).join(end("target_id", "b"), ["dataset", "target_id"]).where("adeg = 1 AND bdeg = 1").where(g.norm(g.sub(_v("a"), _v("b"))) > length)
    bad = pairs.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return deg.where("deg > 0").join(bad, ["dataset", "node_id"], "left_anti").select(*nodes.columns)
