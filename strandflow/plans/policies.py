"""Queries over the repair policies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import policies, spatial, topology
from strandflow.plans import oracle
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save


def graph(spark, d):
    n = tracks.nodes(spark, d)
    return n, tracks.edges(n)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("SELECT dataset, source_id, t, c1, c2, round(d1,6) d1, round(d2,6) d2, round(sep,6) sep, round(angle,6) angle, round(arm,6) arm, round(balance,6) balance FROM forks")
def fork_geometry(spark, d):
    f = rounded(policies.fork_geometry(*graph(spark, d)), "d1", "d2", "sep", "angle", "arm", "balance")
    return f.select("dataset", "source_id", "t", "c1", "c2", "d1", "d2", "sep", "angle", "arm", "balance")


@query("SELECT dataset, edge_id, source_id, target_id, round(edge_prob,6) edge_prob FROM g2_edges")
def division_filter(spark, d):
    return rounded(policies.division_filter(*graph(spark, d)), "edge_prob").select("dataset", "edge_id", "source_id", "target_id", "edge_prob")


CAND = """SELECT dataset, source_id, p2>=0.8 p2_ok, sep>=6 sep_ok, (NOT isnan(angle) AND angle>=120) angle_ok, arm<=8 arm_ok, balance<=0.5 balance_ok FROM forks"""
KIND = f"""SELECT *, p2_ok AND geo accepted, CASE WHEN p2_ok AND geo THEN 'accepted' WHEN geo THEN 'p2_only' WHEN p2_ok THEN 'geometry_only' ELSE 'p2_and_geometry' END reject_kind,
 concat_ws(',', CASE WHEN NOT p2_ok THEN 'p2' END, CASE WHEN NOT sep_ok THEN 'sep' END, CASE WHEN NOT angle_ok THEN 'angle' END, CASE WHEN NOT arm_ok THEN 'arm' END, CASE WHEN NOT balance_ok THEN 'balance' END) failed
 FROM (SELECT *, sep_ok AND angle_ok AND arm_ok AND balance_ok geo FROM ({CAND}))"""


@query(f"SELECT dataset, source_id, p2_ok, sep_ok, angle_ok, arm_ok, balance_ok, accepted, reject_kind, failed FROM ({KIND})")
def division_candidates(spark, d):
    c = policies.division_candidates(policies.fork_geometry(*graph(spark, d)))
    return c.select("dataset", "source_id", "p2_ok", "sep_ok", "angle_ok", "arm_ok", "balance_ok", "accepted", "reject_kind", "failed")


@query("""SELECT rule, count(*) forks, sum(CASE WHEN p2>=rp2 AND sep>=rsep AND arm<=rarm AND balance<=rbal AND (rang=0 OR (NOT isnan(angle) AND angle>=rang)) THEN 1 ELSE 0 END)::bigint kept
 FROM forks, (VALUES ('P80',0.8,0,1e9,1e9,0),('G1',0.8,6,1e9,1e9,0),('G2',0.8,6,8,0.5,120),('G3',0.8,6,8,1e9,0),('G4',0.7,5,10,0.5,90),('G5',0.5,4,12,0.6,60)) r(rule,rp2,rsep,rarm,rbal,rang) GROUP BY rule""")
def division_rule_family(spark, d):
    """Kept forks under a family of gates: the rules are a small literal table beside the forks."""
    rules = spark.createDataFrame(
        [("P80", 0.8, 0.0, 1e9, 1e9, 0.0), ("G1", 0.8, 6.0, 1e9, 1e9, 0.0), ("G2", 0.8, 6.0, 8.0, 0.5, 120.0), ("G3", 0.8, 6.0, 8.0, 1e9, 0.0), ("G4", 0.7, 5.0, 10.0, 0.5, 90.0), ("G5", 0.5, 4.0, 12.0, 0.6, 60.0)],
        "rule string, rp2 double, rsep double, rarm double, rbal double, rang double",
    )
    f = policies.fork_geometry(*graph(spark, d)).crossJoin(F.broadcast(rules))
    ok = F.expr("p2>=rp2 AND sep>=rsep AND arm<=rarm AND balance<=rbal AND (rang=0 OR (NOT isnan(angle) AND angle>=rang))")
    return f.groupBy("rule").agg(F.count(F.lit(1)).alias("forks"), F.sum(ok.cast("int")).alias("kept"))


@query("""SELECT n.dataset, n.node_id FROM nodes n JOIN comp c USING (dataset,node_id) JOIN compsize s USING (dataset,component) WHERE s.size>9 OR high_conf""")
def confidence_pruning(spark, d):
    return policies.confidence_pruning(*graph(spark, d)).select("dataset", "node_id")


GAP = """(WITH span AS (SELECT *, min(t) OVER (PARTITION BY dataset) t0, max(t) OVER (PARTITION BY dataset) t1 FROM deg),
q AS (SELECT b.dataset, 'LEFT_MISSING' type, b.t-1 ot, b.node_id b_id, n.node_id n_id, b.uz bz, b.uy byy, b.ux bx, n.uz nz, n.uy ny, n.ux nx FROM span b JOIN edges e ON e.dataset=b.dataset AND e.source_id=b.node_id JOIN nodes n ON n.dataset=b.dataset AND n.node_id=e.target_id AND n.t=b.t+1 WHERE b.in_degree=0 AND b.out_degree=1 AND b.t>b.t0
 UNION ALL SELECT b.dataset, 'RIGHT_MISSING', b.t+1, b.node_id, n.node_id, b.uz, b.uy, b.ux, n.uz, n.uy, n.ux FROM span b JOIN edges e ON e.dataset=b.dataset AND e.target_id=b.node_id JOIN nodes n ON n.dataset=b.dataset AND n.node_id=e.source_id AND n.t=b.t-1 WHERE b.in_degree=1 AND b.out_degree=0 AND b.t<b.t1),
p AS (SELECT q.*, o.node_id o_id, o.uz oz, o.uy oy, o.ux ox, sqrt((2*bz-nz-o.uz)*(2*bz-nz-o.uz)+(2*byy-ny-o.uy)*(2*byy-ny-o.uy)+(2*bx-nx-o.ux)*(2*bx-nx-o.ux)) dist FROM q JOIN deg o ON o.dataset=q.dataset AND o.t=q.ot AND ((type='LEFT_MISSING' AND o.out_degree=0) OR (type='RIGHT_MISSING' AND o.in_degree=0))),
b AS (SELECT *, row_number() OVER w rk, lead(dist) OVER w nxt FROM p WINDOW w AS (PARTITION BY dataset,b_id,type ORDER BY dist,o_id)),
s AS (SELECT *, sqrt((bz-oz)*(bz-oz)+(byy-oy)*(byy-oy)+(bx-ox)*(bx-ox)) s1, sqrt((nz-bz)*(nz-bz)+(ny-byy)*(ny-byy)+(nx-bx)*(nx-bx)) s2, (bz-oz)*(nz-bz)+(byy-oy)*(ny-byy)+(bx-ox)*(nx-bx) dp FROM b WHERE rk=1)
SELECT dataset, type, CASE WHEN type='LEFT_MISSING' THEN o_id ELSE n_id END a_id, b_id, CASE WHEN type='LEFT_MISSING' THEN n_id ELSE o_id END c_id, dist residual, coalesce(nxt,'inf'::double)-dist margin, greatest(s1,s2) max_step, abs(s1-s2)/greatest(s1,s2,1e-12::double) step_balance,
 CASE WHEN s1*s2>0 THEN degrees(acos(least(greatest(dp/(s1*s2),-1.0::double),1.0::double))) ELSE 'nan'::double END turn FROM s)"""
MUTUAL = f"""(SELECT dataset, CASE WHEN type='LEFT_MISSING' THEN a_id ELSE b_id END source_id, CASE WHEN type='LEFT_MISSING' THEN b_id ELSE c_id END target_id FROM {GAP} z
 WHERE residual<=4 AND max_step<=8 AND step_balance<=0.5 AND turn<=60 AND margin>=1 GROUP BY ALL HAVING count(DISTINCT type)=2)"""
ROUND = "round(residual,6) residual, round(margin,6) margin, round(max_step,6) max_step, round(step_balance,6) step_balance, round(turn,4) turn"


def shown(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "residual", "margin", "max_step", "step_balance"), "turn", digits=4)


@query(f"SELECT dataset, type, a_id, b_id, c_id, {ROUND} FROM {GAP} z")
def gap_census(spark, d):
    return shown(policies.gap_census(*saved_graph(spark, d)))


@query(f"SELECT * FROM {MUTUAL} z")
def mutual_policy(spark, d):
    """Only points nearer than residual + margin can win or spoil, so the census runs through the grid with that radius."""
    return policies.mutual_policy(policies.gap_census(*saved_graph(spark, d), residual=policies.CONFIG.residual + policies.CONFIG.margin))


BRIDGE = """(WITH a AS (SELECT b.dataset, b.t, b.node_id b_id, b.uz bz, b.uy byy, b.ux bx, a.node_id a_id, a.uz az, a.uy ay, a.ux ax, sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)) ab FROM deg b JOIN deg a ON a.dataset=b.dataset AND a.t=b.t-1 WHERE b.in_degree=0 AND b.out_degree=0 AND a.out_degree=0),
c AS (SELECT a.*, c.node_id c_id, c.uz cz, c.uy cy, c.ux cx, sqrt((c.uz-bz)*(c.uz-bz)+(c.uy-byy)*(c.uy-byy)+(c.ux-bx)*(c.ux-bx)) bc FROM a JOIN deg c ON c.dataset=a.dataset AND c.t=a.t+1 AND c.in_degree=0 WHERE ab<=8),
s AS (SELECT *, (cz-bz)-(bz-az) rz, (cy-byy)-(byy-ay) ry, (cx-bx)-(bx-ax) rx, (bz-az)*(cz-bz)+(byy-ay)*(cy-byy)+(bx-ax)*(cx-bx) dp FROM c WHERE bc<=8),
p AS (SELECT *, sqrt(rz*rz+ry*ry+rx*rx) residual, greatest(ab,bc) max_step FROM s),
r AS (SELECT *, row_number() OVER w rk, lead(residual) OVER w nxt, count(*) OVER (PARTITION BY dataset,b_id) pair_count FROM p WINDOW w AS (PARTITION BY dataset,b_id ORDER BY residual,max_step,a_id,c_id))
SELECT dataset, t, a_id, b_id, c_id, residual, coalesce(nxt,'inf'::double)-residual margin, max_step, abs(ab-bc)/greatest(ab,bc,1e-12::double) step_balance, CASE WHEN ab*bc>0 THEN degrees(acos(least(greatest(dp/(ab*bc),-1.0::double),1.0::double))) ELSE 'nan'::double END turn, pair_count FROM r WHERE rk=1)"""
STRICT = f"""(SELECT * EXCLUDE (au,cu) FROM (SELECT *, count(*) OVER (PARTITION BY dataset,a_id) au, count(*) OVER (PARTITION BY dataset,c_id) cu FROM {BRIDGE} z WHERE residual<=4 AND max_step<=8 AND step_balance<=0.5 AND turn<=60) WHERE au=1 AND cu=1 AND pair_count=1)"""


@query(f"SELECT dataset, t, a_id, b_id, c_id, {ROUND}, pair_count FROM {BRIDGE} z")
def bridge_census(spark, d):
    return shown(policies.bridge_census(*graph(spark, d)))


@query(f"SELECT dataset, t, a_id, b_id, c_id, {ROUND}, pair_count FROM {STRICT} z")
def strict_bridge_policy(spark, d):
    return shown(policies.strict_bridges(policies.bridge_census(*graph(spark, d))))


PROPOSED = f"""(SELECT DISTINCT dataset, source_id, target_id FROM (SELECT * FROM {MUTUAL} z UNION ALL SELECT dataset, a_id, b_id FROM {BRIDGE} z UNION ALL SELECT dataset, source_id, target_id FROM edges WHERE source_id%50=7
 UNION ALL SELECT dataset, source_id, target_id+5 FROM edges WHERE source_id%50=3))"""
TRIED = f"""(SELECT m.*, CASE WHEN s.node_id IS NULL OR t.node_id IS NULL THEN 'missing_endpoint' WHEN e.edge_id IS NOT NULL THEN 'existing_edge' WHEN o.node_id IS NOT NULL OR i.node_id IS NOT NULL THEN 'degree_conflict' END reason
 FROM {PROPOSED} m LEFT JOIN nodes s ON s.dataset=m.dataset AND s.node_id=m.source_id LEFT JOIN nodes t ON t.dataset=m.dataset AND t.node_id=m.target_id LEFT JOIN edges e ON e.dataset=m.dataset AND e.source_id=m.source_id AND e.target_id=m.target_id
 LEFT JOIN outd o ON o.dataset=m.dataset AND o.node_id=m.source_id LEFT JOIN ind i ON i.dataset=m.dataset AND i.node_id=m.target_id)"""
FREE = f"SELECT dataset, source_id, target_id, (source_id, target_id) AS ord, ['o' || source_id, 'i' || target_id] res FROM {TRIED} z WHERE reason IS NULL"


@query(f"SELECT t.dataset, t.source_id, t.target_id, coalesce(t.reason, CASE WHEN g.ok THEN 'added' ELSE 'degree_conflict' END) reason FROM {TRIED} t LEFT JOIN {oracle.greedy(FREE)} g USING (dataset,source_id,target_id)")
def apply_repairs(spark, d):
    """The mutual policy's edges, rivals of them (first halves of bridges) and proposals that must be refused, each with its outcome."""
    n, e = saved_graph(spark, d)
    m = policies.mutual_policy(policies.gap_census(n, e, residual=5.0))
    rivals = policies.bridge_census(n, e).select("dataset", F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"))
    more = e.where("source_id % 50 = 7").select("dataset", "source_id", "target_id").unionByName(e.where("source_id % 50 = 3").select("dataset", "source_id", (F.col("target_id") + 5).alias("target_id")))
    return policies.repair_reasons(m.unionByName(rivals).unionByName(more).distinct(), n, e)


def on(sql: str, stage: str) -> str:
    """SQL over nodes, edges and degrees of the raw graph, over those of another stage."""
    return re.sub(r"\b(nodes|edges|deg)\b", lambda m: stage + m[1], sql)


oracle.VIEWS["single9"] = f"SELECT * FROM {on(MUTUAL, 'k9')} z"
oracle.VIEWS["fedges"] = "SELECT dataset, source_id, target_id FROM k9edges UNION ALL SELECT dataset, source_id, target_id FROM single9"


def bridged(strict: str, edges: str) -> str:
    """Bridges with the outcome of a loop by t and middle over a graph's edges."""
    return f"""(WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, b_id) i FROM (SELECT b.*, EXISTS (SELECT 1 FROM {edges} e WHERE e.dataset=b.dataset AND ((e.source_id=a_id AND e.target_id=b_id) OR (e.source_id=b_id AND e.target_id=c_id))) there,
  EXISTS (SELECT 1 FROM {edges} e WHERE e.dataset=b.dataset AND (e.source_id IN (a_id,b_id) OR e.target_id IN (b_id,c_id))) busy FROM {strict} b)),
 r AS (SELECT DISTINCT dataset, 0::bigint AS i, []::varchar[] AS used, []::varchar[] AS made, '' AS reason FROM s UNION ALL
  SELECT dataset, i, CASE WHEN reason='added' THEN list_concat(used, res) ELSE used END, CASE WHEN reason='added' THEN list_concat(made, two) ELSE made END, reason FROM
  (SELECT r.dataset, s.i, r.used, r.made, ['o'||a_id,'i'||b_id,'o'||b_id,'i'||c_id] AS res, [a_id||'>'||b_id, b_id||'>'||c_id] AS two, CASE WHEN there OR list_has_any(made, [a_id||'>'||b_id, b_id||'>'||c_id]) THEN 'existing_edge' WHEN busy OR list_has_any(used, ['o'||a_id,'i'||b_id,'o'||b_id,'i'||c_id]) THEN 'degree_conflict' ELSE 'added' END AS reason
   FROM r JOIN s ON s.dataset=r.dataset AND s.i=r.i+1))
 SELECT s.dataset, s.t, s.a_id, s.b_id, s.c_id, r.reason FROM r JOIN s USING (dataset,i))"""


oracle.VIEWS["strict9"] = f"SELECT * FROM {on(STRICT, 'k9')} z"
oracle.VIEWS["bridged"] = f"SELECT * FROM {bridged('strict9', 'fedges')} z"
oracle.VIEWS["bridgedfirst"] = f"SELECT * FROM {bridged('strict9', 'k9edges')} z"
oracle.MATERIALIZED |= {"bridgedfirst", "strict9", "e5", "e5deg", "g2kept", "g2_edges"}
oracle.VIEWS["e5"] = "SELECT * FROM fedges UNION ALL SELECT dataset, unnest([a_id,b_id]), unnest([b_id,c_id]) FROM bridged WHERE reason='added'"
oracle.VIEWS["e5deg"] = "SELECT n.*, coalesce(k,0) links FROM k9nodes n LEFT JOIN (SELECT dataset, node_id, count(*) k FROM (SELECT dataset, unnest([source_id,target_id]) node_id FROM e5) GROUP BY ALL) USING (dataset,node_id)"
oracle.VIEWS["longpair"] = """SELECT e.dataset, unnest([e.source_id,e.target_id]) node_id FROM e5 e JOIN e5deg a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN e5deg b ON b.dataset=e.dataset AND b.node_id=e.target_id
 WHERE a.links=1 AND b.links=1 AND sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux))>3.5"""
oracle.VIEWS["frozen_nodes"] = "SELECT n.* FROM e5deg n ANTI JOIN longpair l USING (dataset,node_id) WHERE links>0"
oracle.VIEWS["frozen_edges"] = "SELECT e.* FROM e5 e JOIN frozen_nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN frozen_nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id"


@query(f"SELECT dataset, t, a_id, b_id, c_id, reason FROM {bridged(STRICT, 'edges')} z")
def apply_bridges(spark, d):
    """Strict bridges of the raw graph, tried in order, with their outcome."""
    n, e = graph(spark, d)
    n, e = save(n), save(e)
    return policies.bridge_reasons(policies.strict_bridges(policies.bridge_census(n, e)), n, e)


@query("SELECT m.dataset, m.source_id, m.target_id, round(sqrt((b.z-a.z)*(b.z-a.z)+(b.y-a.y)*(b.y-a.y)/16+(b.x-a.x)*(b.x-a.x)/16),6) edge_dist FROM single9 m JOIN nodes a ON a.dataset=m.dataset AND a.node_id=m.source_id JOIN nodes b ON b.dataset=m.dataset AND b.node_id=m.target_id")
def recovered_distance(spark, d):
    """Lengths on the model's grid of the edges that single-edge repair adds."""
    n, e = graph(spark, d)
    n3 = save(policies.confidence_pruning(n, e2 := policies.division_filter(n, e)))
    e3 = save(policies.keep_edges(e2, n3))
    m = policies.mutual_policy(policies.gap_census(n3, e3, residual=5.0))
    return rounded(policies.added_edges(m, n3), "edge_dist").select("dataset", "source_id", "target_id", "edge_dist")


@query("""SELECT n.dataset, n.node_id FROM deg n WHERE in_degree+out_degree>0 AND (dataset,node_id) NOT IN (
 SELECT (dataset, unnest([source_id,target_id])) FROM (SELECT e.dataset, e.source_id, e.target_id FROM edges e JOIN deg a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN deg b ON b.dataset=e.dataset AND b.node_id=e.target_id
 WHERE a.in_degree+a.out_degree=1 AND b.in_degree+b.out_degree=1 AND sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux))>3.5))""")
def component_cleanup(spark, d):
    return policies.component_cleanup(*graph(spark, d)).select("dataset", "node_id")


@query(f"SELECT (SELECT count(*) FROM {GAP} z) single_census, (SELECT count(*) FROM {MUTUAL} z) single_policy, (SELECT count(*) FROM {BRIDGE} z) bridge_census, (SELECT count(*) FROM {STRICT} z) bridge_policy")
def policy_counts(spark, d):
    n, e = saved_graph(spark, d)
    gaps, bridges = save(policies.gap_census(n, e)), save(policies.bridge_census(n, e))
    parts = [("single_census", gaps), ("single_policy", policies.mutual_policy(gaps)), ("bridge_census", bridges), ("bridge_policy", policies.strict_bridges(bridges))]
    tall = None
    for k, df in parts:
        one = df.select(F.lit(k).alias("k"))
        tall = one if tall is None else tall.unionByName(one)
    return tall.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k, _ in parts])


@query("""SELECT min_size, dataset, count(*) FILTER (WHERE size>=min_size) nodes_kept, count(*) FILTER (WHERE size<min_size) nodes_removed FROM comp JOIN compsize USING (dataset,component), (VALUES (1),(2),(3),(4),(5)) m(min_size) GROUP BY ALL""")
def min_component_sweep(spark, d):
    s = policies.with_component_size(*graph(spark, d)).groupBy("dataset", "size").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("min_size", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    return s.groupBy("min_size", "dataset").agg(F.sum(F.when(F.col("size") >= F.col("min_size"), F.col("n")).otherwise(0)).alias("nodes_kept"), F.sum(F.when(F.col("size") < F.col("min_size"), F.col("n")).otherwise(0)).alias("nodes_removed"))


@query("""SELECT dataset, node_id FROM deg JOIN comp USING (dataset,node_id) JOIN compsize USING (dataset,component) WHERE NOT (size>4 AND in_degree+out_degree=1 AND NOT high_conf)""")
def endpoint_trim(spark, d):
    n, e = graph(spark, d)
    s = topology.degrees(policies.with_component_size(n, e), e)
    return s.where("NOT (size > 4 AND in_degree + out_degree = 1 AND NOT high_conf)").select("dataset", "node_id")


MISSING = """(WITH ae AS (SELECT e.dataset, p.node_id p_id, a.node_id a_id, a.t, 3*a.uz-2*p.uz fz, 3*a.uy-2*p.uy fy, 3*a.ux-2*p.ux fx, a.uz-p.uz vz, a.uy-p.uy vy, a.ux-p.ux vx FROM edges e JOIN nodes p ON p.dataset=e.dataset AND p.node_id=e.source_id JOIN deg a ON a.dataset=e.dataset AND a.node_id=e.target_id WHERE a.out_degree=0 AND a.t=p.t+1),
ce AS (SELECT e.dataset, c.node_id c_id, q.node_id d_id, c.t, c.uz cz, c.uy cy, c.ux cx, 3*c.uz-2*q.uz gz, 3*c.uy-2*q.uy gy, 3*c.ux-2*q.ux gx, q.uz-c.uz wz, q.uy-c.uy wy, q.ux-c.ux wx FROM edges e JOIN deg c ON c.dataset=e.dataset AND c.node_id=e.source_id JOIN nodes q ON q.dataset=e.dataset AND q.node_id=e.target_id WHERE c.in_degree=0 AND c.out_degree=1 AND q.t=c.t+1),
j AS (SELECT ae.*, c_id, d_id, sqrt((fz-cz)*(fz-cz)+(fy-cy)*(fy-cy)+(fx-cx)*(fx-cx)) forward, sqrt((gz-a.uz)*(gz-a.uz)+(gy-a.uy)*(gy-a.uy)+(gx-a.ux)*(gx-a.ux)) backward, (a.uz+vz+cz-wz)/2 mz, (a.uy+vy+cy-wy)/2 my, (a.ux+vx+cx-wx)/2 mx, vz*wz+vy*wy+vx*wx dp, sqrt(vz*vz+vy*vy+vx*vx)*sqrt(wz*wz+wy*wy+wx*wx) ll
 FROM ae JOIN ce ON ce.dataset=ae.dataset AND ce.t=ae.t+2 JOIN nodes a ON a.dataset=ae.dataset AND a.node_id=ae.a_id)
SELECT dataset, p_id, a_id, c_id, d_id, t+1 t, forward, backward, mz, my, mx, CASE WHEN ll>0 THEN degrees(acos(least(greatest(dp/ll,-1.0::double),1.0::double))) ELSE 0 END angle FROM j WHERE forward<=8 AND backward<=8)"""


def missing_nodes(n, e):
    """Track ends A and starts C two frames apart which constant motion joins from both sides within 8 um: the place between on which both agree, and the angle of the two velocities."""
    deg = topology.degrees(n, e)
    at = lambda df, k, p: df.select("dataset", F.col("node_id").alias(k), F.col("t").alias(f"{p}t"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    v = lambda p: tuple(F.col(f"{p}{u}") for u in g.AXES)
    ends = e.join(at(n, "source_id", "p"), ["dataset", "source_id"]).join(at(deg.where("out_degree = 0"), "target_id", "a"), ["dataset", "target_id"]).where("at = pt + 1")
    a = ends.select("dataset", (F.col("at") + 2).alias("t"), F.col("source_id").alias("p_id"), F.col("target_id").alias("a_id"), *[(3 * F.col(f"a{u}") - 2 * F.col(f"p{u}")).alias(u) for u in g.AXES], *[F.col(f"a{u}").alias(f"A{u}") for u in g.AXES], *[F.col(f"p{u}").alias(f"P{u}") for u in g.AXES])
    begins = e.join(at(deg.where("in_degree = 0 AND out_degree = 1"), "source_id", "c"), ["dataset", "source_id"]).join(at(n, "target_id", "q"), ["dataset", "target_id"]).where("qt = ct + 1")
    c = begins.select("dataset", F.col("ct").alias("t"), F.col("source_id").alias("c_id"), F.col("target_id").alias("d_id"), *[F.col(f"c{u}").alias(u) for u in g.AXES], *[F.col(f"c{u}").alias(f"C{u}") for u in g.AXES], *[F.col(f"q{u}").alias(f"D{u}") for u in g.AXES])
    j = spatial.within(a, c, ["dataset", "t"], 8.0).withColumnRenamed("dist", "forward")
    back = g.sub(g.sub(g.times(v("C"), 3.0), g.times(v("D"), 2.0)), v("A"))
    past, future = g.sub(v("A"), v("P")), g.sub(v("D"), v("C"))
    mid = g.times(g.add(g.add(v("A"), past), g.sub(v("C"), future)), 0.5)
    j = j.withColumns({"backward": g.norm(back), "angle": F.nanvl(g.angle(past, future), F.lit(0.0)), **{f"m{u[1]}": x for u, x in zip(g.AXES, mid, strict=True)}}).where("backward <= 8")
    return j.select("dataset", "p_id", "a_id", "c_id", "d_id", (F.col("t") - 1).alias("t"), "forward", "backward", "mz", "my", "mx", "angle")


@query(f"SELECT q.dataset, q.p_id, q.a_id, q.c_id, q.d_id, round(q.forward,6) forward, round(q.backward,6) backward, round(q.mz,6) mz, round(q.my,6) my, round(q.mx,6) mx, round(q.angle,4) angle, coalesce(round((SELECT min(sqrt(power(n.uz-q.mz,2)+power(n.uy-q.my,2)+power(n.ux-q.mx,2))) FROM nodes n WHERE n.dataset=q.dataset AND n.t=q.t AND sqrt(power(n.uz-q.mz,2)+power(n.uy-q.my,2)+power(n.ux-q.mx,2))<=8),6),-1) nearest FROM {MISSING} q")
def missing_node_census(spark, d):
    """Candidates for a missing middle, with the nearest detection (within 8 um) to the place that they agree on."""
    n, e = saved_graph(spark, d)
    z = save(missing_nodes(n, e))
    key = ["dataset", "a_id", "c_id", "p_id", "d_id"]
    probe = z.select(*key, "t", F.col("mz").alias("uz"), F.col("my").alias("uy"), F.col("mx").alias("ux"))
    near = spatial.within(probe, n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], 8.0).groupBy(*key).agg(F.round(F.min("dist"), 6).alias("nearest"))
    out = rounded(rounded(z, "forward", "backward", "mz", "my", "mx"), "angle", digits=4).drop("t").join(near, key, "left").fillna(-1.0, ["nearest"])
    return out


def frozen(n: DataFrame, e: DataFrame) -> tuple[list, DataFrame, DataFrame]:
    """The whole chain: stages (name, nodes, edges), and the outcomes of single edges and of bridges.

    Both censuses are taken from the graph after division filter and pruning; edges that single repair adds can make a bridge impossible.
    """
    stages = [("raw", n, e)]
    e2 = policies.division_filter(n, e)
    stages.append(("division_filter", n, e2))
    n3 = save(policies.confidence_pruning(n, e2))
    e3 = save(policies.keep_edges(e2, n3))
    stages.append(("confidence_pruning", n3, e3))
    bridges = policies.strict_bridges(policies.bridge_census(n3, e3))
    single = save(policies.repair_reasons(policies.mutual_policy(policies.gap_census(n3, e3, residual=5.0)), n3, e3))
    e4 = save(policies.with_edges(e3, single.where("reason = 'added'").drop("reason"), n3))
    stages.append(("single_edges", n3, e4))
    two = save(policies.bridge_reasons(bridges, n3, e4))
    e5 = save(policies.with_edges(e4, policies.bridge_edges(two.where("reason = 'added'")), n3))
    stages.append(("bridges", n3, e5))
    n6 = save(policies.component_cleanup(n3, e5))
    stages.append(("cleanup", n6, save(policies.keep_edges(e5, n6))))
    return stages, single, two


def saved_graph(spark, d):
    n, e = graph(spark, d)
    n = save(n)
    return n, save(tracks.edges(n))


COUNTED = [("raw_nodes", "nodes"), ("raw_edges", "edges"), ("division_filter_edges", "g2_edges"), ("confidence_pruning_nodes", "k9nodes"), ("confidence_pruning_edges", "k9edges"), ("single_edges_edges", "fedges"), ("bridges_edges", "e5"), ("cleanup_nodes", "frozen_nodes"), ("cleanup_edges", "frozen_edges")]
OUTCOMES = [("single_added", "single9", "true"), ("two_requested", "bridged", "true"), ("two_added", "bridged", "reason='added'"), ("two_degree_conflict", "bridged", "reason='degree_conflict'"), ("two_existing_edge", "bridged", "reason='existing_edge'")]


@query("SELECT d.dataset, " + ", ".join(f"coalesce({k}.n,0) {k}" for k, *_ in [*COUNTED, *OUTCOMES]) + " FROM datasets d " + " ".join(f"LEFT JOIN (SELECT dataset, count(*) n FROM {v} WHERE {w} GROUP BY 1) {k} ON {k}.dataset=d.dataset" for k, v, w in [*[(k, v, "true") for k, v in COUNTED], *OUTCOMES]))
def frozen_pipeline(spark, d):
    """Nodes and edges per dataset after each stage of the frozen chain, and what became of the repairs, side by side."""
    stages, single, two = frozen(*saved_graph(spark, d))
    tables = {f"{name}_{kind}": df for name, n, e in stages for kind, df in (("nodes", n), ("edges", e))}
    tall = None
    for k, _ in COUNTED:
        one = tables[k].select("dataset", F.lit(k).alias("k"))
        tall = one if tall is None else tall.unionByName(one)
    tall = tall.unionByName(single.where("reason = 'added'").select("dataset", F.lit("single_added").alias("k"))).unionByName(two.select("dataset", F.lit("two_requested").alias("k")))
    label = F.when(F.col("reason") == "added", "two_added").when(F.col("reason") == "degree_conflict", "two_degree_conflict").otherwise("two_existing_edge")
    tall = tall.unionByName(two.select("dataset", label.alias("k")))
    return tall.groupBy("dataset").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in [*[k for k, _ in COUNTED], *[k for k, *_ in OUTCOMES]]])


SURVIVAL = [("raw", "edges"), ("division_filter", "g2_edges"), ("confidence_pruning", "k9edges"), ("single_edges", "fedges"), ("bridges", "e5"), ("cleanup", "frozen_edges")]


@query(" UNION ALL ".join(f"SELECT '{k}' stage, count(*) forks, count(p.accepted) FILTER (WHERE p.accepted) of_accepted FROM (SELECT dataset, source_id FROM {v} GROUP BY ALL HAVING count(*)=2) f LEFT JOIN passing p USING (dataset,source_id)" for k, v in SURVIVAL))
def stage_survival(spark, d):
    """Forks after each of the six stages, and how many of them are forks of the raw graph that the division filter accepts."""
    n, e = saved_graph(spark, d)
    stages, *_ = frozen(n, e)
    accepted = save(policies.division_candidates(policies.fork_geometry(n, e)).where("accepted").select("dataset", "source_id", F.lit(1).alias("a")))
    tall = None
    for name, _, edges in stages:
        one = edges.groupBy("dataset", "source_id").count().where("count = 2").select("dataset", "source_id", F.lit(name).alias("stage"))
        tall = one if tall is None else tall.unionByName(one)
    every = tall.join(accepted, ["dataset", "source_id"], "left")
    names = spark.createDataFrame([(k,) for k, _ in SURVIVAL], "stage string")  # a stage without forks keeps a zero
    return names.join(every.groupBy("stage").agg(F.count(F.lit(1)).alias("forks"), F.count("a").alias("of_accepted")), "stage", "left").fillna(0)


@query("SELECT o.ordering, o.dataset, sum(o.singles)::bigint singles, sum(o.bridges)::bigint bridges FROM (SELECT 'single_first' ordering, dataset, count(*) singles, 0 bridges FROM single9 GROUP BY ALL UNION ALL SELECT 'single_first', dataset, 0, count(*) FROM bridged WHERE reason='added' GROUP BY ALL UNION ALL SELECT 'bridge_first', dataset, 0, count(*) FROM bridgedfirst WHERE reason='added' GROUP BY ALL UNION ALL SELECT 'bridge_first', m.dataset, count(*), 0 FROM single9 m WHERE NOT EXISTS (SELECT 1 FROM bridgedfirst b WHERE b.reason='added' AND b.dataset=m.dataset AND (m.source_id IN (a_id,b_id) OR m.target_id IN (b_id,c_id))) GROUP BY ALL) o GROUP BY ALL")
def repair_order(spark, d):
    """What each repair adds, by which of them comes first."""
    n, e = saved_graph(spark, d)
    n3 = save(policies.confidence_pruning(n, e2 := policies.division_filter(n, e)))
    e3 = save(policies.keep_edges(e2, n3))
    single = save(policies.mutual_policy(policies.gap_census(n3, e3, residual=5.0)))
    bridges = save(policies.strict_bridges(policies.bridge_census(n3, e3)))
    added = lambda r: r.where("reason = 'added'")
    s1 = added(policies.repair_reasons(single, n3, e3))
    b1 = added(policies.bridge_reasons(bridges, n3, policies.with_edges(e3, s1.drop("reason"), n3)))
    b2 = save(added(policies.bridge_reasons(bridges, n3, e3)))
    s2 = added(policies.repair_reasons(single, n3, policies.with_edges(e3, policies.bridge_edges(b2), n3)))
    tall = None
    for order, kind, df in (("single_first", "singles", s1), ("single_first", "bridges", b1), ("bridge_first", "singles", s2), ("bridge_first", "bridges", b2)):
        one = df.select(F.lit(order).alias("ordering"), "dataset", F.lit(kind).alias("kind"))
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy("ordering", "dataset").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("singles", "bridges")])


