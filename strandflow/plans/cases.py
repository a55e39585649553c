"""Queries over single cases: missed links with their rivals, oracles of repairs, gates counterfactual, score features, peaks and motion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import association as A
from strandflow.operators import detection, policies, spatial
from strandflow.plans import divisions, oracle  # noqa: F401  (its views)
from strandflow.plans.association import COL, PAIR, ROW, P
from strandflow.plans.detection import AT
from strandflow.plans.evaluation import MISS, Study, missed
from strandflow.plans.graph import GM, gt, moves
from strandflow.plans.policies import BRIDGE, MISSING, MUTUAL, graph, rounded, saved_graph
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save

V = oracle.VIEWS
_FAR = "sqrt(({0}.uz-{1}.uz)*({0}.uz-{1}.uz)+({0}.uy-{1}.uy)*({0}.uy-{1}.uy)+({0}.ux-{1}.ux)*({0}.ux-{1}.ux))"
V["cases"] = f"""SELECT m.dataset, m.source_id, m.target_id, m.ps, m.pt, {_FAR.format('a', 'b')} dist, coalesce(i.rivals,'') in_rivals, coalesce(o.rivals,'') out_rivals, CASE WHEN i.rivals IS NOT NULL THEN 'claimed_by_competitor' WHEN coalesce(o.n,0)>=2 THEN 'unclaimed_at_cap' ELSE 'unclaimed_below_cap' END status,
 CASE WHEN p.prob IS NULL THEN 'other' WHEN p.rank=1 AND p.prob<=0.5 THEN 'threshold' WHEN p.rank=1 THEN 'degree' WHEN p.margin<0.20 THEN 'competitor' ELSE 'model' END cause FROM (SELECT * FROM {MISS} z WHERE cause='linking') m JOIN nodes a ON a.dataset=m.dataset AND a.node_id=m.ps JOIN nodes b ON b.dataset=m.dataset AND b.node_id=m.pt
 LEFT JOIN (SELECT dataset, target_id node_id, string_agg(source_id::varchar, ',' ORDER BY source_id) rivals FROM edges GROUP BY ALL) i ON i.dataset=m.dataset AND i.node_id=m.pt LEFT JOIN (SELECT dataset, source_id node_id, count(*) n, string_agg(target_id::varchar, ',' ORDER BY target_id) rivals FROM edges GROUP BY ALL) o ON o.dataset=m.dataset AND o.node_id=m.ps
 LEFT JOIN (SELECT *, row_number() OVER w rank, first_value(prob) OVER w - prob margin FROM probs WINDOW w AS ({COL} ORDER BY prob DESC, source_id)) p ON p.dataset=m.dataset AND p.source_id=m.ps AND p.target_id=m.pt"""
#: Geometry of annotated divisions, as the detections that were found would restore them and as annotated; what stands in the way of the first.
_PLACES = {"restored": "(SELECT m.dataset, m.gt_id, n.uz, n.uy, n.ux FROM matches m JOIN nodes n ON n.dataset=m.dataset AND n.node_id=m.node_id)", "annotated": "(SELECT dataset, node_id gt_id, uz, uy, ux FROM gt_nodes)"}
for _k, _at in _PLACES.items():
    V[f"{_k}fork"] = f"""SELECT dataset, parent, sep, CASE WHEN d1*d2>0 THEN degrees(acos(least(greatest(dp/(d1*d2),-1.0::double),1.0::double))) ELSE 'nan'::double END angle, greatest(d1,d2) arm, abs(d1-d2)/greatest(d1+d2,1e-12::double) balance FROM
 (SELECT dataset, parent, sqrt(az*az+ay*ay+ax*ax) d1, sqrt(bz*bz+byy*byy+bx*bx) d2, sqrt((az-bz)*(az-bz)+(ay-byy)*(ay-byy)+(ax-bx)*(ax-bx)) sep, az*bz+ay*byy+ax*bx dp FROM (SELECT g.dataset, g.parent, a.uz-p.uz az, a.uy-p.uy ay, a.ux-p.ux ax, b.uz-p.uz bz, b.uy-p.uy byy, b.ux-p.ux bx
  FROM gdiv g JOIN {_at} p ON p.dataset=g.dataset AND p.gt_id=g.parent JOIN {_at} a ON a.dataset=g.dataset AND a.gt_id=g.g1 JOIN {_at} b ON b.dataset=g.dataset AND b.gt_id=g.g2))"""
oracle.MATERIALIZED |= {"cases", "oraclediv", "restoredfork", "annotatedfork"}
SHAPE = ("sep", "angle", "arm", "balance")
_PASSES = "({0}.sep>=6 AND NOT isnan({0}.angle) AND {0}.angle>=120 AND {0}.arm<=8 AND {0}.balance<=0.5)"
_SHAPES = ", ".join(f"round(coalesce({k[0]}.{c},-99),6) {k}_{c}" for k in _PLACES for c in SHAPE)


def case_rows(s: Study):
    """Annotated links whose ends were found but not linked: the links that took their place, the distance, and why."""
    m = missed(s).where("cause = 'linking'").drop("cause")
    names = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ",")
    i = s.edges.groupBy("dataset", F.col("target_id").alias("pt")).agg(names("source_id").alias("in_rivals"))
    o = s.edges.groupBy("dataset", F.col("source_id").alias("ps")).agg(names("target_id").alias("out_rivals"), F.count(F.lit(1)).alias("n"))
    at = lambda k, p: s.nodes.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    p = A.column_stats(A.column_softmax(tracks.pair_scores(s.nodes))).select("dataset", F.col("source_id").alias("ps"), F.col("target_id").alias("pt"), "prob", "rank", "margin")
    j = m.join(i, ["dataset", "pt"], "left").join(o, ["dataset", "ps"], "left").join(at("ps", "a"), ["dataset", "ps"]).join(at("pt", "b"), ["dataset", "pt"]).join(p, ["dataset", "ps", "pt"], "left")
    status = F.when(F.col("in_rivals").isNotNull(), "claimed_by_competitor").when(F.col("n") >= 2, "unclaimed_at_cap").otherwise("unclaimed_below_cap")
    cause = F.when(F.col("prob").isNull(), "other").when((F.col("rank") == 1) & (F.col("prob") <= 0.5), "threshold").when(F.col("rank") == 1, "degree").when(F.col("margin") < 0.20, "competitor").otherwise("model")
    dist = g.norm(tuple(F.col(f"a{u}") - F.col(f"b{u}") for u in g.AXES))
    return j.select("dataset", "source_id", "target_id", "ps", "pt", dist.alias("dist"), F.coalesce("in_rivals", F.lit("")).alias("in_rivals"), F.coalesce("out_rivals", F.lit("")).alias("out_rivals"), status.alias("status"), cause.alias("cause"))


def with_forks(rows, s: Study):
    """Cases of links of annotated divisions with the geometry of the fork that putting all its links in would restore, that of the annotated fork, and what stands in the way:
    the association only, the division gate too, or a daughter that was not found. Other links have -99 and no blocker."""
    forks = s.gt_edges.groupBy("dataset", F.col("source_id").alias("parent")).agg(F.min("target_id").alias("g1"), F.max("target_id").alias("g2"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    forks = save(forks)
    found = s.matches.select("dataset", "gt_id", "node_id").join(s.nodes.select("dataset", "node_id", *g.AXES), ["dataset", "node_id"]).drop("node_id")
    out = rows.join(forks.select("dataset", F.col("parent").alias("source_id"), F.lit(True).alias("division")), ["dataset", "source_id"], "left")
    for name, at in (("restored", found), ("annotated", s.gt_nodes.select("dataset", F.col("node_id").alias("gt_id"), *g.AXES))):
        f = forks
        for k in ("parent", "g1", "g2"):
            f = f.join(at.select("dataset", F.col("gt_id").alias(k), *[F.col(u).alias(f"{k}_{u}") for u in g.AXES]), ["dataset", k])
        v = lambda k: tuple(F.col(f"{k}_{u}") for u in g.AXES)
        a, b = g.sub(v("g1"), v("parent")), g.sub(v("g2"), v("parent"))
        d1, d2 = g.norm(a), g.norm(b)
        f = f.select("dataset", F.col("parent").alias("source_id"), g.norm(g.sub(v("g1"), v("g2"))).alias("sep"), g.angle(a, b).alias("angle"), F.greatest(d1, d2).alias("arm"), g.division_balance(d1, d2).alias("balance"))
        geometry = [ok for k, ok in policies.gates().items() if k != "p2_ok"]  # a link that isn't there has no probability
        passes = geometry[0] & geometry[1] & geometry[2] & geometry[3]
        out = out.join(f.select("dataset", "source_id", *[F.col(c).alias(f"{name}_{c}") for c in SHAPE], passes.alias(f"{name}_passes")), ["dataset", "source_id"], "left")
    blocker = F.when(F.col("division").isNull(), "").when(F.col("restored_passes").isNull(), "daughter_not_found").when(F.col("restored_passes"), "association_only").otherwise("g2_geometry")
    both = F.coalesce(F.col("restored_passes") & F.col("annotated_passes"), F.lit(False))
    shapes = [F.coalesce(f"{k}_{c}", F.lit(-99.0)).alias(f"{k}_{c}") for k in _PLACES for c in SHAPE]
    return out.select(*rows.columns, *shapes, blocker.alias("blocker"), both.alias("association_only_and_annotation_passes"))


@query(f"""SELECT c.dataset, source_id, target_id, ps, pt, round(dist,6) dist, in_rivals, out_rivals, status, cause, {_SHAPES}, CASE WHEN g.parent IS NULL THEN '' WHEN r.parent IS NULL THEN 'daughter_not_found' WHEN {_PASSES.format('r')} THEN 'association_only' ELSE 'g2_geometry' END blocker,
 coalesce({_PASSES.format('r')} AND {_PASSES.format('a')},false) association_only_and_annotation_passes FROM cases c LEFT JOIN gdiv g ON g.dataset=c.dataset AND g.parent=c.source_id LEFT JOIN restoredfork r ON r.dataset=c.dataset AND r.parent=c.source_id LEFT JOIN annotatedfork a ON a.dataset=c.dataset AND a.parent=c.source_id""")
def association_cases(spark, d):
    s = Study(spark, d)
    return rounded(with_forks(case_rows(s), s), "dist", *[f"{k}_{c}" for k in _PLACES for c in SHAPE])


@query("SELECT kind, label, count(*) n, count(*) FILTER (WHERE list_contains(string_split(in_rivals,','), '')) without_rival FROM (SELECT unnest(['status','cause']) kind, unnest([status,cause]) label, in_rivals FROM cases) GROUP BY ALL")
def association_case_summary(spark, d):
    """Cases by status and by cause, both unpivoted, and how many have no rival into their target."""
    c = case_rows(Study(spark, d)).select("in_rivals", "status", "cause").unpivot(["in_rivals"], ["status", "cause"], "kind", "label")
    return c.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.array_contains(F.split("in_rivals", ","), ""), 1)).alias("without_rival"))


@query(f"""SELECT scope, count(*) n, count(*) FILTER (WHERE a.gt_id IS NOT NULL AND b.gt_id IS NOT NULL) observable, count(g.source_id) correct, count(*) FILTER (WHERE u=1 AND w=1) conflict_free FROM (SELECT *, count(*) OVER (PARTITION BY scope,dataset,source_id) u, count(*) OVER (PARTITION BY scope,dataset,target_id) w FROM
 (SELECT unnest(['single','all']) AS scope, dataset, source_id, target_id FROM {MUTUAL} z UNION ALL SELECT unnest(['bridge','all']), dataset, unnest([a_id,a_id]), unnest([b_id,b_id]) FROM {BRIDGE} z WHERE residual<=4 UNION ALL SELECT unnest(['bridge','all']), dataset, unnest([b_id,b_id]), unnest([c_id,c_id]) FROM {BRIDGE} z WHERE residual<=4)) p
 LEFT JOIN matches a ON a.dataset=p.dataset AND a.node_id=p.source_id LEFT JOIN matches b ON b.dataset=p.dataset AND b.node_id=p.target_id LEFT JOIN gt_edges g ON g.dataset=p.dataset AND g.source_id=a.gt_id AND g.target_id=b.gt_id GROUP BY 1""")
def repair_oracle(spark, d):
    """Proposed links by scope: at how many the annotation can look, how many it confirms, how many meet no rival."""
    s = Study(spark, d)
    single = policies.mutual_policy(policies.gap_census(s.nodes, s.edges, residual=5.0)).withColumn("scope", F.lit("single"))
    bridge = policies.bridge_edges(policies.bridge_census(s.nodes, s.edges).where("residual <= 4")).withColumn("scope", F.lit("bridge"))
    p = single.unionByName(bridge).withColumn("scope", F.explode(F.array("scope", F.lit("all"))))
    per = lambda k: F.count(F.lit(1)).over(Window.partitionBy("scope", "dataset", k))
    p = p.withColumns({"u": per("source_id"), "w": per("target_id")})
    m = s.matches
    p = p.join(m.select("dataset", F.col("node_id").alias("source_id"), F.col("gt_id").alias("gs")), ["dataset", "source_id"], "left").join(m.select("dataset", F.col("node_id").alias("target_id"), F.col("gt_id").alias("gg")), ["dataset", "target_id"], "left")
    p = p.join(s.gt_edges.select("dataset", F.col("source_id").alias("gs"), F.col("target_id").alias("gg"), F.lit(1).alias("hit")), ["dataset", "gs", "gg"], "left")
    n = lambda c, k: F.count(F.when(F.expr(c), 1)).alias(k)
    return p.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), n("gs IS NOT NULL AND gg IS NOT NULL", "observable"), F.count("hit").alias("correct"), n("u = 1 AND w = 1", "conflict_free"))


@query(f"""SELECT verdict, count(*) n FROM (SELECT CASE WHEN p.dataset IS NOT NULL THEN 'POSITIVE' WHEN a.gt_id IS NOT NULL AND (c.gt_id IS NOT NULL OR k.gt_id IS NOT NULL) THEN 'EXPLICIT_NEGATIVE' ELSE 'UNRESOLVED' END verdict FROM {MISSING} z LEFT JOIN matches a ON a.dataset=z.dataset AND a.node_id=z.a_id LEFT JOIN matches c ON c.dataset=z.dataset AND c.node_id=z.c_id
 LEFT JOIN (SELECT x.dataset, x.source_id s, y.target_id t FROM gt_edges x JOIN gt_edges y ON y.dataset=x.dataset AND y.source_id=x.target_id) p ON p.dataset=z.dataset AND p.s=a.gt_id AND p.t=c.gt_id LEFT JOIN (SELECT DISTINCT x.dataset, x.source_id gt_id FROM gt_edges x JOIN gt_edges y ON y.dataset=x.dataset AND y.source_id=x.target_id) k ON k.dataset=a.dataset AND k.gt_id=a.gt_id) GROUP BY 1""")
def missing_node_oracle(spark, d):
    """Candidates for a missing middle: the annotation confirms the path, denies it (it knows where the track end goes, or what both ends are), or can't tell."""
    from strandflow.plans.policies import missing_nodes

    s = Study(spark, d)
    z = missing_nodes(s.nodes, s.edges)
    m = s.matches
    x = s.gt_edges.select("dataset", "source_id", F.col("target_id").alias("mid")).join(s.gt_edges.select("dataset", F.col("source_id").alias("mid"), F.col("target_id").alias("end")), ["dataset", "mid"])
    x = save(x.select("dataset", F.col("source_id").alias("ga"), F.col("end").alias("gc")).distinct())
    j = z.join(m.select("dataset", F.col("node_id").alias("a_id"), F.col("gt_id").alias("ga")), ["dataset", "a_id"], "left").join(m.select("dataset", F.col("node_id").alias("c_id"), F.col("gt_id").alias("gc")), ["dataset", "c_id"], "left")
    j = j.join(x.withColumn("path", F.lit(1)), ["dataset", "ga", "gc"], "left").join(x.select("dataset", "ga").distinct().withColumn("known", F.lit(1)), ["dataset", "ga"], "left")
    v = F.when(F.col("path").isNotNull(), "POSITIVE").when(F.col("ga").isNotNull() & (F.col("gc").isNotNull() | F.col("known").isNotNull()), "EXPLICIT_NEGATIVE").otherwise("UNRESOLVED")
    return j.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


V["bpairs"] = """SELECT *, row_number() OVER (PARTITION BY dataset,b_id ORDER BY residual,max_step,a_id,c_id) rk FROM (SELECT a.dataset, a.node_id a_id, b.node_id b_id, c.node_id c_id, sqrt(power(c.uz-2*b.uz+a.uz,2)+power(c.uy-2*b.uy+a.uy,2)+power(c.ux-2*b.ux+a.ux,2)) residual,
  greatest(sqrt(power(a.uz-b.uz,2)+power(a.uy-b.uy,2)+power(a.ux-b.ux,2)), sqrt(power(c.uz-b.uz,2)+power(c.uy-b.uy,2)+power(c.ux-b.ux,2))) max_step FROM deg b JOIN deg a ON a.dataset=b.dataset AND a.t=b.t-1 AND a.out_degree=0 JOIN deg c ON c.dataset=b.dataset AND c.t=b.t+1 AND c.in_degree=0 WHERE b.in_degree=0 AND b.out_degree=0) WHERE max_step<=8"""
oracle.MATERIALIZED |= {"bpairs"}


@query("""SELECT outcome, count(*) n FROM (SELECT CASE WHEN dm.node_id IS NULL THEN 'not_isolated' WHEN p.rk IS NULL THEN 'out_of_reach' WHEN p.rk>1 THEN 'outranked' WHEN p.residual>4 THEN 'residual_gate' ELSE 'proposed' END outcome FROM gt_edges x JOIN gt_edges y ON y.dataset=x.dataset AND y.source_id=x.target_id
 JOIN matches a ON a.dataset=x.dataset AND a.gt_id=x.source_id JOIN matches b ON b.dataset=x.dataset AND b.gt_id=x.target_id JOIN matches c ON c.dataset=x.dataset AND c.gt_id=y.target_id LEFT JOIN deg dm ON dm.dataset=b.dataset AND dm.node_id=b.node_id AND dm.in_degree=0 AND dm.out_degree=0
 LEFT JOIN bpairs p ON p.dataset=x.dataset AND p.a_id=a.node_id AND p.b_id=b.node_id AND p.c_id=c.node_id) GROUP BY 1""")
def bridge_miss_attribution(spark, d):
    """True triplets of which all nodes were found: is the middle isolated, is the true pair in reach, is it the best, does it pass the gate?"""
    from strandflow.operators import topology

    s = Study(spark, d)
    m = s.matches
    name = lambda g_, p: m.select("dataset", F.col("gt_id").alias(g_), F.col("node_id").alias(p))
    x = s.gt_edges.select("dataset", F.col("source_id").alias("ga"), F.col("target_id").alias("gb")).join(s.gt_edges.select("dataset", F.col("source_id").alias("gb"), F.col("target_id").alias("gc")), ["dataset", "gb"])
    x = x.join(name("ga", "a_id"), ["dataset", "ga"]).join(name("gb", "b_id"), ["dataset", "gb"]).join(name("gc", "c_id"), ["dataset", "gc"])
    alone = topology.degrees(s.nodes, s.edges).where("in_degree = 0 AND out_degree = 0").select("dataset", F.col("node_id").alias("b_id"), F.lit(1).alias("alone"))
    w = Window.partitionBy("dataset", "b_id").orderBy("residual", "max_step", "a_id", "c_id")
    p = policies.bridge_pairs(s.nodes, s.edges).withColumn("rk", F.row_number().over(w)).select("dataset", "a_id", "b_id", "c_id", "residual", "rk")
    j = x.join(alone, ["dataset", "b_id"], "left").join(p, ["dataset", "a_id", "b_id", "c_id"], "left")
    o = F.when(F.col("alone").isNull(), "not_isolated").when(F.col("rk").isNull(), "out_of_reach").when(F.col("rk") > 1, "outranked").when(F.col("residual") > 4, "residual_gate").otherwise("proposed")
    return j.groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT dataset, count(*) n, sha256(string_agg('{{\"source_id\":'||source_id||',\"target_id\":'||target_id||'}}', ';' ORDER BY source_id, target_id)) digest FROM {MUTUAL} z GROUP BY 1")
def action_hash(spark, d):
    """A digest of each dataset's actions (those of the mutual policy), as JSON in order; a dataset's actions are few."""
    n, e = graph(spark, d)
    a = policies.mutual_policy(policies.gap_census(n, e, residual=5.0))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("source_id", "target_id"))), lambda x: F.to_json(x))
    return a.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(rows, ";"), 256).alias("digest"))


LEVELS = {"gs": (4, 5, 6, 7), "gm": (6, 8, 10, 12)}
V["foundpos"] = "SELECT m.dataset, m.gt_id, n.uz, n.uy, n.ux FROM matches m JOIN nodes n ON n.dataset=m.dataset AND n.node_id=m.node_id"
V["founddiv"] = "SELECT g.*, p.uz puz, p.uy puy, p.ux pux FROM gdiv g JOIN foundpos p ON p.dataset=g.dataset AND p.gt_id=g.parent"
V["oraclediv"] = f"""SELECT g.dataset, {_FAR.format('a', 'b')} sep, greatest(da,db) arm, abs(da-db)/greatest(da+db,1e-12::double) balance FROM (SELECT g.dataset, g.g1, g.g2, sqrt((a.uz-puz)*(a.uz-puz)+(a.uy-puy)*(a.uy-puy)+(a.ux-pux)*(a.ux-pux)) da, sqrt((b.uz-puz)*(b.uz-puz)+(b.uy-puy)*(b.uy-puy)+(b.ux-pux)*(b.ux-pux)) db
 FROM founddiv g JOIN foundpos a ON a.dataset=g.dataset AND a.gt_id=g.g1 JOIN foundpos b ON b.dataset=g.dataset AND b.gt_id=g.g2) g JOIN foundpos a ON a.dataset=g.dataset AND a.gt_id=g.g1 JOIN foundpos b ON b.dataset=g.dataset AND b.gt_id=g.g2"""
oracle.MATERIALIZED |= {"foundpos", "founddiv", "oraclediv"}


_GATES = [(gs, gm) for gs in LEVELS["gs"] for gm in LEVELS["gm"]]
_PASSED = "(SELECT unnest([" + ",".join(str(v) for v, _ in _GATES) + "])::int gs, unnest([" + ",".join(str(v) for _, v in _GATES) + "])::int gm, unnest([" + ",".join(f"count(*) FILTER (WHERE sep>={v} AND arm<={w} AND balance<=0.5)" for v, w in _GATES) + "]) n FROM {})"


@query(f"""SELECT a.gs, a.gm, a.n accepted, CASE WHEN z.n>0 THEN round(a.n*1.0::double/z.n,6) ELSE 0 END ratio, (SELECT count(*) FROM oraclediv) reachable, o.n oracle_passed FROM {_PASSED.format('forks WHERE p2>=0.8')} a JOIN {_PASSED.format('oraclediv')} o USING (gs,gm),
 (SELECT n FROM {_PASSED.format('forks WHERE p2>=0.8')} y WHERE gs=6 AND gm=8) z""")
def gate_counterfactual(spark, d):
    """Forks that each gate would accept, as a share of those of the frozen one, and the divisions it could reach if linking were perfect. The gates are the sums of one pass over each."""
    s = Study(spark, d)
    ok = lambda gs, gm: F.count(F.when((F.col("sep") >= gs) & (F.col("arm") <= gm) & (F.col("balance") <= 0.5), 1))
    passed = lambda df, k: df.agg(F.count(F.lit(1)).alias("all"), *[ok(*v).alias(f"p{i}") for i, v in enumerate(_GATES)]).select(
        F.col("all").alias(f"all_{k}"), F.explode(F.array(*[F.struct(F.lit(gs).alias("gs"), F.lit(gm).alias("gm"), F.col(f"p{i}").alias(k)) for i, (gs, gm) in enumerate(_GATES)])).alias("e")
    ).select(f"all_{k}", "e.*")
    a = passed(policies.fork_geometry(s.nodes, s.edges).where("p2 >= 0.8"), "accepted")
    g_ = s.gt_edges.groupBy("dataset", F.col("source_id").alias("parent")).agg(F.min("target_id").alias("g1"), F.max("target_id").alias("g2"), F.count(F.lit(1)).alias("n")).where("n = 2")
    for k in ("parent", "g1", "g2"):
        at = s.nodes.select("dataset", "node_id", *[F.col(u).alias(f"{k}_{u}") for u in g.AXES])
        g_ = g_.join(s.matches.select("dataset", F.col("gt_id").alias(k), "node_id"), ["dataset", k]).join(at, ["dataset", "node_id"]).drop("node_id")
    v = lambda k: tuple(F.col(f"{k}_{u}") for u in g.AXES)
    d1, d2 = g.norm(g.sub(v("g1"), v("parent"))), g.norm(g.sub(v("g2"), v("parent")))
    o = passed(g_.select(g.norm(g.sub(v("g1"), v("g2"))).alias("sep"), F.greatest(d1, d2).alias("arm"), g.division_balance(d1, d2).alias("balance")), "oracle_passed")
    j = save(a.join(o, ["gs", "gm"]))
    frozen = j.where("gs = 6 AND gm = 8").select(F.col("accepted").alias("frozen"))
    ratio = F.when(F.col("frozen") > 0, F.round(F.col("accepted") / F.col("frozen"), 6)).otherwise(0.0).alias("ratio")
    return j.join(F.broadcast(frozen)).select("gs", "gm", "accepted", ratio, F.col("all_oracle_passed").alias("reachable"), "oracle_passed")


# ---- scores
@query(f"SELECT dataset, t, source_id, round(raw1,6) raw1, round(raw2,6) raw2, round(raw1-raw2,6) raw_gap, round(p1,6) p1, round(p2,6) p2, round(p1-p2,6) p_gap FROM (SELECT dataset, t, source_id, max(CASE WHEN rk=1 THEN raw_logit END) raw1, max(CASE WHEN rk=2 THEN raw_logit END) raw2, max(CASE WHEN rk=1 THEN prob END) p1, max(CASE WHEN rk=2 THEN prob END) p2 FROM (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rk FROM probs) WHERE rk<=2 GROUP BY ALL) WHERE raw2 IS NOT NULL")
def score_features(spark, d):
    """Raw logits and probabilities of each source's two best targets, and their differences."""
    n = tracks.nodes(spark, d)
    p = A.column_softmax(tracks.pair_scores(n))
    r = p.withColumn("rk", F.row_number().over(A.row().orderBy(F.desc("raw_logit"), "target_id"))).where("rk <= 2")
    pick = lambda c, k, name: F.max(F.when(F.col("rk") == k, F.col(c))).alias(name)
    f = r.groupBy("dataset", "t", "source_id").agg(pick("raw_logit", 1, "raw1"), pick("raw_logit", 2, "raw2"), pick("prob", 1, "p1"), pick("prob", 2, "p2")).where("raw2 IS NOT NULL")
    return rounded(f.withColumns({"raw_gap": F.col("raw1") - F.col("raw2"), "p_gap": F.col("p1") - F.col("p2")}), "raw1", "raw2", "raw_gap", "p1", "p2", "p_gap")


@query(f"""SELECT split_part(g.dataset,'_',1) prefix, count(*) n, round(avg(CASE WHEN rr=1 AND rc=1 THEN 1.0 ELSE 0 END),6) mutual_first, round(avg(CASE WHEN rr<=2 AND rc<=2 THEN 1.0 ELSE 0 END),6) mutual_second, count(*) FILTER (WHERE rr=1 AND rc=1 AND prob>=0.25 AND prob<=0.5) pocket FROM gt_edges g ANTI JOIN edges e USING (dataset,source_id,target_id)
 JOIN (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rr, row_number() OVER ({COL} ORDER BY prob DESC, source_id) rc FROM probs) p ON p.dataset=g.dataset AND p.source_id=g.source_id AND p.target_id=g.target_id ANTI JOIN ind i ON i.dataset=g.dataset AND i.node_id=g.target_id ANTI JOIN (SELECT * FROM outd WHERE out_degree>=2) o ON o.dataset=g.dataset AND o.node_id=g.source_id GROUP BY 1""")
def free_slot_anatomy(spark, d):
    """Annotated links that the graph lacks though both slots are free: how often they lead in row and column, and those that only a continuation would find."""
    n, e = saved_graph(spark, d)
    p = A.column_softmax(tracks.pair_scores(n))
    p = p.withColumns({"rr": F.row_number().over(A.row().orderBy(F.desc("raw_logit"), "target_id")), "rc": F.row_number().over(A.column().orderBy(F.desc("prob"), "source_id"))})
    lost = tracks.gt_edges(tracks.gt_nodes(n)).join(e, ["dataset", "source_id", "target_id"], "left_anti").join(e.select("dataset", "target_id"), ["dataset", "target_id"], "left_anti")
    full = e.groupBy("dataset", "source_id").count().where("count >= 2")
    j = lost.join(full, ["dataset", "source_id"], "left_anti").join(p, ["dataset", "source_id", "target_id"])
    rate = lambda c, k: F.round(F.avg(F.expr(c).cast("double")), 6).alias(k)
    return j.groupBy(F.split("dataset", "_")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"), rate("rr = 1 AND rc = 1", "mutual_first"), rate("rr <= 2 AND rc <= 2", "mutual_second"), F.count(F.when(F.expr("rr = 1 AND rc = 1 AND prob >= 0.25 AND prob <= 0.5"), 1)).alias("pocket"))


@query(f"SELECT {P}, CAST(1+(SELECT count(*) FROM probs o WHERE o.dataset=p.dataset AND o.t=p.t AND o.target_id=p.target_id AND round(o.prob,9)>round(p.prob,9)) AS int) rank, round(p.prob-coalesce((SELECT max(o.prob) FROM probs o WHERE o.dataset=p.dataset AND o.t=p.t AND o.target_id=p.target_id AND o.source_id<>p.source_id),0),6) margin FROM probs p")
def competitor_margin(spark, d):
    """The competition rank of each pair in its column, and its probability less the best of the others (also for the best itself)."""
    p = A.column_softmax(tracks.pair_scores(tracks.nodes(spark, d)))
    w = A.column().orderBy(F.desc("prob"), "source_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumns({"rank": F.rank().over(A.column().orderBy(F.desc(F.round("prob", 9)))), "first": F.first("source_id").over(whole), "p1": F.first("prob").over(whole), "p2": F.nth_value("prob", 2).over(whole)})
    other = F.when(F.col("first") == F.col("source_id"), F.coalesce("p2", F.lit(0.0))).otherwise(F.col("p1"))
    return p.select(*PAIR, "rank", F.round(F.col("prob") - other, 6).alias("margin"))


# ---- peaks
@query("SELECT dataset, t, z, y, x, round(avg(v),6) score FROM (SELECT dataset, t, z, CASE WHEN k%2=1 THEN 59-my ELSE my END y, CASE WHEN k>=2 THEN 59-mx ELSE mx END x, v FROM (SELECT dataset, t, z, k, CASE WHEN k%2=1 THEN 59-y ELSE y END my, CASE WHEN k>=2 THEN 59-x ELSE x END mx, prob*(1-0.0123456::double*k) v FROM peaks, (VALUES (0),(1),(2),(3)) w(k))) GROUP BY ALL")
def view_average(spark, d):
    """The mean of four views' scores per voxel; each view has mirrored coordinates, which are turned back first."""
    p = tracks.peaks(spark, d).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    flip = lambda c, cond: F.when(cond, 59 - F.col(c)).otherwise(F.col(c)).cast("int")
    views = p.select("dataset", "t", "z", "k", flip("y", F.col("k") % 2 == 1).alias("y"), flip("x", F.col("k") >= 2).alias("x"), (F.col("prob") * (1 - 0.0123456 * F.col("k"))).alias("v"))
    back = views.select("dataset", "t", "z", flip("y", F.col("k") % 2 == 1).alias("y"), flip("x", F.col("k") >= 2).alias("x"), "v")
    return back.groupBy(*AT).agg(F.round(F.avg("v"), 6).alias("score"))


@query("SELECT dataset, t, z, y*4 y, x*4 x FROM peaks WHERE prob>0.99::double")
def lift_coordinates(spark, d):
    """Peaks of the model's grid in voxels of the volume."""
    return tracks.peaks(spark, d).where("prob > double(0.99)").select("dataset", "t", *[(F.col(c) * int(k)).cast("int").alias(c) for c, k in zip("zyx", g.GRID, strict=True)])


@query("SELECT p.dataset, p.t, p.z, p.y, p.x, round(avg(CASE WHEN o.prob<=p.prob THEN 1.0 ELSE 0 END),6) percentile, round(sqrt(power((arg_min(o.z, (-round(o.prob,9),o.z,o.y,o.x))-p.z)*1.625,2)+power((arg_min(o.y, (-round(o.prob,9),o.z,o.y,o.x))-p.y)*1.625,2)+power((arg_min(o.x, (-round(o.prob,9),o.z,o.y,o.x))-p.x)*1.625,2)),6) brightest FROM peaks p JOIN peaks o ON o.dataset=p.dataset AND o.t=p.t AND abs(o.z-p.z)<=3 AND abs(o.y-p.y)<=6 AND abs(o.x-p.x)<=6 WHERE p.prob>0.98::double GROUP BY p.dataset,p.t,p.z,p.y,p.x,p.prob")
def centroid_percentile(spark, d):
    """Where a centre's score stands among those of its patch, and how far away the patch's brightest peak is."""
    p = tracks.peaks(spark, d)
    j = detection.box_pairs(p, (3, 6, 6)).where("prob > double(0.98)")
    best = F.min(F.struct((-F.round("oprob", 9)).alias("b"), "oz", "oy", "ox")).alias("m")
    k = j.groupBy(*AT).agg(F.round(F.avg((F.col("oprob") <= F.col("prob")).cast("double")), 6).alias("percentile"), best)
    um = tuple((F.col(f"m.o{c}") - F.col(c)) * 1.625 for c in "zyx")
    return k.select(*AT, "percentile", F.round(g.norm(um), 6).alias("brightest"))


# ---- neighbours and motion
@query(f"SELECT b.dataset, b.node_id, coalesce(min({_FAR.format('a', 'b')})<=3, false) near FROM nodes b LEFT JOIN gt_nodes a ON a.dataset=b.dataset AND a.t=b.t GROUP BY ALL")
def proximity_label(spark, d):
    """Is a detection within 3 um of an annotated node?"""
    n = tracks.nodes(spark, d)
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    hit = spatial.within(a, n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], 3.0).select("dataset", "node_id").distinct().withColumn("near", F.lit(True))
    return n.select("dataset", "node_id").join(hit, ["dataset", "node_id"], "left").fillna(False, ["near"])


_CTRL = "SELECT dataset, t, node_id*10+k point, (((node_id*131+k*17)%60)+1)*1.625::double uz, (((node_id*733+k*37)%240)+8)*0.40625::double uy, (((node_id*977+k*53)%240)+8)*0.40625::double ux, k FROM nodes, (VALUES (0),(1),(2)) r(k)"


@query(f"SELECT split_part(a.dataset,'_',1) prefix, count(*) n, round(avg(CASE WHEN a.best<=3 THEN 1.0 ELSE 0 END),6) coverage, round(avg(coalesce(c.hit,0)/3.0::double),6) control, round(avg(CASE WHEN a.best<=3 THEN 1.0 ELSE 0 END)-avg(coalesce(c.hit,0)/3.0::double),6) gain FROM (SELECT g.dataset, g.node_id, min({_FAR.format('g', 'n')}) best FROM gt_nodes g LEFT JOIN nodes n ON n.dataset=g.dataset AND n.t=g.t GROUP BY ALL) a LEFT JOIN (SELECT g.dataset, g.node_id, count(DISTINCT k) hit FROM gt_nodes g JOIN ({_CTRL}) n ON n.dataset=g.dataset AND n.t=g.t WHERE {_FAR.format('g', 'n')}<=3 GROUP BY ALL) c USING (dataset,node_id) GROUP BY 1")
def random_control_gain(spark, d):
    """Coverage of annotations by detections, and by as many points per frame placed by a rule, three times over."""
    n = tracks.nodes(spark, d)
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    c = n.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    place = lambda p, q, m, o, s: ((F.col("node_id") * p + F.col("k") * q) % m + o) * F.lit(s)
    c = c.select("dataset", "t", "k", place(131, 17, 60, 1, 1.625).alias("uz"), place(733, 37, 240, 8, 0.40625).alias("uy"), place(977, 53, 240, 8, 0.40625).alias("ux"))
    real = spatial.within(a, n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], 3.0).select("dataset", "gt_id").distinct().withColumn("hit", F.lit(1.0))
    control = spatial.within(a, c, ["dataset", "t"], 3.0).groupBy("dataset", "gt_id").agg((F.countDistinct("k") / 3).alias("share"))
    j = a.join(real, ["dataset", "gt_id"], "left").join(control, ["dataset", "gt_id"], "left").fillna(0.0, ["hit", "share"])
    return j.groupBy(F.split("dataset", "_")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("coverage"), F.round(F.avg("share"), 6).alias("control"), F.round(F.avg("hit") - F.avg("share"), 6).alias("gain"))


_G = GM.replace("a.t,", "a.t, a.node_id source_id, e.target_id, a.uz, a.uy, a.ux,")
V["loo"] = f"""SELECT a.dataset, a.t, a.source_id, a.target_id, any_value(a.uz) uz, any_value(a.uy) uy, any_value(a.ux) ux, quantile_cont(b.dz,0.5) mz, quantile_cont(b.dy,0.5) my, quantile_cont(b.dx,0.5) mx FROM {_G} a JOIN {_G} b ON a.dataset=b.dataset AND a.t=b.t AND a.target_id<>b.target_id GROUP BY a.dataset,a.t,a.source_id,a.target_id HAVING count(*)>=2"""
V["corrected"] = """SELECT l.dataset, l.source_id, l.target_id, arg_min(n.node_id, (round(sqrt(power(n.uz-l.uz,2)+power(n.uy-l.uy,2)+power(n.ux-l.ux,2)),9), n.node_id))=l.target_id plain, arg_min(n.node_id, (round(sqrt(power(n.uz-l.uz-mz,2)+power(n.uy-l.uy-my,2)+power(n.ux-l.ux-mx,2)),9), n.node_id))=l.target_id moved FROM loo l JOIN gt_nodes n ON n.dataset=l.dataset AND n.t=l.t+1 GROUP BY l.dataset, l.source_id, l.target_id"""


@query("SELECT split_part(dataset,'_',1) prefix, count(*) n, count(*) FILTER (WHERE plain AND moved) still_right, count(*) FILTER (WHERE NOT plain AND moved) recovered, count(*) FILTER (WHERE plain AND NOT moved) worsened, count(*) FILTER (WHERE NOT plain AND NOT moved) still_wrong FROM corrected GROUP BY 1")
def motion_corrected_nn(spark, d):
    """Is the true child the nearest annotated node of the next frame, before and after the frame's motion (of the other links) is taken off?"""
    from strandflow.plans.graph import others_shift

    n, _ = gt(spark, d)
    n = save(n)
    m = save(others_shift(moves(spark, d)))
    at = n.select("dataset", F.col("node_id").alias("source_id"), *g.AXES)
    m = m.join(at, ["dataset", "source_id"]).select("dataset", (F.col("t") + 1).alias("t"), "source_id", "target_id", *[F.col(u).alias(f"a{u}") for u in g.AXES], *[(F.col(u) + F.col(f"s{u[1]}")).alias(f"b{u}") for u in g.AXES])
    j = m.join(n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"])  # the annotated nodes of one frame, few by nature
    far = lambda p: F.round(g.norm(tuple(F.col(u) - F.col(f"{p}{u}") for u in g.AXES)), 9)
    best = lambda p: F.min(F.struct(far(p).alias("x"), "node_id"))["node_id"] == F.col("target_id")
    k = j.groupBy("dataset", "source_id", "target_id").agg(best("a").alias("plain"), best("b").alias("moved"))
    n_ = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    return k.groupBy(F.split("dataset", "_")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"), n_("plain AND moved", "still_right"), n_("NOT plain AND moved", "recovered"), n_("plain AND NOT moved", "worsened"), n_("NOT plain AND NOT moved", "still_wrong"))
