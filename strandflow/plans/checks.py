"""Queries that hold the graph against itself and the annotation: time steps, isolated nodes, division rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import metrics as M
from strandflow.operators import policies, topology
from strandflow.plans import oracle
from strandflow.plans.evaluation import Study
from strandflow.plans.policies import graph
from strandflow.plans.registry import query


@query("""SELECT d.dataset, d.n_nodes, coalesce(x.odd,0) odd_t, coalesce(e.n,0) edges, coalesce(e.steps,0) one_frame, coalesce(e.skips,0) skips, coalesce(e.back,0) backward FROM datasets d LEFT JOIN (SELECT dataset, count(*) FILTER (WHERE t<>floor(t)) odd FROM nodes GROUP BY 1) x USING (dataset)
 LEFT JOIN (SELECT e.dataset, count(*) n, count(*) FILTER (WHERE b.t-a.t=1) steps, count(*) FILTER (WHERE b.t-a.t>1) skips, count(*) FILTER (WHERE b.t<=a.t) back FROM edges e JOIN nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id GROUP BY 1) e USING (dataset)""")
def time_steps(spark, d):
    """Frames that are no whole numbers, and links by the frames that they span: one, more, none or backward."""
    n, e = graph(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(p))
    step = F.col("b") - F.col("a")
    count = lambda c, k: F.count(F.when(c, 1)).alias(k)
    j = e.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"])
    links = j.groupBy("dataset").agg(F.count(F.lit(1)).alias("edges"), count(step == 1, "one_frame"), count(step > 1, "skips"), count(step <= 0, "backward"))
    whole = n.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_nodes"), count(F.col("t") != F.floor("t"), "odd_t"))
    return whole.join(links, "dataset", "left").fillna(0)


@query("""SELECT d.dataset, count(*) isolated, count(m.node_id) matched, count(*) FILTER (WHERE d.high_conf) high_conf, count(m.node_id) FILTER (WHERE d.high_conf) high_conf_matched, round(count(m.node_id)*1.0::double/count(*),6) match_rate
 FROM deg d LEFT JOIN matches m ON m.dataset=d.dataset AND m.node_id=d.node_id WHERE in_degree=0 AND out_degree=0 GROUP BY 1""")
def isolated_match_rate(spark, d):
    """How many isolated nodes are detections of an annotated one, by confidence."""
    s = Study(spark, d)
    alone = topology.degrees(s.nodes, s.edges).where("in_degree = 0 AND out_degree = 0").select("dataset", "node_id", "high_conf")
    j = alone.join(s.matches.select("dataset", "node_id", F.lit(True).alias("m")), ["dataset", "node_id"], "left").fillna(False, ["m"])
    count = lambda c, k: F.count(F.when(F.expr(c), 1)).alias(k)
    return j.groupBy("dataset").agg(F.count(F.lit(1)).alias("isolated"), count("m", "matched"), count("high_conf", "high_conf"), count("m AND high_conf", "high_conf_matched"), F.round(F.avg(F.col("m").cast("double")), 6).alias("match_rate"))


#: The rules of the family, loosest first, in SQL that Spark and DuckDB share.
RULES = {
    "any": "true", "probability": "p2>=0.8", "separation": "sep>=6", "arm": "arm<=8", "angle": "NOT isnan(angle) AND angle>=120", "separation_arm": "sep>=6 AND arm<=8",
    "geometry": "sep>=6 AND arm<=8 AND NOT isnan(angle) AND angle>=120 AND balance<=0.5", "all": "p2>=0.8 AND sep>=6 AND arm<=8 AND NOT isnan(angle) AND angle>=120 AND balance<=0.5",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {c}) kept, count(*) FILTER (WHERE verdict='tp' AND {c}) true_kept, count(*) FILTER (WHERE verdict='fp' AND {c}) false_kept, round(CASE WHEN count(*) FILTER (WHERE verdict='tp')>0 THEN count(*) FILTER (WHERE verdict='tp' AND {c})*1.0::double/count(*) FILTER (WHERE verdict='tp') ELSE 0 END,6) recall FROM forks JOIN {oracle.verdicts('edges')} v USING (dataset,source_id)" for k, c in RULES.items()))
def division_rule_recall(spark, d):
    """For each rule of the family the forks that it keeps, and the share of true forks among them: all rules are sums of one pass."""
    s = Study(spark, d)
    _, verdict = M.division_accounting(s.edges, s.gt_edges, s.matches)
    f = policies.fork_geometry(s.nodes, s.edges).join(verdict.select("dataset", "source_id", "verdict"), ["dataset", "source_id"])
    count = lambda c: F.count(F.when(F.expr(c), 1))
    sums = [x for k, c in RULES.items() for x in (count(c).alias(f"{k}_kept"), count(f"verdict = 'tp' AND {c}").alias(f"{k}_true"), count(f"verdict = 'fp' AND {c}").alias(f"{k}_false"))]
    one = f.agg(count("verdict = 'tp'").alias("_true"), *sums)
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"{k}_kept").alias("kept"), F.col(f"{k}_true").alias("true_kept"), F.col(f"{k}_false").alias("false_kept")) for k in RULES])
    out = one.select("_true", F.explode(rules).alias("e")).select("_true", "e.*")
    return out.select("rule", "kept", "true_kept", "false_kept", F.when(F.col("_true") > 0, F.round(F.col("true_kept") / F.col("_true"), 6)).otherwise(0.0).alias("recall"))



_AT = "sqrt(({0}.uz-{1}.uz)*({0}.uz-{1}.uz)+({0}.uy-{1}.uy)*({0}.uy-{1}.uy)+({0}.ux-{1}.ux)*({0}.ux-{1}.ux))"


@query(f"""SELECT c.dataset, c.size, count(*) components, round(avg(steps*1.0::double),6) steps, round(avg(moved),6) moved, round(max(longest),6) longest FROM (SELECT z.dataset, z.component, z.size, count(e.edge_id) steps, coalesce(sum(l),0) moved, coalesce(max(l),0) longest FROM compsize z JOIN comp c ON c.dataset=z.dataset AND c.component=z.component
 LEFT JOIN (SELECT e.*, {_AT.format('a', 'b')} l FROM edges e JOIN nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id) e ON e.dataset=c.dataset AND e.source_id=c.node_id GROUP BY ALL) c GROUP BY ALL""")
def component_motion(spark, d):
    """Motion of components by dataset and size: links, way moved and longest step, from one sum per component."""
    n, e = graph(spark, d)
    c = topology.components(n, e)
    at = lambda k, p: c.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    length = g.norm(tuple(F.col(f"a{u}") - F.col(f"b{u}") for u in g.AXES))
    j = e.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"]).join(c.select("dataset", F.col("node_id").alias("source_id"), "component"), ["dataset", "source_id"])
    moved = j.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("steps"), F.sum(length).alias("moved"), F.max(length).alias("longest"))
    size = c.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"))
    every = size.join(moved, ["dataset", "component"], "left").fillna(0)
    return every.groupBy("dataset", "size").agg(F.count(F.lit(1)).alias("components"), F.round(F.avg("steps"), 6).alias("steps"), F.round(F.avg("moved"), 6).alias("moved"), F.round(F.max("longest"), 6).alias("longest"))
