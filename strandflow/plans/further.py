"""Further queries: unions of proposals, provenance, ceilings, rewires, grids and a classifier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import association as A
from strandflow.operators import logistic, policies, ranks, spatial
from strandflow.plans import oracle
from strandflow.plans.association import TOP2
from strandflow.plans.evaluation import RAW, Study
from strandflow.plans.graph import GM, NEXT, gt, moves, next_frame
from strandflow.plans.policies import BRIDGE, GAP, graph, saved_graph
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save

GTD = "sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux))"


@query(f"""SELECT scale, count(*) n, round(avg(CASE WHEN best<=3 THEN 1.0 ELSE 0 END),6) coverage FROM (SELECT scale, a.dataset, a.node_id, min(CASE WHEN (scale='fine' AND b.high_conf) OR (scale='coarse' AND b.node_id%3=0) OR (scale='union' AND (b.high_conf OR b.node_id%3=0)) THEN {GTD} END) best
 FROM gt_nodes a LEFT JOIN nodes b ON a.dataset=b.dataset AND a.t=b.t, (VALUES ('fine'),('coarse'),('union')) v(scale) GROUP BY ALL) GROUP BY 1""")
def multiscale_union(spark, d):
    """Coverage by two proposal sets and by their union; pairs are made once."""
    n = tracks.nodes(spark, d)
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    near = spatial.within(a, n.select("dataset", "t", "node_id", "high_conf", *g.AXES), ["dataset", "t"], 3.0)
    third = F.col("node_id") % 3 == 0
    k = near.groupBy("dataset", "gt_id").agg(F.max("high_conf").alias("fine"), F.max(third).alias("coarse"))
    s = a.join(k, ["dataset", "gt_id"], "left").select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("fine", "coarse")]).withColumn("union", F.col("fine") | F.col("coarse"))
    return s.unpivot([], ["fine", "coarse", "union"], "scale", "hit").groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("coverage"))


@query("""SELECT dataset, t, count(*) n, bool_and(coalesce(same,false)) valid FROM (SELECT coalesce(a.dataset,b.dataset) dataset, coalesce(a.t,b.t) t, a.k=b.k same FROM
 (SELECT dataset, t, row_number() OVER (PARTITION BY dataset,t ORDER BY node_id) i, concat_ws(',', CAST(round_even(z,0) AS bigint), CAST(round_even(y,0) AS bigint), CAST(round_even(x,0) AS bigint)) k FROM nodes) a
 FULL JOIN (SELECT dataset, t, row_number() OVER (PARTITION BY dataset,t ORDER BY node_id) i, concat_ws(',', CAST(round_even(z,0) AS bigint), CAST(round_even(y,0) AS bigint), CAST(round_even(x,0) AS bigint)) k FROM nodes WHERE NOT (t=5 AND c%50=3)) b USING (dataset,t,i)) GROUP BY ALL""")
def node_mapping(spark, d):
    """Frames of a replay (here without some nodes of frame 5) whose nodes map to the saved ones by position."""
    n = tracks.nodes(spark, d)
    w = Window.partitionBy("dataset", "t").orderBy("node_id")
    key = F.concat_ws(",", *[F.bround(c, 0).cast("long") for c in "zyx"])
    a = n.select("dataset", "t", F.row_number().over(w).alias("i"), key.alias("k"))
    b = n.where("NOT (t = 5 AND c % 50 = 3)").select("dataset", "t", F.row_number().over(w).alias("i"), key.alias("k2"))
    j = a.join(b, ["dataset", "t", "i"], "full_outer")
    return j.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("k") == F.col("k2"), F.lit(False))).alias("valid"))


@query("""SELECT origin, count(*) n FROM (SELECT CASE WHEN a.edge_id IS NOT NULL AND b.edge_id IS NOT NULL THEN 'both' WHEN a.edge_id IS NOT NULL THEN 'low_only' WHEN b.edge_id IS NOT NULL THEN 'high_only' ELSE 'none' END origin FROM gt_edges g
 LEFT JOIN (SELECT * FROM edges WHERE edge_prob>=0.6) a USING (dataset,source_id,target_id) LEFT JOIN (SELECT e.* FROM edges e JOIN nodes s ON s.dataset=e.dataset AND s.node_id=e.source_id AND s.high_conf JOIN nodes t ON t.dataset=e.dataset AND t.node_id=e.target_id AND t.high_conf) b ON b.dataset=g.dataset AND b.source_id=g.source_id AND b.target_id=g.target_id) GROUP BY 1""")
def edge_provenance(spark, d):
    """In which of two edge sets (by probability, by detection threshold) annotated links occur."""
    n, e = graph(spark, d)
    key = ["dataset", "source_id", "target_id"]
    a = e.where("edge_prob >= 0.6").select(*key, F.lit(1).alias("a"))
    b = policies.keep_edges(e, n.where("high_conf")).select(*key, F.lit(1).alias("b"))
    j = tracks.gt_edges(tracks.gt_nodes(n)).join(a, key, "left").join(b, key, "left")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.groupBy(F.when(x & y, "both").when(x, "low_only").when(y, "high_only").otherwise("none").alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def average_rank(column: str):
    """Rank from 1, ties at their mean (over all rows: one row per dataset)."""
    return F.rank().over(Window.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(column)) - 1) / 2


@query(f"""SELECT round(corr(ra,rb),6) rho FROM (SELECT rank() OVER (ORDER BY j)+(count(*) OVER (PARTITION BY j)-1)/2.0::double ra, rank() OVER (ORDER BY m)+(count(*) OVER (PARTITION BY m)-1)/2.0::double rb FROM
 (SELECT round(edge_jaccard,9) j, round(m,9) m FROM {RAW} x JOIN (SELECT dataset, avg(sqrt(dz*dz+dy*dy+dx*dx)) m FROM {GM} z GROUP BY 1) y USING (dataset)))""")
def spearman_motion(spark, d):
    """Rank correlation over datasets of edge Jaccard and mean motion."""
    m = moves(spark, d).groupBy("dataset").agg(F.round(F.avg(g.norm((F.col("dz"), F.col("dy"), F.col("dx")))), 9).alias("m"))
    s = Study(spark, d)
    j = s.records(s.edges).select("dataset", F.round("edge_jaccard", 9).alias("j")).join(m, "dataset")
    return j.select(average_rank("j").alias("ra"), average_rank("m").alias("rb")).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


DIV = "(SELECT dataset, source_id, min(target_id) d1, max(target_id) d2 FROM gt_edges GROUP BY ALL HAVING count(*)=2)"


@query(f"""SELECT v.dataset, v.source_id, v.d1, v.d2, round(sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)),6) sep, sqrt((a.uz-p.uz)*(a.uz-p.uz)+(a.uy-p.uy)*(a.uy-p.uy)+(a.ux-p.ux)*(a.ux-p.ux))=0 degenerate, a.t<>p.t+1 OR b.t<>p.t+1 AS gap FROM {DIV} v
 JOIN gt_nodes p ON p.dataset=v.dataset AND p.node_id=v.source_id JOIN gt_nodes a ON a.dataset=v.dataset AND a.node_id=v.d1 JOIN gt_nodes b ON b.dataset=v.dataset AND b.node_id=v.d2""")
def gt_division_census(spark, d):
    """Annotated divisions with their two daughters of least id; gap: a daughter isn't in the very next frame."""
    n, e = gt(spark, d)
    w = Window.partitionBy("dataset", "source_id")
    r = e.withColumns({"rk": F.row_number().over(w.orderBy("target_id")), "k": F.count(F.lit(1)).over(w)}).where("k = 2")
    v = r.groupBy("dataset", "source_id").agg(F.min("target_id").alias("d1"), F.max("target_id").alias("d2"))
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(f"{p}t"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    j = v.join(at("source_id", "p"), ["dataset", "source_id"]).join(at("d1", "a"), ["dataset", "d1"]).join(at("d2", "b"), ["dataset", "d2"])
    p = lambda x: tuple(F.col(f"{x}{u}") for u in g.AXES)
    return j.select("dataset", "source_id", "d1", "d2", F.round(g.norm(g.sub(p("a"), p("b"))), 6).alias("sep"), (g.norm(g.sub(p("a"), p("p"))) == 0).alias("degenerate"), ((F.col("at") != F.col("pt") + 1) | (F.col("bt") != F.col("pt") + 1)).alias("gap"))


@query(f"SELECT dataset, node_id, other_id, round(dist,6) dist FROM (SELECT z.*, row_number() OVER (PARTITION BY z.dataset,z.node_id ORDER BY dist,other_id) rk FROM {NEXT} z JOIN outd o ON o.dataset=z.dataset AND o.node_id=z.node_id AND o.out_degree=1 ANTI JOIN edges e ON e.dataset=z.dataset AND e.source_id=z.node_id AND e.target_id=z.other_id WHERE dist<=15) WHERE rk=1")
def hard_negatives(spark, d):
    """For nodes with one child the nearest other node within 15 um: a division that is none."""
    n, e = graph(spark, d)
    one = e.groupBy("dataset", F.col("source_id").alias("node_id")).count().where("count = 1").drop("count")
    links = e.select("dataset", F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"))
    p = next_frame(n, 15.0).join(one, ["dataset", "node_id"], "left_semi").join(links, ["dataset", "node_id", "other_id"], "left_anti")
    return spatial.nearest(p, ["dataset", "node_id"], "other_id", 1).select("dataset", "node_id", "other_id", F.round("dist", 6).alias("dist"))


def _far(a: str, b: str) -> str:
    return f"sqrt(({a}.uz-{b}.uz)*({a}.uz-{b}.uz)+({a}.uy-{b}.uy)*({a}.uy-{b}.uy)+({a}.ux-{b}.ux)*({a}.ux-{b}.ux))"


@query(f"""SELECT count(*) n, count(t.t1) with_candidates, count(*) FILTER (WHERE least(greatest({_far('x', 'a')},{_far('y', 'b')}),greatest({_far('x', 'b')},{_far('y', 'a')}))<=7) covered FROM {DIV} v JOIN gt_nodes a ON a.dataset=v.dataset AND a.node_id=v.d1 JOIN gt_nodes b ON b.dataset=v.dataset AND b.node_id=v.d2
 LEFT JOIN (SELECT * FROM {TOP2} z WHERE t2 IS NOT NULL) t ON t.dataset=v.dataset AND t.source_id=v.source_id LEFT JOIN nodes x ON x.dataset=v.dataset AND x.node_id=t.t1 LEFT JOIN nodes y ON y.dataset=v.dataset AND y.node_id=t.t2""")
def candidate_pair_ceiling(spark, d):
    """Do the two best targets of a mother cover both daughters within 7 um, either way round?"""
    n = tracks.nodes(spark, d)
    gn, ge = gt(spark, d)
    v = ge.groupBy("dataset", "source_id").agg(F.min("target_id").alias("d1"), F.max("target_id").alias("d2"), F.count(F.lit(1)).alias("k")).where("k = 2")
    at = lambda df, k, p: df.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    t = A.top2_targets(tracks.pair_scores(n)).where("t2 IS NOT NULL").select("dataset", "source_id", "t1", "t2")
    j = v.join(at(gn, "d1", "a"), ["dataset", "d1"]).join(at(gn, "d2", "b"), ["dataset", "d2"]).join(t, ["dataset", "source_id"], "left").join(at(n, "t1", "x"), ["dataset", "t1"], "left").join(at(n, "t2", "y"), ["dataset", "t2"], "left")
    far = lambda p, q: g.norm(tuple(F.col(f"{p}{u}") - F.col(f"{q}{u}") for u in g.AXES))
    best = F.least(F.greatest(far("x", "a"), far("y", "b")), F.greatest(far("x", "b"), far("y", "a")))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("t1").alias("with_candidates"), F.count(F.when(best <= 7, 1)).alias("covered"))


@query(f"SELECT CAST(r AS double) residual_gate, CAST(s AS int) step_gate, count(*) FILTER (WHERE residual<=r AND max_step<=s AND margin>=1) single_gaps FROM {GAP} z, (VALUES (2.0),(3.0),(4.0),(6.0)) a(r), (VALUES (6),(8),(12)) b(s) GROUP BY ALL")
def policy_grid(spark, d):
    """Single-edge candidates under a grid of gates in one job: the census once, the grid exploded beside it."""
    c = policies.gap_census(*saved_graph(spark, d)).select("residual", "max_step", "margin")
    c = c.withColumn("residual_gate", F.explode(F.array(*[F.lit(v) for v in (2.0, 3.0, 4.0, 6.0)]))).withColumn("step_gate", F.explode(F.array(*[F.lit(v) for v in (6, 8, 12)])))
    ok = (F.col("residual") <= F.col("residual_gate")) & (F.col("max_step") <= F.col("step_gate")) & (F.col("margin") >= 1)
    return c.groupBy("residual_gate", "step_gate").agg(F.count(F.when(ok, 1)).alias("single_gaps"))


@query(f"SELECT pair_count, count(*) n, count(*) FILTER (WHERE residual<=4) geometric, round(avg(residual),6) mean_residual FROM {BRIDGE} z GROUP BY 1")
def bridge_ambiguity(spark, d):
    b = policies.bridge_census(*graph(spark, d))
    return b.groupBy("pair_count").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("residual") <= 4, 1)).alias("geometric"), F.round(F.avg("residual"), 6).alias("mean_residual"))


GEOMETRY = ["near", "far", "sep", "angle", "balance"]
_SHAPE = """SELECT f.*, split_part(f.dataset,'_',1) family, s.fold FROM (SELECT dataset, source_id, label, least(da,db) near, greatest(da,db) far, sep, CASE WHEN da*db>0 THEN degrees(acos(least(greatest(dp/(da*db),-1.0::double),1.0::double))) ELSE 0 END angle, abs(da-db)/greatest(da+db,1e-12::double) balance FROM
 (SELECT v.dataset, v.source_id, v.label, sqrt(power(a.uz-p.uz,2)+power(a.uy-p.uy,2)+power(a.ux-p.ux,2)) da, sqrt(power(b.uz-p.uz,2)+power(b.uy-p.uy,2)+power(b.ux-p.ux,2)) db, sqrt(power(a.uz-b.uz,2)+power(a.uy-b.uy,2)+power(a.ux-b.ux,2)) sep,
  (a.uz-p.uz)*(b.uz-p.uz)+(a.uy-p.uy)*(b.uy-p.uy)+(a.ux-p.ux)*(b.ux-p.ux) dp FROM shapes v JOIN gt_nodes p ON p.dataset=v.dataset AND p.node_id=v.source_id JOIN gt_nodes a ON a.dataset=v.dataset AND a.node_id=v.d1 JOIN gt_nodes b ON b.dataset=v.dataset AND b.node_id=v.d2)) f JOIN datasets s USING (dataset)"""
oracle.VIEWS["shapes"] = f"""SELECT dataset, source_id, d1, d2, 1 AS label FROM {DIV} z UNION ALL SELECT dataset, source_id, target_id, other, 0 FROM (SELECT e.dataset, e.source_id, e.target_id, b.node_id other, row_number() OVER (PARTITION BY e.dataset, e.source_id ORDER BY {GTD}, b.node_id) rk
 FROM (SELECT *, count(*) OVER (PARTITION BY dataset, source_id) k FROM gt_edges) e JOIN gt_nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN gt_nodes b ON b.dataset=a.dataset AND b.t=a.t+1 AND b.node_id<>e.target_id WHERE e.k=1 AND {GTD}<=15) WHERE rk=1"""


def shapes(spark, d):
    """The geometry of annotated divisions (label 1), and of nodes with one child taken together with the nearest other node of the next frame within 15 um (label 0)."""
    n, e = gt(spark, d)
    n, e = save(n), save(e)
    w = Window.partitionBy("dataset", "source_id")
    e = e.withColumn("k", F.count(F.lit(1)).over(w))
    yes = e.where("k = 2").groupBy("dataset", "source_id").agg(F.min("target_id").alias("d1"), F.max("target_id").alias("d2")).withColumn("label", F.lit(1))
    a = n.join(e.where("k = 1").select("dataset", F.col("source_id").alias("node_id"), "target_id"), ["dataset", "node_id"]).select("dataset", (F.col("t") + 1).alias("t"), F.col("node_id").alias("source_id"), "target_id", *g.AXES)
    near = spatial.within(a, n.select("dataset", "t", F.col("node_id").alias("other"), *g.AXES), ["dataset", "t"], 15.0).where("other <> target_id")
    no = spatial.nearest(near, ["dataset", "source_id"], "other", 1).select("dataset", "source_id", F.col("target_id").alias("d1"), F.col("other").alias("d2"), F.lit(0).alias("label"))
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    j = yes.unionByName(no).join(at("source_id", "p"), ["dataset", "source_id"]).join(at("d1", "a"), ["dataset", "d1"]).join(at("d2", "b"), ["dataset", "d2"])
    v = lambda x: tuple(F.col(f"{x}{u}") for u in g.AXES)
    va, vb = g.sub(v("a"), v("p")), g.sub(v("b"), v("p"))
    da, db = g.norm(va), g.norm(vb)
    j = j.select(
        "dataset", "source_id", "label", F.least(da, db).alias("near"), F.greatest(da, db).alias("far"), g.norm(g.sub(v("a"), v("b"))).alias("sep"), F.nanvl(g.angle(va, vb), F.lit(0.0)).alias("angle"), g.division_balance(da, db).alias("balance"),
    )
    sets = tracks.datasets(tracks.nodes(spark, d)).select("dataset", F.col("prefix").alias("family"), "fold")
    return j.join(sets, "dataset")


@query(f"SELECT dataset, source_id, label, family, fold, {', '.join(f'round({c},5) {c}' for c in GEOMETRY)} FROM ({_SHAPE}) z")
def division_shapes(spark, d):
    return shapes(spark, d).select("dataset", "source_id", "label", "family", "fold", *[F.round(c, 5).alias(c) for c in GEOMETRY])


def classified(spark, d):
    """Out-of-fold scores of one logistic model of all geometry per family and fold, folds by dataset, all fitted at once."""
    rows = save(shapes(spark, d))
    return logistic.scored(rows, logistic.fit(rows, GEOMETRY, "family", "fold", "label"), GEOMETRY, "family", "fold")


@query()
def geometry_classifier(spark, d):
    """Out-of-fold scores of a logistic model of division geometry by family."""
    return classified(spark, d).select("dataset", "source_id", "family", "fold", "label", F.round("score", 5).alias("score"))


@query()
def geometry_classifier_auc(spark, d):
    """ROC-AUC of the out-of-fold scores by family and fold."""
    a = ranks.auc(save(classified(spark, d).select("family", "fold", "label", "score")), ["family", "fold"], "score", "label")
    return a.select("family", "fold", "n", F.col("p").alias("positives"), F.round("auc", 6).alias("auc"))


@query("SELECT fold, high_conf AS label, count(*) n, round(avg(CASE WHEN z<8 OR z>56 OR y<16 OR y>240 OR x<16 OR x>240 THEN 1.0 ELSE 0 END),6) padded FROM nodes JOIN datasets USING (dataset) GROUP BY ALL")
def padding_confound(spark, d):
    """Share of patches that reach over the volume's border, by fold and label."""
    n = tracks.nodes(spark, d)
    j = n.join(tracks.datasets(n).select("dataset", "fold"), "dataset")
    over = F.expr("z<8 OR z>56 OR y<16 OR y>240 OR x<16 OR x>240").cast("double")
    return j.groupBy("fold", F.col("high_conf").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(over), 6).alias("padded"))


@query("""SELECT gs, gm, passed, cost FROM (SELECT *, row_number() OVER (PARTITION BY passed ORDER BY cost, gs DESC, gm) rk FROM (SELECT CAST(gs AS int) gs, CAST(gm AS int) gm, count(*) FILTER (WHERE sep>=gs AND arm<=gm AND p2>=0.8) passed, count(*) FILTER (WHERE sep>=gs AND arm<=gm) cost FROM forks, (VALUES (4),(5),(6),(7)) s(gs), (VALUES (6),(8),(10),(12)) m(gm) GROUP BY ALL)) WHERE rk=1 AND passed>0""")
def gate_shortlist(spark, d):
    """Of gates with equal hits the one that keeps the fewest forks."""
    f = policies.fork_geometry(*graph(spark, d)).withColumn("gs", F.explode(F.array(*[F.lit(v) for v in (4, 5, 6, 7)]))).withColumn("gm", F.explode(F.array(*[F.lit(v) for v in (6, 8, 10, 12)])))
    ok = (F.col("sep") >= F.col("gs")) & (F.col("arm") <= F.col("gm"))
    a = f.groupBy("gs", "gm").agg(F.count(F.when(ok & (F.col("p2") >= 0.8), 1)).alias("passed"), F.count(F.when(ok, 1)).alias("cost"))
    w = Window.partitionBy("passed").orderBy("cost", F.desc("gs"), "gm")
    return a.withColumn("rk", F.row_number().over(w)).where("rk = 1 AND passed > 0").drop("rk")
