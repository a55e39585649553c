"""Queries over association scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import association as A
from strandflow.plans.policies import rounded
from strandflow.plans.registry import query
from strandflow.sources import tracks

PAIR = ["dataset", "t", "source_id", "target_id"]
P = "dataset, t, source_id, target_id"
COL, ROW = "PARTITION BY dataset,t,target_id", "PARTITION BY dataset,t,source_id"


def probs(spark, d):
    return A.column_softmax(tracks.pair_scores(tracks.nodes(spark, d)))


@query(f"SELECT {P}, round(raw_logit,6) raw_logit, round(prob,6) prob FROM probs")
def column_softmax(spark, d):
    return rounded(probs(spark, d), "raw_logit", "prob").select(*PAIR, "raw_logit", "prob")


@query(f"SELECT {P}, round(1/(1+exp(-raw_logit)),6) prob FROM pair_scores")
def sigmoid_scores(spark, d):
    s = tracks.pair_scores(tracks.nodes(spark, d))
    return s.select(*PAIR, F.round(1 / (1 + F.exp(-F.col("raw_logit"))), 6).alias("prob"))


@query(f"SELECT {P} FROM (SELECT *, row_number() OVER ({ROW} ORDER BY round(prob,9) DESC, target_id DESC) rk FROM probs WHERE prob>0.5) WHERE rk<=2")
def greedy_edges(spark, d):
    return A.greedy_edges(probs(spark, d)).select(*PAIR)


@query(f"SELECT {P}, rank, top1, coalesce(top2,-1) top2, round(margin,6) margin, size FROM (SELECT *, CAST(row_number() OVER w AS int) rank, first_value(source_id) OVER w top1, nth_value(source_id,2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) top2, first_value(prob) OVER w - prob margin, count(*) OVER ({COL}) size FROM probs WINDOW w AS ({COL} ORDER BY prob DESC, source_id))")
def column_stats(spark, d):
    return rounded(A.column_stats(probs(spark, d)), "margin").fillna(-1, ["top2"]).select(*PAIR, "rank", "top1", "top2", "margin", "size")


@query(f"SELECT {P}, rank, top1, coalesce(top2,-1) top2, coalesce(top3,-1) top3, size FROM (SELECT *, CAST(row_number() OVER w AS int) rank, first_value(target_id) OVER w top1, nth_value(target_id,2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) top2, nth_value(target_id,3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) top3, count(*) OVER ({ROW}) size FROM pair_scores WINDOW w AS ({ROW} ORDER BY raw_logit DESC, target_id))")
def row_stats(spark, d):
    return A.row_stats(tracks.pair_scores(tracks.nodes(spark, d))).fillna(-1, ["top2", "top3"]).select(*PAIR, "rank", "top1", "top2", "top3", "size")


TOP2 = f"(SELECT dataset, t, source_id, max(CASE WHEN rk=1 THEN target_id END) t1, max(CASE WHEN rk=2 THEN target_id END) t2, max(CASE WHEN rk=1 THEN raw_logit END) raw1, max(CASE WHEN rk=2 THEN raw_logit END) raw2 FROM (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rk FROM pair_scores) WHERE rk<=2 GROUP BY ALL)"


@query(f"SELECT dataset, t, source_id, t1, t2, round(raw1,6) raw1, round(raw2,6) raw2 FROM {TOP2} z WHERE t2 IS NOT NULL")
def top2_targets(spark, d):
    return rounded(A.top2_targets(tracks.pair_scores(tracks.nodes(spark, d))).where("t2 IS NOT NULL"), "raw1", "raw2")


@query(f"""SELECT dataset, t, source_id, round(d1,6) d1, round(d2,6) d2, round(sep,6) sep, round(CASE WHEN d1*d2>0 THEN degrees(acos(least(greatest(dp/(d1*d2),-1.0::double),1.0::double))) ELSE 0 END,4) angle, round(abs(d1-d2)/greatest(d1+d2,1e-12::double),6) balance FROM
 (SELECT *, sqrt(az*az+ay*ay+ax*ax) d1, sqrt(bz*bz+byy*byy+bx*bx) d2, sqrt((az-bz)*(az-bz)+(ay-byy)*(ay-byy)+(ax-bx)*(ax-bx)) sep, az*bz+ay*byy+ax*bx dp FROM (SELECT z.dataset, z.t, z.source_id, a.uz-s.uz az, a.uy-s.uy ay, a.ux-s.ux ax, b.uz-s.uz bz, b.uy-s.uy byy, b.ux-s.ux bx FROM {TOP2} z
 JOIN nodes s ON s.dataset=z.dataset AND s.node_id=z.source_id JOIN nodes a ON a.dataset=z.dataset AND a.node_id=z.t1 JOIN nodes b ON b.dataset=z.dataset AND b.node_id=z.t2))""")
def candidate_geometry(spark, d):
    """Geometry of each source with its two best targets; the angle of a degenerate fork is 0."""
    n = tracks.nodes(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    j = A.top2_targets(tracks.pair_scores(n)).where("t2 IS NOT NULL").join(at("source_id", "s"), ["dataset", "source_id"]).join(at("t1", "a"), ["dataset", "t1"]).join(at("t2", "b"), ["dataset", "t2"])
    v = lambda p: tuple(F.col(f"{p}{u}") for u in g.AXES)
    a, b = g.sub(v("a"), v("s")), g.sub(v("b"), v("s"))
    d1, d2 = g.norm(a), g.norm(b)
    return j.select("dataset", "t", "source_id", F.round(d1, 6).alias("d1"), F.round(d2, 6).alias("d2"), F.round(g.norm(g.sub(a, b)), 6).alias("sep"), F.round(F.nanvl(g.angle(a, b), F.lit(0.0)), 4).alias("angle"), F.round(g.division_balance(d1, d2), 6).alias("balance"))


RECIP = f"(SELECT * FROM (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) ra, row_number() OVER ({COL} ORDER BY prob DESC, source_id) rb FROM {{}}) WHERE ra=1 AND rb=1)"
FREE = "(SELECT p.* FROM probs p ANTI JOIN outd o ON o.dataset=p.dataset AND o.node_id=p.source_id ANTI JOIN ind i ON i.dataset=p.dataset AND i.node_id=p.target_id)"


@query(f"SELECT {P} FROM {RECIP.format('probs')} z")
def reciprocal_pairs(spark, d):
    return A.reciprocal(probs(spark, d)).select(*PAIR)


@query(f"SELECT {P}, round(prob,6) prob FROM {RECIP.format('probs')} p WHERE prob>=0.25 AND NOT EXISTS (SELECT 1 FROM outd o WHERE o.dataset=p.dataset AND o.node_id=p.source_id) AND NOT EXISTS (SELECT 1 FROM ind i WHERE i.dataset=p.dataset AND i.node_id=p.target_id)")
def mutual_continuation_v1(spark, d):
    """Reciprocal on the full matrix, then free at both ends."""
    n = tracks.nodes(spark, d)
    return rounded(A.free_pairs(A.reciprocal(A.column_softmax(tracks.pair_scores(n))).where("prob >= 0.25"), tracks.edges(n)), "prob").select(*PAIR, "prob")


@query(f"SELECT {P}, round(prob,6) prob FROM {RECIP.format(FREE + ' z')} p WHERE prob>=0.25")
def mutual_continuation_v2(spark, d):
    """Reciprocal within what is free; the probability is the full matrix's."""
    n = tracks.nodes(spark, d)
    return rounded(A.reciprocal(A.free_pairs(A.column_softmax(tracks.pair_scores(n)), tracks.edges(n))).where("prob >= 0.25"), "prob").select(*PAIR, "prob")


RULES = f"""(SELECT {P}, prob, unnest(list_filter([CASE WHEN prob>0.5 THEN 'column>0.5' END, CASE WHEN prob>0.4 THEN 'column>0.4' END, CASE WHEN prob>0.3 THEN 'column>0.3' END, CASE WHEN prob>0.2 THEN 'column>0.2' END, CASE WHEN rc<=2 THEN 'column_top2' END, CASE WHEN rr<=2 THEN 'row_top2' END, CASE WHEN rr<=3 THEN 'row_top3' END], lambda v: v IS NOT NULL)) AS rule
 FROM (SELECT *, row_number() OVER ({COL} ORDER BY prob DESC, source_id) rc, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rr FROM probs))"""


@query(f"SELECT rule, dataset, count(*) n FROM {RULES} z GROUP BY ALL")
def candidate_rules(spark, d):
    return A.candidate_rules(probs(spark, d)).groupBy("rule", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rule, sum(n)::bigint edges, count(*) sources, count(*) FILTER (WHERE n>=2) forks FROM (SELECT rule, dataset, t, source_id, count(*) n FROM {RULES} z GROUP BY ALL) GROUP BY 1")
def rule_fork_counts(spark, d):
    k = A.candidate_rules(probs(spark, d)).groupBy("rule", "dataset", "t", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("rule").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("n") >= 2, 1)).alias("forks"))


@query(f"""SELECT f.dataset, f.source_id, round(least(p1,p2),6) min_prob, round(greatest(p1,p2),6) max_prob, round(p1*p2,6) product, round(abs(p1-p2),6) gap, round(a.raw_logit+b.raw_logit,6) logit_sum, greatest(a.rr,b.rr) row_rank, greatest(a.rc,b.rc) column_rank, a.rc=1 AND b.rc=1 both_lead_columns, greatest(a.rr,b.rr)<=2 both_lead_row FROM forkpairs f
 JOIN (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rr, row_number() OVER ({COL} ORDER BY prob DESC, source_id) rc FROM probs) a ON a.dataset=f.dataset AND a.source_id=f.source_id AND a.target_id=f.c1 JOIN (SELECT *, row_number() OVER ({ROW} ORDER BY raw_logit DESC, target_id) rr, row_number() OVER ({COL} ORDER BY prob DESC, source_id) rc FROM probs) b ON b.dataset=f.dataset AND b.source_id=f.source_id AND b.target_id=f.c2""")
def fork_evidence(spark, d):
    """Probabilities of a fork's two links, the sum of their raw logits, and how they rank in row and column."""
    from strandflow.operators import policies

    n = tracks.nodes(spark, d)
    f = policies.fork_geometry(n, tracks.edges(n))
    p = A.column_softmax(tracks.pair_scores(n)).withColumns({"rr": F.row_number().over(A.row().orderBy(F.desc("raw_logit"), "target_id")), "rc": F.row_number().over(A.column().orderBy(F.desc("prob"), "source_id"))})
    side = lambda k, x: p.select("dataset", "source_id", F.col("target_id").alias(k), *[F.col(c).alias(f"{x}_{c}") for c in ("raw_logit", "rr", "rc")])
    f = f.join(side("c1", "a"), ["dataset", "source_id", "c1"]).join(side("c2", "b"), ["dataset", "source_id", "c2"])
    r = lambda x, k: F.round(x, 6).alias(k)
    rows, cols = F.greatest("a_rr", "b_rr"), F.greatest("a_rc", "b_rc")
    return f.select(
        "dataset", "source_id", r(F.least("p1", "p2"), "min_prob"), r(F.greatest("p1", "p2"), "max_prob"), r(F.col("p1") * F.col("p2"), "product"), r(F.abs(F.col("p1") - F.col("p2")), "gap"),
        r(F.col("a_raw_logit") + F.col("b_raw_logit"), "logit_sum"), rows.alias("row_rank"), cols.alias("column_rank"), (cols == 1).alias("both_lead_columns"), (rows <= 2).alias("both_lead_row"),
    )


ACTIVE = f"(SELECT p.*, e.edge_id IS NOT NULL hit, max(CASE WHEN e.edge_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.dataset,p.t,p.source_id) ra, max(CASE WHEN e.edge_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.dataset,p.t,p.target_id) ca FROM probs p LEFT JOIN edges e ON e.dataset=p.dataset AND e.source_id=p.source_id AND e.target_id=p.target_id)"


@query(f"SELECT dataset, count(*) n, round(avg(CASE WHEN (prob>0.5)=hit THEN 1.0 ELSE 0 END),6) accuracy FROM {ACTIVE} z WHERE ra=1 OR ca=1 GROUP BY 1")
def transition_accuracy(spark, d):
    """Pairs of annotated rows or columns: is the probability on the right side of one half?"""
    n = tracks.nodes(spark, d)
    e = tracks.edges(n).select("dataset", "source_id", "target_id", F.lit(1).alias("hit"))
    p = A.column_softmax(tracks.pair_scores(n)).join(e, ["dataset", "source_id", "target_id"], "left").fillna(0, ["hit"])
    p = p.withColumns({"ra": F.max("hit").over(A.row()), "ca": F.max("hit").over(A.column())}).where("ra = 1 OR ca = 1")
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("prob") > 0.5) == (F.col("hit") == 1)).cast("double")), 6).alias("accuracy"))


MISSED = "(SELECT g.dataset, g.source_id, g.target_id FROM gt_edges g ANTI JOIN edges e USING (dataset,source_id,target_id))"


@query(f"""SELECT status, count(*) n FROM (SELECT CASE WHEN p.prob IS NULL THEN 'out_of_reach' WHEN i.node_id IS NOT NULL AND coalesce(o.out_degree,0)>=2 THEN 'both_blocked' WHEN i.node_id IS NOT NULL THEN 'target_occupied' WHEN coalesce(o.out_degree,0)>=2 THEN 'source_capacity' ELSE 'low_confidence_free_slot' END status
 FROM {MISSED} m LEFT JOIN probs p USING (dataset,source_id,target_id) LEFT JOIN outd o ON o.dataset=m.dataset AND o.node_id=m.source_id LEFT JOIN ind i ON i.dataset=m.dataset AND i.node_id=m.target_id) GROUP BY 1""")
def selector_barrier(spark, d):
    """What kept annotated links that the graph lacks from being chosen."""
    n = tracks.nodes(spark, d)
    e = tracks.edges(n)
    missed = tracks.gt_edges(tracks.gt_nodes(n)).join(e, ["dataset", "source_id", "target_id"], "left_anti")
    out = e.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("o"))
    inn = e.select("dataset", "target_id").distinct().withColumn("i", F.lit(1))
    p = A.column_softmax(tracks.pair_scores(n)).select("dataset", "source_id", "target_id", "prob")
    j = missed.join(p, ["dataset", "source_id", "target_id"], "left").join(out, ["dataset", "source_id"], "left").join(inn, ["dataset", "target_id"], "left")
    full, taken = F.coalesce(F.col("o") >= 2, F.lit(False)), F.col("i").isNotNull()
    s = F.when(F.col("prob").isNull(), "out_of_reach").when(taken & full, "both_blocked").when(taken, "target_occupied").when(full, "source_capacity").otherwise("low_confidence_free_slot")
    return j.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT cause, count(*) n FROM (SELECT CASE WHEN p.prob IS NULL THEN 'other' WHEN p.rank=1 AND p.prob<=0.5 THEN 'threshold' WHEN p.rank=1 THEN 'degree' WHEN p.margin<0.20 THEN 'competitor' ELSE 'model' END cause
 FROM {MISSED} m LEFT JOIN (SELECT *, row_number() OVER w rank, first_value(prob) OVER w - prob margin FROM probs WINDOW w AS ({COL} ORDER BY prob DESC, source_id)) p USING (dataset,source_id,target_id)) GROUP BY 1""")
def missing_edge_cause(spark, d):
    n = tracks.nodes(spark, d)
    missed = tracks.gt_edges(tracks.gt_nodes(n)).join(tracks.edges(n), ["dataset", "source_id", "target_id"], "left_anti")
    p = A.column_stats(A.column_softmax(tracks.pair_scores(n))).select("dataset", "source_id", "target_id", "prob", "rank", "margin")
    j = missed.join(p, ["dataset", "source_id", "target_id"], "left")
    c = F.when(F.col("prob").isNull(), "other").when((F.col("rank") == 1) & (F.col("prob") <= 0.5), "threshold").when(F.col("rank") == 1, "degree").when(F.col("margin") < 0.20, "competitor").otherwise("model")
    return j.groupBy(c.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT status, count(*) n FROM (SELECT CASE WHEN c.source_id IS NOT NULL THEN 'claimed_by_competitor' WHEN coalesce(o.out_degree,0)>=2 THEN 'unclaimed_at_cap' ELSE 'unclaimed_below_cap' END status
 FROM {MISSED} m LEFT JOIN edges c ON c.dataset=m.dataset AND c.target_id=m.target_id LEFT JOIN outd o ON o.dataset=m.dataset AND o.node_id=m.source_id) GROUP BY 1""")
def missing_edge_status(spark, d):
    n = tracks.nodes(spark, d)
    e = tracks.edges(n)
    missed = tracks.gt_edges(tracks.gt_nodes(n)).join(e, ["dataset", "source_id", "target_id"], "left_anti")
    j = missed.join(e.select("dataset", "target_id", F.lit(1).alias("c")), ["dataset", "target_id"], "left").join(e.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("o")), ["dataset", "source_id"], "left")
    s = F.when(F.col("c").isNotNull(), "claimed_by_competitor").when(F.col("o") >= 2, "unclaimed_at_cap").otherwise("unclaimed_below_cap")
    return j.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))
