"""Queries that choose among gates and selectors by what annotated divisions and links say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import association as A
from strandflow.operators import policies
from strandflow.plans import oracle
from strandflow.plans.graph import gt
from strandflow.plans.policies import graph
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save

#: The gates tried, the one in use, the probability that a second link needs, and what a better gate has to show.
GRID = {"sep_gate": (4, 5, 6, 7), "angle_gate": (60, 90, 120, 140), "arm_gate": (6, 8, 10, 12), "balance_gate": (0.4, 0.5, 0.6)}
FROZEN = {"sep_gate": 6, "angle_gate": 120, "arm_gate": 8, "balance_gate": 0.5}
SECOND = 0.8
GAIN, INFLATION, OUTLIER = 15, 3, 10  # per cent, times, per cent

V = oracle.VIEWS
V["truth"] = """SELECT s.fold, sep, greatest(d1,d2) arm, abs(d1-d2)/greatest(d1+d2,1e-12::double) balance, CASE WHEN d1*d2>0 THEN degrees(acos(least(greatest(dp/(d1*d2),-1.0::double),1.0::double))) ELSE 'nan'::double END angle FROM
 (SELECT dataset, sqrt(az*az+ay*ay+ax*ax) d1, sqrt(bz*bz+byy*byy+bx*bx) d2, sqrt((az-bz)*(az-bz)+(ay-byy)*(ay-byy)+(ax-bx)*(ax-bx)) sep, az*bz+ay*byy+ax*bx dp FROM (SELECT g.dataset, a.uz-p.uz az, a.uy-p.uy ay, a.ux-p.ux ax, b.uz-p.uz bz, b.uy-p.uy byy, b.ux-p.ux bx
  FROM gdiv g JOIN gt_nodes p ON p.dataset=g.dataset AND p.node_id=g.parent JOIN gt_nodes a ON a.dataset=g.dataset AND a.node_id=g.g1 JOIN gt_nodes b ON b.dataset=g.dataset AND b.node_id=g.g2)) JOIN datasets s USING (dataset)"""
_IN = "sep>=sep_gate AND NOT isnan(angle) AND angle>=angle_gate AND arm<=arm_gate AND balance<=balance_gate"
V["ggrid"] = "SELECT * FROM (SELECT unnest([4,5,6,7])::int sep_gate), (SELECT unnest([60,90,120,140])::int angle_gate), (SELECT unnest([6,8,10,12])::int arm_gate), (SELECT unnest([0.4,0.5,0.6])::double balance_gate)"
V["gfold"] = f"SELECT sep_gate, angle_gate, arm_gate, balance_gate, fold, count(*) n, count(*) FILTER (WHERE {_IN}) k FROM truth, ggrid GROUP BY ALL"
V["gaccepted"] = f"SELECT sep_gate, angle_gate, arm_gate, balance_gate, count(*) FILTER (WHERE {_IN} AND p2>={SECOND}) accepted FROM forks, ggrid GROUP BY ALL"
_IS = " AND ".join(f"{k}={v}" for k, v in FROZEN.items())
V["gstable"] = f"""SELECT g.*, coalesce(accepted,0) accepted, round(least_share,6) least_fold, NOT ({_IS}) AND 100*(passed-kf)>={GAIN}*n AND stable AND accepted<={INFLATION}*af AND af>0 eligible FROM
 (SELECT sep_gate, angle_gate, arm_gate, balance_gate, sum(n)::bigint n, sum(k)::bigint passed, min(k*1.0::double/n) least_share, min(k*nf-kf*n)>=0 stable, any_value(kf) kf FROM gfold, (SELECT sum(n)::bigint nf, sum(k)::bigint kf FROM gfold WHERE {_IS}) GROUP BY ALL) g
 LEFT JOIN gaccepted USING (sep_gate,angle_gate,arm_gate,balance_gate), (SELECT coalesce(sum(accepted),0)::bigint af FROM gaccepted WHERE {_IS})"""
oracle.MATERIALIZED |= {"truth", "gfold", "gaccepted"}


def gated(forks):
    """Forks beside every gate of the grid, with whether they pass."""
    for name, levels in GRID.items():
        forks = forks.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return forks.withColumn("inside", F.expr(_IN))


def annotated_forks(spark, d):
    """Geometry of the annotated divisions with two daughters, and their dataset's fold."""
    n, e = gt(spark, d)
    f = policies.fork_geometry(n, e.withColumns({"edge_id": F.col("target_id"), "edge_prob": F.lit(1.0)}))
    return f.join(tracks.datasets(tracks.nodes(spark, d)).select("dataset", "fold"), "dataset").select("dataset", "fold", "sep", "angle", "arm", "balance")


def by_fold(truth):
    return gated(truth).groupBy(*GRID, "fold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inside"), 1)).alias("k"))


def judged_gates(folds, accepted):
    """Every gate with its recall over annotated divisions, the forks that it lets through, and whether it may replace the frozen one.

    folds has n and k by gate and fold, accepted one count by gate. A gate is eligible if it finds more by GAIN per cent, falls in no fold
    below what the frozen gate finds on the whole, and accepts at most INFLATION times as many forks; compared in integers. Of eligible gates
    with the same recall the one that accepts fewest is chosen. The tables that are broadcast are one row each.
    """
    frozen = F.expr(_IS)
    base = folds.where(frozen).agg(F.sum("n").alias("nf"), F.sum("k").alias("kf"))
    whole = folds.crossJoin(F.broadcast(base)).groupBy(*GRID).agg(
        F.sum("n").alias("n"), F.sum("k").alias("passed"), F.round(F.min(F.col("k") / F.col("n")), 6).alias("least_fold"), (F.min(F.col("k") * F.col("nf") - F.col("kf") * F.col("n")) >= 0).alias("stable"), F.max("kf").alias("kf")
    )
    most = accepted.where(frozen).agg(F.coalesce(F.sum("accepted"), F.lit(0)).alias("af"))
    a = whole.join(accepted, [*GRID], "left").fillna(0, ["accepted"]).crossJoin(F.broadcast(most))
    a = a.withColumn("eligible", ~frozen & (100 * (F.col("passed") - F.col("kf")) >= GAIN * F.col("n")) & F.col("stable") & (F.col("accepted") <= INFLATION * F.col("af")) & (F.col("af") > 0))
    w = Window.partitionBy("passed", "eligible").orderBy("accepted", *GRID)
    return a.withColumn("chosen", F.col("eligible") & (F.row_number().over(w) == 1)).select(*GRID, "n", "passed", "least_fold", "accepted", "eligible", "chosen")


@query("""SELECT sep_gate, angle_gate, arm_gate, balance_gate, n, passed, least_fold, accepted, eligible, eligible AND row_number() OVER (PARTITION BY passed,eligible ORDER BY accepted,sep_gate,angle_gate,arm_gate,balance_gate)=1 chosen FROM gstable""")
def gate_replacements(spark, d):
    """All gates by gain in recall, worst fold and forks let through; the cheapest eligible one of each recall is chosen."""
    f = policies.fork_geometry(*graph(spark, d))
    accepted = gated(f).groupBy(*GRID).agg(F.count(F.when(F.col("inside") & (F.col("p2") >= SECOND), 1)).alias("accepted"))
    return judged_gates(save(by_fold(annotated_forks(spark, d))), save(accepted))


def outliers(folds):
    """Folds (fold, n, k: one row each, few) whose share lies more than OUTLIER per cent outside all others'."""
    share = F.col("k") / F.col("n")
    every = folds.agg(F.collect_list(F.struct("fold", "n", "k")).alias("every"))
    others = F.filter("every", lambda x: x["fold"] != F.col("fold"))
    # 100 k / n against 100 k' / n' -+ OUTLIER, in integers
    below = F.forall(others, lambda x: 100 * F.col("k") * x["n"] < 100 * x["k"] * F.col("n") - OUTLIER * F.col("n") * x["n"])
    above = F.forall(others, lambda x: 100 * F.col("k") * x["n"] > 100 * x["k"] * F.col("n") + OUTLIER * F.col("n") * x["n"])
    return folds.crossJoin(F.broadcast(every)).select("fold", "n", F.col("k").alias("passed"), F.round(share, 6).alias("share"), ((F.size(others) > 0) & (below | above)).alias("outlier"))


V["gfrozen"] = f"SELECT fold, n, k FROM gfold WHERE {_IS}"


@query(f"""SELECT a.fold, a.n, a.k passed, round(a.k*1.0::double/a.n,6) share, count(b.fold)>0 AND (coalesce(bool_and(100*a.k*b.n<100*b.k*a.n-{OUTLIER}*a.n*b.n),false) OR coalesce(bool_and(100*a.k*b.n>100*b.k*a.n+{OUTLIER}*a.n*b.n),false)) outlier
 FROM gfrozen a LEFT JOIN gfrozen b ON a.fold<>b.fold GROUP BY ALL""")
def gate_fold_outliers(spark, d):
    """What the frozen gate finds of annotated divisions by fold, and which fold stands apart from all others."""
    return outliers(save(by_fold(annotated_forks(spark, d)).where(_IS).select("fold", "n", "k")))


V["gkept"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset,t,source_id ORDER BY round(prob,9) DESC, target_id DESC) rk FROM probs WHERE prob>0.5) WHERE rk<=2"
V["gpassed"] = """SELECT g.dataset, g.source_id, g.target_id, p.prob, p.raw_logit, o.n o, o.weakest, i.raw_logit rival FROM gt_edges g ANTI JOIN gkept k USING (dataset,source_id,target_id) LEFT JOIN probs p ON p.dataset=g.dataset AND p.source_id=g.source_id AND p.target_id=g.target_id
  LEFT JOIN (SELECT dataset, source_id, count(*) n, min(raw_logit) weakest FROM gkept GROUP BY ALL) o ON o.dataset=g.dataset AND o.source_id=g.source_id LEFT JOIN gkept i ON i.dataset=g.dataset AND i.target_id=g.target_id"""
oracle.MATERIALIZED |= {"gkept"}


@query("""SELECT status, count(*) n, count(weakest) with_sibling, count(*) FILTER (WHERE round(raw_logit-weakest,9)>0) beats_sibling, count(rival) with_rival, count(*) FILTER (WHERE round(raw_logit-rival,9)>0) beats_rival, round(max(raw_logit-weakest),6) best_lead FROM
 (SELECT *, CASE WHEN prob IS NULL THEN 'out_of_reach' WHEN rival IS NOT NULL AND coalesce(o,0)>=2 THEN 'both_blocked' WHEN rival IS NOT NULL THEN 'target_occupied' WHEN coalesce(o,0)>=2 THEN 'source_capacity' ELSE 'low_confidence_free_slot' END status FROM gpassed) GROUP BY 1""")
def selector_retained(spark, d):
    """Annotated links that the greedy selector passes over: do their raw scores beat a link that it keeps from the same source (sibling) or to the same target (rival)?"""
    n = tracks.nodes(spark, d)
    p = save(A.column_softmax(tracks.pair_scores(n)))
    kept = save(A.greedy_edges(p).select("dataset", "source_id", "target_id", "raw_logit"))
    key = ["dataset", "source_id", "target_id"]
    m = tracks.gt_edges(tracks.gt_nodes(n)).select(*key).join(kept, key, "left_anti").join(p.select(*key, "prob", "raw_logit"), key, "left")
    m = m.join(kept.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("o"), F.min("raw_logit").alias("weakest")), ["dataset", "source_id"], "left")
    m = m.join(kept.select("dataset", "target_id", F.col("raw_logit").alias("rival")), ["dataset", "target_id"], "left")
    full, taken = F.coalesce(F.col("o") >= 2, F.lit(False)), F.col("rival").isNotNull()
    status = F.when(F.col("prob").isNull(), "out_of_reach").when(taken & full, "both_blocked").when(taken, "target_occupied").when(full, "source_capacity").otherwise("low_confidence_free_slot")
    over = lambda c: F.count(F.when(F.round(F.col("raw_logit") - F.col(c), 9) > 0, 1))
    return m.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count("weakest").alias("with_sibling"), over("weakest").alias("beats_sibling"), F.count("rival").alias("with_rival"), over("rival").alias("beats_rival"), F.round(F.max(F.col("raw_logit") - F.col("weakest")), 6).alias("best_lead")
    )
