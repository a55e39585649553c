"""Queries over long gaps: tracks that end and tracks that begin several frames later, joined by constant motion from both sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import greedy, logistic, ranks, spatial, topology
from strandflow.plans import oracle
from strandflow.plans.evaluation import Study
from strandflow.plans.policies import saved_graph
from strandflow.plans.registry import query
from strandflow.sources.shared import save

#: Frames that may be missing, ranks asked of the two sides, limits of the shortlist and of the actions.
GAPS = (2, 12)
RANKS = (3, 8)
BEST, CUT_BEST = 8, 20
ACTION_RANKS, ACTION_SCORE = (1, 5), 0.5
#: How far from a prediction (micrometres) its neighbours are looked for, and how many count.
REACH, NEIGHBOURS = 20.0, 16
#: Width of the grid's cells in REACH: nearly a frame, as narrower ones copy each prediction eight times to compare it with most of a frame anyway.
WIDE = 8.0

V = oracle.VIEWS
_D = "sqrt(power({0}z-{1}z,2)+power({0}y-{1}y,2)+power({0}x-{1}x,2))"
V["gsrc"] = """SELECT a.dataset, a.node_id source_id, a.t, a.uz az, a.uy ay, a.ux ax, a.uz-p.uz vz, a.uy-p.uy vy, a.ux-p.ux vx, n.target_id incumbent, sqrt(power(2*a.uz-p.uz-b.uz,2)+power(2*a.uy-p.uy-b.uy,2)+power(2*a.ux-p.ux-b.ux,2)) incumbent_residual
 FROM nodes a JOIN edges e ON e.dataset=a.dataset AND e.target_id=a.node_id JOIN nodes p ON p.dataset=a.dataset AND p.node_id=e.source_id LEFT JOIN (SELECT dataset, source_id, min(target_id) target_id FROM edges GROUP BY ALL) n ON n.dataset=a.dataset AND n.source_id=a.node_id LEFT JOIN nodes b ON b.dataset=a.dataset AND b.node_id=n.target_id"""
V["gtgt"] = """SELECT c.dataset, c.node_id target_id, c.t, c.uz cz, c.uy cy, c.ux cx, d.uz-c.uz wz, d.uy-c.uy wy, d.ux-c.ux wx FROM nodes c JOIN (SELECT dataset, source_id, min(target_id) target_id FROM edges GROUP BY ALL) e ON e.dataset=c.dataset AND e.source_id=c.node_id
 JOIN nodes d ON d.dataset=c.dataset AND d.node_id=e.target_id ANTI JOIN ind i ON i.dataset=c.dataset AND i.node_id=c.node_id"""
V["gpairs"] = """SELECT * FROM (SELECT s.dataset, s.source_id, k.target_id, k.t-s.t dt, s.incumbent, s.incumbent_residual, sqrt(power(az+vz*(k.t-s.t)-cz,2)+power(ay+vy*(k.t-s.t)-cy,2)+power(ax+vx*(k.t-s.t)-cx,2)) forward,
  sqrt(power(cz-wz*(k.t-s.t)-az,2)+power(cy-wy*(k.t-s.t)-ay,2)+power(cx-wx*(k.t-s.t)-ax,2)) backward FROM gsrc s JOIN gtgt k ON k.dataset=s.dataset AND k.t-s.t BETWEEN 3 AND 13) WHERE forward<=20 AND backward<=20"""
V["gprop"] = """SELECT *, (forward+backward)/2/dt per_frame, incumbent_residual-(forward+backward)/2/dt improvement FROM (SELECT *, row_number() OVER (PARTITION BY dataset,source_id,dt ORDER BY round(forward,9),target_id) rf, row_number() OVER (PARTITION BY dataset,target_id,dt ORDER BY round(backward,9),source_id) rb FROM gpairs)
 WHERE (rf<=3 AND rb<=8) OR (rf<=8 AND rb<=3)"""
KINDS = {"sym": "(forward+backward)/2", "max": "greatest(forward,backward)", "gmean": "sqrt(forward*backward)"}
_RANKS = ", ".join(f"row_number() OVER (PARTITION BY dataset,source_id ORDER BY round({e}/dt,9),target_id) s_{k}, row_number() OVER (PARTITION BY dataset,target_id ORDER BY round({e}/dt,9),source_id) t_{k}" for k, e in KINDS.items())
RANKED = [f"{s}_{k}" for k in KINDS for s in ("s", "t")]
V["grank"] = f"SELECT *, least({', '.join(RANKED)}) best, greatest({', '.join(RANKED)}) worst, CASE WHEN incumbent IS NULL THEN 0 ELSE 1 END cuts FROM (SELECT *, {_RANKS} FROM gprop)"
V["gshort"] = f"SELECT * FROM grank WHERE best<={BEST} OR (cuts<=1 AND best<={CUT_BEST})"
FEATURES = {
    "forward": "forward", "backward": "backward", "per_frame": "per_frame", "log_gap": "ln(1+dt)", "asymmetry": "abs(forward-backward)/greatest(forward+backward,1e-9)", "smaller": "least(forward,backward)/dt", "greater": "greatest(forward,backward)/dt",
    "by_source": "n_source", "by_target": "n_target", "rank_source": "s_sym*1.0/n_source", "rank_target": "t_sym*1.0/n_target", "best": "best", "worst": "worst", "cuts": "cuts",
    "incumbent_residual": "incumbent_residual", "improvement": "improvement", "required": "per_frame-incumbent_residual/2", "lead": "next_best-per_frame",
}
V["gfeat"] = "SELECT dataset, source_id, target_id, dt, cuts cut, s_sym, t_sym, " + ", ".join(f"CAST({e.replace('1.0', '1.0::double').replace('1e-9', '1e-9::double')} AS double) f_{k}" for k, e in FEATURES.items()) + """ FROM (SELECT *, count(*) OVER (PARTITION BY dataset,source_id) n_source, count(*) OVER (PARTITION BY dataset,target_id) n_target,
  lead(per_frame) OVER (PARTITION BY dataset,source_id ORDER BY round(per_frame,9),target_id) next_best FROM gshort)"""
#: The scoring model: an intercept, and a weight for each standardised feature and for each that is missing, from a rule.
WEIGHTS = {k: ((i * 7) % 5 - 2) / 10 for i, k in enumerate(FEATURES)}
MISSING = {"incumbent_residual": 0.2, "improvement": -0.1, "required": 0.1, "lead": 0.05}
V["gstat"] = "SELECT " + ", ".join(f"quantile_cont(f_{k},0.5) m_{k}, avg(coalesce(f_{k},mm.m_{k})) a_{k}, stddev_pop(coalesce(f_{k},mm.m_{k})) d_{k}" for k in FEATURES) + " FROM gfeat, (SELECT " + ", ".join(f"quantile_cont(f_{k},0.5) m_{k}" for k in FEATURES) + " FROM gfeat) mm"
_SUM = "+".join([f"({w})*CASE WHEN d_{k}>1e-12 THEN (coalesce(f_{k},m_{k})-a_{k})/d_{k} ELSE 0 END" for k, w in WEIGHTS.items()] + [f"({w})*CASE WHEN f_{k} IS NULL THEN 1 ELSE 0 END" for k, w in MISSING.items()])
V["gscore"] = f"SELECT f.*, 1/(1+exp(-({_SUM}))) score FROM gfeat f, gstat"
_TAKE = f"SELECT *, (-round(score,9), source_id, target_id) AS ord, [source_id::varchar, target_id::varchar] AS res FROM gscore WHERE s_sym<={ACTION_RANKS[0]} AND t_sym<={ACTION_RANKS[1]} AND score>={ACTION_SCORE}"
V["gact"] = f"SELECT dataset, source_id, target_id, dt, cut, score FROM {oracle.greedy(_TAKE)} z WHERE ok"
oracle.MATERIALIZED |= {"gpairs", "gprop", "grank", "gfeat", "gscore", "gact"}


def spans(s, k):
    """One row per source (at its frame at) and gap dt that ends in the dataset's frames of targets (k, at t)."""
    last = save(k.groupBy("dataset").agg(F.max("t").alias("last")))
    low, high = GAPS
    s = s.join(last, "dataset").where(F.col("last") - F.col("at") > low)
    return s.withColumn("dt", F.explode(F.sequence(F.lit(low + 1), F.least(F.lit(high + 1), F.col("last") - F.col("at"))))).drop("last")


def proposals(n, e):
    """Pairs of a node with a past and a start with a future, 3 to 13 frames apart, that constant motion joins from both sides within REACH, near the top in both directions;
    if the source goes on already (its incumbent), how much better a frame's share of the gap fits than that link."""
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(f"{p}t"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    v = lambda p: tuple(F.col(f"{p}{u}") for u in g.AXES)
    child = e.groupBy("dataset", "source_id").agg(F.min("target_id").alias("child"))
    s = e.select("dataset", F.col("source_id").alias("past"), F.col("target_id").alias("source_id")).join(at("source_id", "a"), ["dataset", "source_id"]).join(at("past", "p"), ["dataset", "past"])
    s = s.join(child, ["dataset", "source_id"], "left").join(at("child", "b"), ["dataset", "child"], "left")
    s = s.withColumn("incumbent_residual", g.norm(g.sub(g.sub(g.times(v("a"), 2.0), v("p")), v("b"))))
    step = {f"v{u}": F.col(f"a{u}") - F.col(f"p{u}") for u in g.AXES}
    starts = child.withColumnRenamed("source_id", "target_id").join(e.select("dataset", "target_id"), ["dataset", "target_id"], "left_anti")
    k = starts.join(at("target_id", "c"), ["dataset", "target_id"]).join(at("child", "d"), ["dataset", "child"])
    k = save(k.select("dataset", F.col("ct").alias("t"), "target_id", *[F.col(f"c{u}") for u in g.AXES], *[(F.col(f"d{u}") - F.col(f"c{u}")).alias(f"w{u}") for u in g.AXES], *[F.col(f"c{u}").alias(u) for u in g.AXES]))
    s = spans(s.withColumns(step), k)
    probe = s.select("dataset", (F.col("at") + F.col("dt")).alias("t"), "source_id", "dt", F.col("child").alias("incumbent"), "incumbent_residual", *[F.col(f"a{u}") for u in g.AXES], *[(F.col(f"a{u}") + F.col(f"v{u}") * F.col("dt")).alias(u) for u in g.AXES])
    p = spatial.within(probe, k, ["dataset", "t"], REACH, WIDE).withColumnRenamed("dist", "forward")
    back = tuple(F.col(f"c{u}") - F.col(f"w{u}") * F.col("dt") - F.col(f"a{u}") for u in g.AXES)
    p = p.withColumn("backward", g.norm(back)).where(F.col("backward") <= REACH)
    p = p.withColumn("rf", F.row_number().over(Window.partitionBy("dataset", "source_id", "dt").orderBy(F.round("forward", 9), "target_id")))
    p = p.withColumn("rb", F.row_number().over(Window.partitionBy("dataset", "target_id", "dt").orderBy(F.round("backward", 9), "source_id")))
    near, far = RANKS
    p = p.where(((F.col("rf") <= near) & (F.col("rb") <= far)) | ((F.col("rf") <= far) & (F.col("rb") <= near))).where((F.col("rf") <= NEIGHBOURS) & (F.col("rb") <= NEIGHBOURS))
    p = p.withColumn("per_frame", (F.col("forward") + F.col("backward")) / 2 / F.col("dt"))
    return p.withColumn("improvement", F.col("incumbent_residual") - F.col("per_frame")).select("dataset", "source_id", "target_id", "dt", "incumbent", "incumbent_residual", "forward", "backward", "rf", "rb", "per_frame", "improvement")


def shortlist(p):
    """Proposals with their ranks at both ends by three measures, those that are good at one end at least."""
    for side, one, other in (("s", "source_id", "target_id"), ("t", "target_id", "source_id")):  # all ranks of an end at once: one exchange for each end
        for k, e in KINDS.items():
            p = p.withColumn(f"{side}_{k}", F.row_number().over(Window.partitionBy("dataset", one).orderBy(F.round(F.expr(e) / F.col("dt"), 9), other)))
    p = p.withColumns({"best": F.least(*RANKED), "worst": F.greatest(*RANKED), "cuts": F.when(F.col("incumbent").isNull(), 0).otherwise(1)})
    return p.where((F.col("best") <= BEST) | ((F.col("cuts") <= 1) & (F.col("best") <= CUT_BEST)))


def features(p):
    count = lambda k: F.count(F.lit(1)).over(Window.partitionBy("dataset", k))
    p = p.withColumn("n_target", count("target_id")).withColumn("n_source", count("source_id"))  # the shortlist is dealt by targets already
    p = p.withColumn("next_best", F.lead("per_frame").over(Window.partitionBy("dataset", "source_id").orderBy(F.round("per_frame", 9), "target_id")))
    exprs = [F.expr(e).cast("double").alias(f"f_{k}") for k, e in FEATURES.items()]
    return p.select("dataset", "source_id", "target_id", "dt", F.col("cuts").alias("cut"), "s_sym", "t_sym", *exprs)


def medians(f, names=FEATURES):
    """One row with the exact median of each feature; ranks are taken range by range."""
    long = f.select(*[f"f_{k}" for k in names]).unpivot([], [f"f_{k}" for k in names], "feature", "v")
    q = ranks.quantiles(long, ["feature"], "v", {"m": 0.5})
    return q.agg(*[F.max(F.when(F.col("feature") == f"f_{k}", F.col("m"))).alias(f"m_{k}") for k in names])


def scored(f):
    """The model's score: missing features take the median, all are standardised over the whole table (one row of statistics is broadcast)."""
    f = save(f)
    mid = medians(f)
    whole = f.crossJoin(F.broadcast(mid))
    full = lambda k: F.coalesce(f"f_{k}", f"m_{k}")
    stat = whole.agg(*[x for k in FEATURES for x in (F.avg(full(k)).alias(f"a_{k}"), F.stddev_pop(full(k)).alias(f"d_{k}"))])
    both = whole.crossJoin(F.broadcast(stat))
    total = sum((w * F.when(F.col(f"d_{k}") > 1e-12, (full(k) - F.col(f"a_{k}")) / F.col(f"d_{k}")).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((w * F.when(F.col(f"f_{k}").isNull(), 1.0).otherwise(0.0) for k, w in MISSING.items()), total)
    return both.withColumn("score", 1 / (1 + F.exp(-total))).select(*f.columns, "score")


def actions(s):
    """Proposals by descending score, each node serving one of them."""
    rank, far = ACTION_RANKS
    c = s.where((F.col("s_sym") <= rank) & (F.col("t_sym") <= far) & (F.col("score") >= ACTION_SCORE)).withColumn("o", -F.round("score", 9))
    c = c.select("dataset", "source_id", "target_id", "dt", "cut", "score", "o", F.col("source_id").alias("r0"), F.col("target_id").alias("r1"))
    return greedy.ordered_greedy(c, ["dataset"], ["o", "source_id", "target_id"], ["r0", "r1"]).drop("o", "r0", "r1")


def all_proposals(spark, d):
    n, e = saved_graph(spark, d)
    return save(proposals(n, e)), e


@query("SELECT dataset, source_id, target_id, dt, rf, rb, round(forward,6) forward, round(backward,6) backward, round(per_frame,6) per_frame, round(coalesce(improvement,-99),6) improvement, coalesce(improvement>0,false) dominates FROM gprop")
def gap_proposals(spark, d):
    p, _ = all_proposals(spark, d)
    better = F.coalesce(F.col("improvement") > 0, F.lit(False)).alias("dominates")
    return p.select("dataset", "source_id", "target_id", "dt", "rf", "rb", *[F.round(c, 6).alias(c) for c in ("forward", "backward", "per_frame")], F.round(F.coalesce("improvement", F.lit(-99.0)), 6).alias("improvement"), better)


@query(f"SELECT dataset, source_id, target_id, {', '.join(RANKED)}, best, worst, cuts FROM gshort")
def gap_shortlist(spark, d):
    p, _ = all_proposals(spark, d)
    return shortlist(p).select("dataset", "source_id", "target_id", *RANKED, "best", "worst", "cuts")


@query("SELECT dataset, source_id, target_id, " + ", ".join(f"round(coalesce(f_{k},-99),5) {k}" for k in FEATURES) + " FROM gfeat")
def gap_features(spark, d):
    p, _ = all_proposals(spark, d)
    return features(shortlist(p)).select("dataset", "source_id", "target_id", *[F.round(F.coalesce(f"f_{k}", F.lit(-99.0)), 5).alias(k) for k in FEATURES])


@query("SELECT dataset, source_id, target_id, round(score,5) score FROM gscore")
def gap_scores(spark, d):
    p, _ = all_proposals(spark, d)
    return scored(features(shortlist(p))).select("dataset", "source_id", "target_id", F.round("score", 5).alias("score"))


@query("SELECT dataset, source_id, target_id, dt, cut, round(score,5) score FROM gact")
def gap_actions(spark, d):
    p, _ = all_proposals(spark, d)
    return actions(scored(features(shortlist(p)))).withColumn("score", F.round("score", 5))


@query("SELECT d.dataset, coalesce(e.n,0) edges_before, coalesce(a.n,0) added, coalesce(a.c,0) removed, coalesce(e.n,0)+coalesce(a.n,0)-coalesce(a.c,0) edges_after FROM datasets d LEFT JOIN (SELECT dataset, count(*) n FROM edges GROUP BY 1) e USING (dataset) LEFT JOIN (SELECT a.dataset, count(*) n, sum(coalesce(k,0))::bigint c FROM gact a LEFT JOIN (SELECT dataset, source_id, count(*) k FROM edges GROUP BY ALL) o USING (dataset,source_id) GROUP BY 1) a USING (dataset)")
def gap_apply(spark, d):
    """The graph with gap actions applied, counted by dataset: a source's incumbent edges go, the candidate comes with probability 1."""
    from strandflow.sources import tracks

    p, e = all_proposals(spark, d)
    a = save(actions(scored(features(shortlist(p)))))
    gone = e.join(a.select("dataset", "source_id"), ["dataset", "source_id"], "left_semi")
    new = a.select("dataset", (F.col("source_id") * 100000000 + F.col("target_id")).alias("edge_id"), "source_id", "target_id", F.lit(1.0).alias("edge_prob"))
    after = e.join(gone.select("dataset", "edge_id"), ["dataset", "edge_id"], "left_anti").unionByName(new)
    tall = None
    for k, df in (("edges_before", e), ("added", a), ("removed", gone), ("edges_after", after)):
        one = df.select("dataset", F.lit(k).alias("k"))
        tall = one if tall is None else tall.unionByName(one)
    counts = tall.groupBy("dataset").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("edges_before", "added", "removed", "edges_after")])
    return tracks.datasets(tracks.nodes(spark, d)).select("dataset").join(counts, "dataset", "left").fillna(0)


# ---- a model learned from proposals that the annotation can judge
LEARNED = [f"f_{k}" for k in FEATURES] + [f"missing_{k}" for k in MISSING]


def judged(f, s: Study, names=FEATURES, missing=MISSING):
    """Proposals of which both ends are matched, with label 1 if one annotated lineage holds both, medians for what is missing, and their fold."""
    lineage = topology.components(s.gt_nodes, s.gt_edges).select("dataset", F.col("node_id").alias("gt_id"), "component")
    m = save(s.matches.join(lineage, ["dataset", "gt_id"]).select("dataset", "node_id", "component"))
    end = lambda k, c: m.select("dataset", F.col("node_id").alias(k), F.col("component").alias(c))
    both = f.join(end("source_id", "ca"), ["dataset", "source_id"]).join(end("target_id", "cb"), ["dataset", "target_id"]).withColumn("label", (F.col("ca") == F.col("cb")).cast("int")).drop("ca", "cb")
    both = both.withColumns({f"missing_{k}": F.col(f"f_{k}").isNull().cast("double") for k in missing}).join(F.broadcast(medians(f, names)))
    both = both.withColumns({f"f_{k}": F.coalesce(f"f_{k}", f"m_{k}", F.lit(0.0)) for k in names}).drop(*[f"m_{k}" for k in names])
    return save(both.join(s.sizes.select("dataset", "fold"), "dataset").withColumn("family", F.lit("all")))


@query()
def gap_model(spark, d):
    """Held-out AUC of a model of all features, learned from the other folds' judged proposals, beside that of the plain rank (per_frame), by fold."""
    p, _ = all_proposals(spark, d)
    rows = judged(save(features(shortlist(p))), Study(spark, d))
    fitted = logistic.fit(rows, LEARNED, "family", "fold", "label", ridge=10.0)
    out = save(logistic.scored(rows, fitted, LEARNED, "family", "fold").select("fold", "label", "score", (-F.col("f_per_frame")).alias("plain")))
    model, plain = ranks.auc(out, ["fold"], "score", "label"), ranks.auc(out, ["fold"], "plain", "label")
    return model.select("fold", "n", F.col("p").alias("positives"), F.round("auc", 6).alias("auc_model")).join(plain.select("fold", F.round("auc", 6).alias("auc_plain")), "fold")
