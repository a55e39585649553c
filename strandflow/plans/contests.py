"""Long gaps contested by the links there are: both ends of a proposal may be occupied, and constant motion must beat what they would lose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import greedy, logistic, ranks, spatial
from strandflow.plans import gaps, oracle
from strandflow.plans.evaluation import Study
from strandflow.plans.policies import saved_graph
from strandflow.plans.registry import query
from strandflow.sources.shared import save

#: A residual that counts as none where residuals are compared by their ratio (micrometres).
LEAST = 0.001
BEST, CUT_BEST = gaps.BEST, gaps.CUT_BEST

V = oracle.VIEWS
V["hkid"] = "SELECT dataset, source_id node_id, min(target_id) kid, count(*) kids FROM edges GROUP BY ALL"
V["hsrc"] = """SELECT a.dataset, a.node_id source_id, a.t, a.uz az, a.uy ay, a.ux ax, a.uz-p.uz vz, a.uy-p.uy vy, a.ux-p.ux vx, n.kid IS NOT NULL so, sqrt(power(2*a.uz-p.uz-b.uz,2)+power(2*a.uy-p.uy-b.uy,2)+power(2*a.ux-p.ux-b.ux,2)) si
 FROM nodes a JOIN edges e ON e.dataset=a.dataset AND e.target_id=a.node_id JOIN nodes p ON p.dataset=a.dataset AND p.node_id=e.source_id LEFT JOIN hkid n ON n.dataset=a.dataset AND n.node_id=a.node_id LEFT JOIN nodes b ON b.dataset=a.dataset AND b.node_id=n.kid WHERE coalesce(n.kids,0)<=1"""
V["htgt"] = """SELECT c.dataset, c.node_id target_id, c.t, c.uz cz, c.uy cy, c.ux cx, d.uz-c.uz wz, d.uy-c.uy wy, d.ux-c.ux wx, q.node_id IS NOT NULL oc, sqrt(power(2*c.uz-d.uz-q.uz,2)+power(2*c.uy-d.uy-q.uy,2)+power(2*c.ux-d.ux-q.ux,2)) ti
 FROM nodes c JOIN hkid n ON n.dataset=c.dataset AND n.node_id=c.node_id JOIN nodes d ON d.dataset=c.dataset AND d.node_id=n.kid LEFT JOIN edges e ON e.dataset=c.dataset AND e.target_id=c.node_id LEFT JOIN nodes q ON q.dataset=e.dataset AND q.node_id=e.source_id"""
V["hpairs"] = """SELECT * FROM (SELECT s.dataset, s.source_id, k.target_id, k.t-s.t dt, so, oc, si, ti, sqrt(power(az+vz*(k.t-s.t)-cz,2)+power(ay+vy*(k.t-s.t)-cy,2)+power(ax+vx*(k.t-s.t)-cx,2)) f,
  sqrt(power(cz-wz*(k.t-s.t)-az,2)+power(cy-wy*(k.t-s.t)-ay,2)+power(cx-wx*(k.t-s.t)-ax,2)) b FROM hsrc s JOIN htgt k ON k.dataset=s.dataset AND k.t-s.t BETWEEN 3 AND 13) WHERE f<=20 AND b<=20"""
V["hprop"] = f"""SELECT *, so::int+oc::int cuts, f/dt sp, b/dt tp, CASE WHEN so THEN si-f/dt END sg, CASE WHEN oc THEN ti-b/dt END tg, (f+b)/2/dt sym, greatest(f,b)/dt mx, sqrt(f/greatest(bf,{LEAST}::double)*(b/greatest(bb,{LEAST}::double))) gm FROM
 (SELECT *, min(f) OVER (PARTITION BY dataset,source_id,dt) bf, min(b) OVER (PARTITION BY dataset,target_id,dt) bb, row_number() OVER (PARTITION BY dataset,source_id,dt ORDER BY round(f,9),target_id) rf, row_number() OVER (PARTITION BY dataset,target_id,dt ORDER BY round(b,9),source_id) rb FROM hpairs)
 WHERE ((rf<=3 AND rb<=8) OR (rf<=8 AND rb<=3)) AND ((NOT so AND NOT oc) OR coalesce(round(si-f/dt,9)>0,false) AND so OR coalesce(round(ti-b/dt,9)>0,false) AND oc)"""
V["hrank"] = "SELECT *, " + ", ".join(
    f"row_number() OVER (PARTITION BY dataset,source_id ORDER BY round({k},9),target_id) s_{k}, row_number() OVER (PARTITION BY dataset,target_id ORDER BY round({k},9),source_id) t_{k}" for k in ("sym", "mx", "gm")
) + " FROM hprop"
V["hshort"] = f"SELECT *, count(*) OVER (PARTITION BY dataset,source_id) ns, count(*) OVER (PARTITION BY dataset,target_id) nt FROM hrank WHERE least(s_gm,t_gm)<={BEST} OR (cuts<=1 AND least(s_gm,t_gm)<={CUT_BEST})"
#: The features of a contested proposal, as expressions that both engines read.
FEATURES = {
    "gap_size": "dt-1", "delta_t": "dt", "source_occupied": "CASE WHEN so THEN 1 ELSE 0 END", "target_occupied": "CASE WHEN oc THEN 1 ELSE 0 END", "cuts": "cuts",
    "source_pf": "sp", "target_pf": "tp", "min_pf": "least(sp,tp)", "sym_pf": "sym", "max_pf": "mx", "gmean_ratio": "gm",
    "source_rank": "s_gm", "target_rank": "t_gm", "best_rank": "least(s_gm,t_gm)", "worst_rank": "greatest(s_gm,t_gm)", "rank_sum": "s_gm+t_gm", "rank_asymmetry": "abs(ln(1+s_gm)-ln(1+t_gm))",
    "source_rivals": "ns", "target_rivals": "nt", "source_rank_share": "CAST(s_gm AS double)/ns", "target_rank_share": "CAST(t_gm AS double)/nt", "best_rank_share": "least(CAST(s_gm AS double)/ns,CAST(t_gm AS double)/nt)",
    "sym_best_rank": "least(s_sym,t_sym)", "max_best_rank": "least(s_mx,t_mx)", "source_incumbent": "si", "target_incumbent": "ti", "source_gain": "sg", "target_gain": "tg",
    "max_required": "greatest(sg,tg)", "min_required": "least(sg,tg)", "mean_required": "CASE WHEN sg IS NULL THEN tg WHEN tg IS NULL THEN sg ELSE (sg+tg)/2 END",
    "dominates": "CASE WHEN (sg IS NULL OR round(sg,9)>0) AND (tg IS NULL OR round(tg,9)>0) THEN 1 ELSE 0 END",
}
MISSING = ("source_incumbent", "target_incumbent", "source_gain", "target_gain", "max_required", "min_required", "mean_required")
V["hfeat"] = "SELECT dataset, source_id, target_id, dt, so, oc, s_gm, t_gm, " + ", ".join(f"CAST({e} AS double) f_{k}" for k, e in FEATURES.items()) + " FROM hshort"
_TAKE = f"""SELECT *, (round(f_sym_pf,9), source_id, target_id) AS ord, [source_id::varchar, target_id::varchar] AS res FROM hfeat WHERE s_gm<={gaps.ACTION_RANKS[0]} AND t_gm<={gaps.ACTION_RANKS[1]} AND f_dominates=1"""
V["hact"] = f"SELECT * FROM {oracle.greedy(_TAKE)} z WHERE ok"
oracle.MATERIALIZED |= {"hpairs", "hprop", "hshort", "hfeat", "hact"}


def proposals(n, e):
    """Pairs of a node with a past (one child at most) and a node with a future, 3 to 13 frames apart, that constant motion joins from both sides.

    so and oc tell which end is occupied, si and ti how far the link that it would lose is from constant motion, sg and tg what a frame's share of
    the gap gains on that. A pair stays if it is near the top in both directions and takes nothing or beats one of the links it takes.
    """
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(f"{p}t"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    v = lambda p: tuple(F.col(f"{p}{u}") for u in g.AXES)
    bent = lambda m, a, b: g.norm(g.sub(g.sub(g.times(v(m), 2.0), v(a)), v(b)))
    kid = save(e.groupBy("dataset", "source_id").agg(F.min("target_id").alias("kid"), F.count(F.lit(1)).alias("kids")))
    parent = e.select("dataset", F.col("source_id").alias("past"), F.col("target_id").alias("node"))

    s = parent.withColumnRenamed("node", "source_id").join(kid, ["dataset", "source_id"], "left").where("coalesce(kids, 0) <= 1")
    s = s.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("past", "p"), ["dataset", "past"]).join(at("kid", "b"), ["dataset", "kid"], "left")
    k = kid.select("dataset", F.col("source_id").alias("target_id"), "kid").join(at("target_id", "c"), ["dataset", "target_id"]).join(at("kid", "d"), ["dataset", "kid"])
    k = k.join(parent.withColumnRenamed("node", "target_id"), ["dataset", "target_id"], "left").join(at("past", "q"), ["dataset", "past"], "left")
    k = save(k.select(
        "dataset", F.col("ct").alias("t"), "target_id", F.col("past").isNotNull().alias("oc"), bent("c", "d", "q").alias("ti"),
        *[F.col(f"c{u}") for u in g.AXES], *[(F.col(f"d{u}") - F.col(f"c{u}")).alias(f"w{u}") for u in g.AXES], *[F.col(f"c{u}").alias(u) for u in g.AXES],
    ))
    s = gaps.spans(s.withColumns({"so": F.col("kid").isNotNull(), "si": bent("a", "p", "b")}), k)
    ahead = [(F.col(f"a{u}") + (F.col(f"a{u}") - F.col(f"p{u}")) * F.col("dt")).alias(u) for u in g.AXES]
    probe = s.select("dataset", (F.col("at") + F.col("dt")).alias("t"), "source_id", "dt", "so", "si", *[F.col(f"a{u}") for u in g.AXES], *ahead)
    p = spatial.within(probe, k, ["dataset", "t"], gaps.REACH, gaps.WIDE).withColumnRenamed("dist", "f")
    p = p.withColumn("b", g.norm(tuple(F.col(f"c{u}") - F.col(f"w{u}") * F.col("dt") - F.col(f"a{u}") for u in g.AXES))).where(F.col("b") <= gaps.REACH)

    ws, wt = Window.partitionBy("dataset", "source_id", "dt"), Window.partitionBy("dataset", "target_id", "dt")
    p = p.withColumn("bf", F.min("f").over(ws)).withColumn("rf", F.row_number().over(ws.orderBy(F.round("f", 9), "target_id")))  # one exchange for each end
    p = p.withColumn("bb", F.min("b").over(wt)).withColumn("rb", F.row_number().over(wt.orderBy(F.round("b", 9), "source_id")))
    p = p.withColumns({"sp": F.col("f") / F.col("dt"), "tp": F.col("b") / F.col("dt")})
    near, far = gaps.RANKS
    p = p.where(((F.col("rf") <= near) & (F.col("rb") <= far)) | ((F.col("rf") <= far) & (F.col("rb") <= near)))
    ratio = lambda x, best: F.col(x) / F.greatest(F.col(best), F.lit(LEAST))
    p = p.withColumns({
        "cuts": F.col("so").cast("int") + F.col("oc").cast("int"), "sg": F.when(F.col("so"), F.col("si") - F.col("sp")), "tg": F.when(F.col("oc"), F.col("ti") - F.col("tp")),
        "sym": (F.col("f") + F.col("b")) / 2 / F.col("dt"), "mx": F.greatest("f", "b") / F.col("dt"), "gm": F.sqrt(ratio("f", "bf") * ratio("b", "bb")),
    })
    gains = lambda c: F.coalesce(F.round(c, 9) > 0, F.lit(False))
    p = p.where((F.col("cuts") == 0) | gains("sg") | gains("tg"))
    return p.select("dataset", "source_id", "target_id", "dt", "so", "oc", "si", "ti", "sg", "tg", "cuts", "sp", "tp", "sym", "mx", "gm")


def features(p):
    """Ranks at both ends by three measures, the shortlist that they give, rivals within it, and the features."""
    order = {k: F.round(k, 9) for k in ("sym", "mx", "gm")}
    side = lambda k: Window.partitionBy("dataset", k)
    for at, one, other in (("s", "source_id", "target_id"), ("t", "target_id", "source_id")):  # one exchange for each end
        for k, o in order.items():
            p = p.withColumn(f"{at}_{k}", F.row_number().over(side(one).orderBy(o, other)))
    best = F.least("s_gm", "t_gm")
    p = p.where((best <= BEST) | ((F.col("cuts") <= 1) & (best <= CUT_BEST)))
    p = p.withColumn("nt", F.count(F.lit(1)).over(side("target_id"))).withColumn("ns", F.count(F.lit(1)).over(side("source_id")))
    return p.select("dataset", "source_id", "target_id", "dt", "so", "oc", "s_gm", "t_gm", *[F.expr(x).cast("double").alias(f"f_{k}") for k, x in FEATURES.items()])


def actions(f):
    """Proposals that beat every link they take and lead at their source, by ascending residual, each node at most once."""
    rank, far = gaps.ACTION_RANKS
    c = f.where((F.col("s_gm") <= rank) & (F.col("t_gm") <= far) & (F.col("f_dominates") == 1))
    c = c.withColumns({"o": F.round("f_sym_pf", 9), "r0": F.col("source_id").cast("string"), "r1": F.col("target_id").cast("string")})
    return greedy.ordered_greedy(c, ["dataset"], ["o", "source_id", "target_id"], ["r0", "r1"]).drop("o", "r0", "r1")


def contested(spark, d):
    n, e = saved_graph(spark, d)
    return save(features(proposals(n, e)))


_COLUMNS = ", ".join(f"round(coalesce(f_{k},-99),5) {k}" for k in FEATURES)


@query(f"SELECT dataset, source_id, target_id, {_COLUMNS} FROM hfeat")
def gap_contest_features(spark, d):
    """All features of proposals whose ends may be occupied: rank shares, rivals, incumbents and the gains that replacing them requires."""
    return contested(spark, d).select("dataset", "source_id", "target_id", *[F.round(F.coalesce(f"f_{k}", F.lit(-99.0)), 5).alias(k) for k in FEATURES])


@query("""SELECT f_cuts::int cuts, dt, count(*) n, count(*) FILTER (WHERE f_dominates=1) dominate, count(*) FILTER (WHERE so AND oc AND f_dominates=0) beat_one_only, count(*) FILTER (WHERE s_gm=1 AND t_gm=1) mutual FROM hfeat GROUP BY ALL""")
def gap_contest_summary(spark, d):
    """By links that a proposal would cut and frames it spans: how many beat all of them, one of two, or lead at both ends."""
    n = lambda c: F.count(F.when(c, 1))
    f = contested(spark, d)
    all_ = F.col("f_dominates") == 1
    return f.groupBy(F.col("f_cuts").cast("int").alias("cuts"), "dt").agg(
        F.count(F.lit(1)).alias("n"), n(all_).alias("dominate"), n(F.col("so") & F.col("oc") & ~all_).alias("beat_one_only"), n((F.col("s_gm") == 1) & (F.col("t_gm") == 1)).alias("mutual")
    )


@query("""SELECT dataset, source_id, target_id, dt, f_cuts::int cuts, round(f_sym_pf,5) residual, NOT oc AS free_target FROM hact""")
def gap_contest_actions(spark, d):
    """What an ordered choice takes of the proposals; those whose target is occupied need its link removed too."""
    return actions(contested(spark, d)).select("dataset", "source_id", "target_id", "dt", F.col("f_cuts").cast("int").alias("cuts"), F.round("f_sym_pf", 5).alias("residual"), (~F.col("oc")).alias("free_target"))


@query()
def gap_contest_model(spark, d):
    """Held-out AUC of a model of all features on the proposals that the annotation can judge, beside that of the plain residual, by fold."""
    rows = gaps.judged(contested(spark, d), Study(spark, d), FEATURES, MISSING)
    names = [f"f_{k}" for k in FEATURES] + [f"missing_{k}" for k in MISSING]
    fitted = logistic.fit(rows, names, "family", "fold", "label", ridge=10.0)
    out = save(logistic.scored(rows, fitted, names, "family", "fold").select("fold", "label", "score", (-F.col("f_sym_pf")).alias("plain")))
    model, plain = ranks.auc(out, ["fold"], "score", "label"), ranks.auc(out, ["fold"], "plain", "label")
    return model.select("fold", "n", F.col("p").alias("positives"), F.round("auc", 6).alias("auc_model")).join(plain.select("fold", F.round("auc", 6).alias("auc_plain")), "fold")
