"""Queries over error anatomy, gates, distributions and event ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import policies, ranks, topology
from strandflow.plans.policies import graph, rounded
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save


def forks(spark, d):
    return policies.fork_geometry(*graph(spark, d))


GATES = "(SELECT split_part(dataset,'_',1) prefix, CAST(source_id//10//300%5 AS int) fold, sep>=6 a, (NOT isnan(angle) AND angle>=120) b, arm<=8 c, balance<=0.5 e FROM forks)"


@query(f"SELECT coalesce(prefix,'all') prefix, coalesce(fold,-1) fold, count(*) n, round(avg(CASE WHEN a THEN 1.0 ELSE 0 END),6) sep_rate, round(avg(CASE WHEN b THEN 1.0 ELSE 0 END),6) angle_rate, round(avg(CASE WHEN c THEN 1.0 ELSE 0 END),6) arm_rate, round(avg(CASE WHEN e THEN 1.0 ELSE 0 END),6) balance_rate FROM {GATES} z GROUP BY GROUPING SETS ((),(prefix),(fold))")
def gate_pass_rates(spark, d):
    """Rates in all, by family and by fold with grouping sets."""
    f = policies.division_candidates(forks(spark, d)).withColumns({"prefix": F.split("dataset", "_")[0], "fold": F.expr("CAST((source_id div 10 div 300) % 5 AS int)")})
    rate = lambda c, k: F.round(F.avg(F.col(c).cast("double")), 6).alias(k)
    s = f.groupingSets([[], ["prefix"], ["fold"]], "prefix", "fold").agg(F.count(F.lit(1)).alias("n"), rate("sep_ok", "sep_rate"), rate("angle_ok", "angle_rate"), rate("arm_ok", "arm_rate"), rate("balance_ok", "balance_rate"))
    return s.withColumns({"prefix": F.coalesce("prefix", F.lit("all")), "fold": F.coalesce("fold", F.lit(-1))})


LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@query("SELECT variable, count(*) n, round(min(v),6) lo, " + ", ".join(f"round(quantile_cont(v,{q}),6) q{round(100 * q)}" for q in LEVELS) + ", round(max(v),6) hi FROM (SELECT unnest(['sep','arm','balance','d1']) variable, unnest([sep,arm,balance,d1]) v FROM forks) GROUP BY 1")
def geometry_quantiles(spark, d):
    """Exact quantiles of several variables, unpivoted; ranks are taken range by range, so no variable is one task."""
    long = save(forks(spark, d).unpivot(["dataset"], ["sep", "arm", "balance", "d1"], "variable", "v"))
    q = ranks.quantiles(long, ["variable"], "v", {f"q{round(100 * x)}": x for x in LEVELS})
    ends = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"))
    return ends.join(q, "variable").select("variable", "n", "lo", *[F.round(f"q{round(100 * x)}", 6).alias(f"q{round(100 * x)}") for x in LEVELS], "hi")


GRID = "(VALUES (4),(5),(6),(7)) s(gs), (VALUES (60),(90),(120),(140)) a(ga), (VALUES (6),(8),(10),(12)) m(gm), (VALUES (0.4),(0.5),(0.6)) b(gb)"


@query(f"SELECT gs sep_gate, ga angle_gate, gm arm_gate, CAST(gb AS double) balance_gate, sum(n)::bigint n, sum(k)::bigint passed, round(min(k*1.0::double/n),6) least_fold, round(max(k*1.0::double/n),6) most_fold, round(max(k*1.0::double/n)-min(k*1.0::double/n),6) spread FROM (SELECT CAST(source_id//10//300%5 AS int) fold, gs, ga, gm, gb, count(*) n, count(*) FILTER (WHERE sep>=gs AND NOT isnan(angle) AND angle>=ga AND arm<=gm AND balance<=gb) k FROM forks, {GRID} GROUP BY ALL) GROUP BY ALL")
def gate_grid_recall(spark, d):
    """192 gates at once, with the least and greatest share that a fold passes: the grid is exploded beside the forks."""
    f = forks(spark, d).withColumn("fold", F.expr("CAST((source_id div 10 div 300) % 5 AS int)"))
    for name, levels in (("sep_gate", (4, 5, 6, 7)), ("angle_gate", (60, 90, 120, 140)), ("arm_gate", (6, 8, 10, 12)), ("balance_gate", (0.4, 0.5, 0.6))):
        f = f.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    ok = (F.col("sep") >= F.col("sep_gate")) & ~F.isnan("angle") & (F.col("angle") >= F.col("angle_gate")) & (F.col("arm") <= F.col("arm_gate")) & (F.col("balance") <= F.col("balance_gate"))
    gate = ["sep_gate", "angle_gate", "arm_gate", "balance_gate"]
    k = f.groupBy(*gate, "fold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("k")).withColumn("share", F.col("k") / F.col("n"))
    return k.groupBy(*gate).agg(F.sum("n").alias("n"), F.sum("k").alias("passed"), F.round(F.min("share"), 6).alias("least_fold"), F.round(F.max("share"), 6).alias("most_fold"), F.round(F.max("share") - F.min("share"), 6).alias("spread"))


@query("SELECT CAST(level AS double) p2_gate, count(*) FILTER (WHERE p2>=level) passed FROM forks, (VALUES (0.75),(0.80),(0.85),(0.90)) v(level) GROUP BY 1")
def gate_p2_sensitivity(spark, d):
    f = forks(spark, d).withColumn("p2_gate", F.explode(F.array(*[F.lit(v) for v in (0.75, 0.80, 0.85, 0.90)])))
    return f.groupBy("p2_gate").agg(F.count(F.when(F.col("p2") >= F.col("p2_gate"), 1)).alias("passed"))




@query("SELECT hit, count(*) n, " + ", ".join(f"round(quantile_cont({v},{q}),6) {k}_q{round(100 * q)}" for v, k in (("edge_prob", "prob"), ("dist", "dist")) for q in (0.1, 0.5, 0.9)) + " FROM (SELECT e.*, g.source_id IS NOT NULL hit, sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)) dist FROM edges e LEFT JOIN gt_edges g USING (dataset,source_id,target_id) JOIN nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id) GROUP BY 1")
def edge_prob_quantiles(spark, d):
    """Quantiles of probability and length of the links, annotated ones and others."""
    n, e = graph(spark, d)
    t = tracks.gt_edges(tracks.gt_nodes(n)).withColumn("g", F.lit(True))
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    j = e.join(t, ["dataset", "source_id", "target_id"], "left").join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"])
    j = j.withColumns({"hit": F.col("g").isNotNull(), "dist": g.norm(tuple(F.col(f"a{u}") - F.col(f"b{u}") for u in g.AXES))})
    long = save(j.select("hit", F.col("edge_prob").alias("prob"), "dist").unpivot(["hit"], ["prob", "dist"], "variable", "v"))
    levels = {f"q{round(100 * x)}": x for x in (0.1, 0.5, 0.9)}
    q = ranks.quantiles(long, ["hit", "variable"], "v", levels)
    wide = [F.round(F.max(F.when(F.col("variable") == k, F.col(c))), 6).alias(f"{k}_{c}") for k in ("prob", "dist") for c in levels]
    return long.where("variable = 'prob'").groupBy("hit").agg(F.count(F.lit(1)).alias("n")).join(q.groupBy("hit").agg(*wide), "hit")


@query("SELECT s.dataset, CAST(s.t AS int) t, count(g.node_id) n FROM (SELECT dataset, unnest(range(1,last+1)) t FROM (SELECT dataset, max(t) last FROM nodes GROUP BY 1)) s LEFT JOIN gt_nodes g ON g.dataset=s.dataset AND g.t=s.t GROUP BY ALL")
def annotation_density(spark, d):
    """Annotations per frame, frames without any as zero (the spine is one array per dataset)."""
    n = tracks.nodes(spark, d)
    last = n.groupBy("dataset").agg(F.max("t").cast("int").alias("last"))
    spine = last.select("dataset", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("t"))
    k = tracks.gt_nodes(n).groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(k, ["dataset", "t"], "left").fillna(0, ["n"])


@query("SELECT prefix, out_degree::bigint out_degree, n, round(n*1.0/sum(n) OVER (PARTITION BY prefix),6) share FROM (SELECT split_part(dataset,'_',1) prefix, out_degree, count(*) n FROM deg GROUP BY ALL)")
def degree_distribution(spark, d):
    k = topology.degrees(*graph(spark, d)).groupBy(F.split("dataset", "_")[0].alias("prefix"), "out_degree").agg(F.count(F.lit(1)).alias("n"))
    return k.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prefix")), 6))


@query("SELECT prefix, CAST(dt AS int) dt, n, round(n*1.0/sum(n) OVER (PARTITION BY prefix),6) share FROM (SELECT split_part(e.dataset,'_',1) prefix, b.t-a.t dt, count(*) n FROM edges e JOIN nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id GROUP BY ALL)")
def edge_step_distribution(spark, d):
    """How many frames links span, by family."""
    n, e = graph(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(p))
    k = e.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"]).groupBy(F.split("dataset", "_")[0].alias("prefix"), (F.col("b") - F.col("a")).alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    return k.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prefix")), 6))


@query("SELECT t//2*2 bin, count(*) n, round(avg(CASE WHEN out_degree=2 THEN 1.0 ELSE 0 END),6) rate FROM deg WHERE out_degree>0 GROUP BY 1")
def division_rate_by_time(spark, d):
    k = topology.degrees(*graph(spark, d)).where("out_degree > 0")
    return k.groupBy(F.expr("CAST(t div 2 * 2 AS int)").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("out_degree") == 2).cast("double")), 6).alias("rate"))


@query("SELECT dataset, source_id, round(abs(d1-d2)/((d1+d2)/2+1e-8::double),6) imbalance, round(sqrt((az+bz)*(az+bz)+(ay+byy)*(ay+byy)+(ax+bx)*(ax+bx))/2,6) midpoint_offset, CASE WHEN d1*d2>0 THEN round(degrees(acos(least(greatest(dp/(d1*d2),-1.0::double),1.0::double))),4) ELSE -1 END angle FROM forkdist")
def division_symmetry(spark, d):
    n, e = graph(spark, d)
    f = policies.fork_geometry(n, e).select("dataset", "source_id", "c1", "c2", "d1", "d2", "angle")
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    j = f.join(at("source_id", "s"), ["dataset", "source_id"]).join(at("c1", "a"), ["dataset", "c1"]).join(at("c2", "b"), ["dataset", "c2"])
    v = lambda p: tuple(F.col(f"{p}{u}") for u in g.AXES)
    off = g.norm(g.add(g.sub(v("a"), v("s")), g.sub(v("b"), v("s")))) / 2
    return j.select("dataset", "source_id", F.round(F.abs(F.col("d1") - F.col("d2")) / ((F.col("d1") + F.col("d2")) / 2 + 1e-8), 6).alias("imbalance"), F.round(off, 6).alias("midpoint_offset"), F.round(F.nanvl("angle", F.lit(-1.0)), 4).alias("angle"))


@query("SELECT fold, count(*) FILTER (WHERE out_degree=1) ordinary, count(*) FILTER (WHERE out_degree=2) division, sum(out_degree)::bigint edges FROM deg JOIN datasets USING (dataset) WHERE out_degree>0 GROUP BY 1")
def supervision_mass(spark, d):
    n, e = graph(spark, d)
    k = topology.degrees(n, e).where("out_degree > 0").join(tracks.datasets(n).select("dataset", "fold"), "dataset")
    return k.groupBy("fold").agg(F.count(F.when(F.col("out_degree") == 1, 1)).alias("ordinary"), F.count(F.when(F.col("out_degree") == 2, 1)).alias("division"), F.sum("out_degree").alias("edges"))


@query("""SELECT n.dataset, out_of_bounds, coalesce(self_edges,0) self_edges, coalesce(duplicate_edges,0) duplicate_edges, coalesce(bad_prob,0) bad_prob, many_in, many_out FROM (SELECT dataset, count(*) FILTER (WHERE z<0 OR y<0 OR x<0 OR z>64 OR y>256 OR x>256) out_of_bounds, count(*) FILTER (WHERE in_degree>1) many_in, count(*) FILTER (WHERE out_degree>2) many_out FROM deg GROUP BY 1) n
 LEFT JOIN (SELECT dataset, sum(CASE WHEN source_id=target_id THEN k ELSE 0 END)::bigint self_edges, count(*) FILTER (WHERE k>1) duplicate_edges, sum(bad)::bigint bad_prob FROM (SELECT dataset, source_id, target_id, count(*) k, count(*) FILTER (WHERE edge_prob<0 OR edge_prob>1) bad FROM edges GROUP BY ALL) GROUP BY 1) e USING (dataset)""")
def graph_validation(spark, d):
    n, e = graph(spark, d)
    deg = topology.degrees(n, e)
    when = lambda c, k: F.count(F.when(F.expr(c), 1)).alias(k)
    a = deg.groupBy("dataset").agg(when("z<0 OR y<0 OR x<0 OR z>64 OR y>256 OR x>256", "out_of_bounds"), when("in_degree>1", "many_in"), when("out_degree>2", "many_out"))
    p = e.groupBy("dataset", "source_id", "target_id").agg(F.count(F.lit(1)).alias("k"), when("edge_prob<0 OR edge_prob>1", "bad"))
    b = p.groupBy("dataset").agg(F.sum(F.when(F.col("source_id") == F.col("target_id"), F.col("k")).otherwise(0)).alias("self_edges"), when("k>1", "duplicate_edges"), F.sum("bad").alias("bad_prob"))
    return a.join(b, "dataset", "left").fillna(0)


def _sum_sql(s: str) -> str:
    """A digest of rows whatever their order: their number, and the sums of two parts of their hashes."""
    part = lambda i: f"sum(('0x'||substr(md5({s}),{i},12))::bigint)"
    return f"sha256(concat_ws(':', count(*), {part(1)}, {part(13)}))"


def digest_of(s):
    part = lambda i: F.sum(F.conv(F.substring(F.md5(s), i, 12), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(13).cast("string")), 256)


_AT = "CAST(round_even({0}.z*2,0) AS bigint), CAST(round_even({0}.y,0) AS bigint), CAST(round_even({0}.x,0) AS bigint)"


@query(f"SELECT n.dataset, node_digest, coalesce(edge_digest,'') edge_digest FROM (SELECT dataset, {_sum_sql('s')} node_digest FROM (SELECT dataset, concat_ws(',', a.t, {_AT.format('a')}) s FROM nodes a) GROUP BY 1) n LEFT JOIN (SELECT dataset, {_sum_sql('s')} edge_digest FROM (SELECT e.dataset, concat_ws(',', a.t, {_AT.format('a')}, b.t, {_AT.format('b')}) s FROM edges e JOIN nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id) GROUP BY 1) e USING (dataset)")
def semantic_digest(spark, d):
    """Digests of each dataset's nodes and edges by their coordinates, whatever their order and ids: sums of row hashes, so no rows are gathered."""
    n, e = graph(spark, d)
    at = lambda p: [F.col(f"{p}t").cast("string"), F.bround(F.col(f"{p}z") * 2, 0).cast("long").cast("string"), F.bround(f"{p}y", 0).cast("long").cast("string"), F.bround(f"{p}x", 0).cast("long").cast("string")]
    side = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(c).alias(f"{p}{c}") for c in ("t", "z", "y", "x")])
    a = n.groupBy("dataset").agg(digest_of(F.concat_ws(",", *at(""))).alias("node_digest"))
    j = e.join(side("source_id", "a"), ["dataset", "source_id"]).join(side("target_id", "b"), ["dataset", "target_id"])
    b = j.groupBy("dataset").agg(digest_of(F.concat_ws(",", *at("a"), *at("b"))).alias("edge_digest"))
    return a.join(b, "dataset", "left").fillna("", ["edge_digest"])


@query(f"SELECT h digest, count(*) n FROM (SELECT dataset, t, {_sum_sql('s')} h FROM (SELECT dataset, t, concat_ws(',', {_AT.format('a')}) s FROM nodes a) GROUP BY ALL) GROUP BY 1 HAVING count(*)>1")
def duplicate_frames(spark, d):
    """Frames of any dataset whose nodes are all the same, by sums of row hashes."""
    s = F.concat_ws(",", F.bround(F.col("z") * 2, 0).cast("long").cast("string"), F.bround("y", 0).cast("long").cast("string"), F.bround("x", 0).cast("long").cast("string"))
    f = tracks.nodes(spark, d).groupBy("dataset", "t").agg(digest_of(s).alias("digest"))
    return f.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def whole_frames(nodes):
    """(dataset, t, digest): all nodes of each frame by all their coordinates, rounded as in semantic_digest."""
    s = F.concat_ws(",", F.bround(F.col("z") * 2, 0).cast("long"), F.bround("y", 0).cast("long"), F.bround("x", 0).cast("long"))
    return nodes.groupBy("dataset", "t").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(s)), ";"), 256).alias("digest"))


@query("SELECT h digest, count(*) n FROM (SELECT dataset, t, sha256(string_agg(s, ';' ORDER BY s)) h FROM (SELECT dataset, t, concat_ws(',', CAST(round_even(z*2,0) AS bigint), CAST(round_even(y,0) AS bigint), CAST(round_even(x,0) AS bigint)) s FROM nodes) GROUP BY ALL) GROUP BY 1 HAVING count(*)>1")
def duplicate_whole_frames(spark, d):
    """Frames of any dataset whose nodes are all the same (in order, as one text a frame; duplicate_frames does without)."""
    return whole_frames(tracks.nodes(spark, d)).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT dataset, node_id, t, CAST(rk AS int) rk, round(1-(rk-1)*1.0::double/greatest(n-1,1),6) pct, round(CASE WHEN s>0 THEN (d-m)/s ELSE 0 END,6) score FROM (SELECT *, row_number() OVER (PARTITION BY dataset,t ORDER BY d DESC,node_id) rk, count(*) OVER w n, avg(d) OVER w m, coalesce(stddev_samp(d) OVER w,0) s FROM nodes WINDOW w AS (PARTITION BY dataset,t))")
def frame_relative_rank(spark, d):
    w = Window.partitionBy("dataset", "t")
    n = tracks.nodes(spark, d).withColumns({"rk": F.row_number().over(w.orderBy(F.desc("d"), "node_id")), "n": F.count(F.lit(1)).over(w), "m": F.avg("d").over(w), "s": F.coalesce(F.stddev_samp("d").over(w), F.lit(0.0))})
    return n.select("dataset", "node_id", "t", "rk", F.round(1 - (F.col("rk") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("pct"), F.round(F.when(F.col("s") > 0, (F.col("d") - F.col("m")) / F.col("s")).otherwise(0.0), 6).alias("score"))


EVENTS = "(SELECT dataset, t, count(*) n, max(tx) mx, avg(tx) mean, stddev_pop(tx) std FROM nodes GROUP BY ALL)"


@query("SELECT dataset, t, n, round(mx,9) top, round(mx-coalesce(tops[2],mx),9) margin, round(mean,9) mean, round(std,9) std, round(list_avg(tops[1:3]),9) top3, round(CASE WHEN std>1e-12 THEN (mx-mean)/std ELSE 0 END,5) max_z FROM (SELECT dataset, t, count(*) n, max(tx) mx, avg(tx) mean, stddev_pop(tx) std, list(tx ORDER BY tx DESC) tops FROM nodes GROUP BY ALL)")
def frame_event_features(spark, d):
    top = F.slice(F.sort_array(F.collect_list("tx"), asc=False), 1, 3)
    f = tracks.nodes(spark, d).groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("tx").alias("mean"), F.stddev_pop("tx").alias("std"), top.alias("s"))
    r = lambda x, k: F.round(x, 9).alias(k)
    first = F.col("s")[0]
    return f.select("dataset", "t", "n", r(first, "top"), r(first - F.coalesce(F.get("s", F.lit(1)), first), "margin"), r(F.col("mean"), "mean"), r(F.col("std"), "std"), r(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), "top3"), F.round(F.when(F.col("std") > 1e-12, (first - F.col("mean")) / F.col("std")).otherwise(0.0), 5).alias("max_z"))


_MEANS = {"p": "lag({0}) OVER w", "n": "lead({0}) OVER w", "p2": "lag({0},2) OVER w", "n2": "lead({0},2) OVER w"}
_AROUND = ", ".join(f"{e.format(c)} {k}{c}" for k, e in _MEANS.items() for c in "tsk")
#: Means are sums of hundredths over counts; differences are fractions of integers, divided last, so equal frames are equal.
_STEP = "round(coalesce(CASE WHEN {0}t={1} THEN ((s*{0}k-{0}s*k)*1.0::double)/(100*k*{0}k) END,0),6)"
_MID = "round(coalesce(CASE WHEN p{0}t=t-{1} AND n{0}t=t+{1} THEN ((2*s*p{0}k*n{0}k-k*(p{0}s*n{0}k+n{0}s*p{0}k))*1.0::double)/(200*k*p{0}k*n{0}k) END,0),6)"
CONTRAST = {
    "rise": _STEP.format("p", "t-1"), "fall": _STEP.format("n", "t+1"), "peak": "coalesce(pt=t-1 AND nt=t+1 AND s*pk>ps*k AND s*nk>ns*k, false)", "contrast1": _MID.format("", 1), "contrast2": _MID.format("2", 2),
}


@query(f"""SELECT dataset, t, {", ".join(f"{e} AS {k}" for k, e in CONTRAST.items())} FROM (SELECT *, {_AROUND}
 FROM (SELECT dataset, t, sum(CAST(round(tx*100) AS bigint))::bigint s, count(*) k FROM nodes GROUP BY ALL) WINDOW w AS (PARTITION BY dataset ORDER BY t))""")
def temporal_contrast(spark, d):
    """How a frame's mean tx stands out against the frames before and after; a missing neighbour counts as no difference."""
    f = tracks.nodes(spark, d).groupBy("dataset", "t").agg(F.sum(F.round(F.col("tx") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("dataset").orderBy("t")
    f = f.withColumns({f"{k}{c}": (F.lag if k[0] == "p" else F.lead)(c, 2 if k[-1] == "2" else 1).over(w) for k in _MEANS for c in "tsk"})
    return f.select("dataset", "t", *[F.expr(e.replace("1.0::double", "1.0D")).alias(k) for k, e in CONTRAST.items()])


LOGIT = "ln(least(greatest({0},1e-6::double),1-1e-6::double)/(1-least(greatest({0},1e-6::double),1-1e-6::double)))"


@query(f"SELECT a.dataset, a.target_id node_id, round({LOGIT.format('a.edge_prob')}-{LOGIT.format('b.edge_prob')},5) delta, round(CASE WHEN c.edge_id IS NULL THEN -99 ELSE {LOGIT.format('a.edge_prob')}-{LOGIT.format('c.edge_prob')} END,5) delta2 FROM edges a JOIN edges b ON b.dataset=a.dataset AND b.target_id=a.source_id LEFT JOIN edges c ON c.dataset=b.dataset AND c.target_id=b.source_id")
def lineage_delta(spark, d):
    """Change of the link's logit over one and over two frames on the same lineage."""
    _, e = graph(spark, d)
    p = F.least(F.greatest("edge_prob", F.lit(1e-6)), F.lit(1 - 1e-6))
    x = e.select("dataset", "source_id", "target_id", F.ln(p / (1 - p)).alias("v"))
    b = x.select("dataset", F.col("target_id").alias("source_id"), F.col("source_id").alias("b_id"), F.col("v").alias("before"))
    c = x.select("dataset", F.col("target_id").alias("b_id"), F.col("v").alias("before2"))
    j = x.join(b, ["dataset", "source_id"]).join(c, ["dataset", "b_id"], "left")
    return j.select("dataset", F.col("target_id").alias("node_id"), F.round(F.col("v") - F.col("before"), 5).alias("delta"), F.round(F.coalesce(F.col("v") - F.col("before2"), F.lit(-99.0)), 5).alias("delta2"))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda p: (p[1]::double-p[2]::double)*(p[1]::double-p[2]::double)))/len(a.embedding)),5) rms, round(1-list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda p: p[1]::double*p[2]::double))/sqrt(list_sum(list_transform(a.embedding, lambda x: x::double*x::double))*list_sum(list_transform(b.embedding, lambda x: x::double*x::double))),5) cosine FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def representation_change(spark, d):
    """RMS and cosine change between the vectors of consecutive ids, with array functions."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    sq = total(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)))
    dot, na, nb = total(F.zip_with("a", "b", lambda p, q: p * q)), total(F.transform("a", lambda p: p * p)), total(F.transform("b", lambda p: p * p))
    return j.select("vec_id", F.round(F.sqrt(sq / F.size("a")), 5).alias("rms"), F.round(1 - dot / F.sqrt(na * nb), 5).alias("cosine"))


SCORED = "(SELECT split_part(n.dataset,'_',1) prefix, n.d score, CASE WHEN n.high_conf THEN 1 ELSE 0 END label, n.dataset, n.node_id FROM nodes n)"


def scored(spark, d):
    return tracks.nodes(spark, d).select(F.split("dataset", "_")[0].alias("prefix"), F.col("d").alias("score"), F.col("high_conf").cast("int").alias("label"), "dataset", "node_id")


@query(f"SELECT prefix, round((sum(CASE WHEN label=1 THEN rk END)-p*(p+1)/2.0)/(p*(n-p)),6) auc FROM (SELECT *, rank() OVER (PARTITION BY prefix ORDER BY score)+(count(*) OVER (PARTITION BY prefix,score)-1)/2.0 rk, sum(label) OVER (PARTITION BY prefix) p, count(*) OVER (PARTITION BY prefix) n FROM {SCORED} z) GROUP BY prefix, p, n")
def ranking_auc(spark, d):
    """ROC-AUC with ties at their average rank, from one count per distinct score."""
    return ranks.auc(scored(spark, d), ["prefix"], "score", "label").select("prefix", F.round("auc", 6).alias("auc"))


CUM = f"(SELECT prefix, score, pos, sum(pos) OVER w tp, sum(k) OVER w n, sum(pos) OVER (PARTITION BY prefix) p FROM (SELECT prefix, score, count(*) k, sum(label) pos FROM {SCORED} z GROUP BY ALL) WINDOW w AS (PARTITION BY prefix ORDER BY score DESC))"


def cumulative(spark, d):
    """Hits and rows down to each distinct score, best first."""
    s = scored(spark, d).groupBy("prefix", "score").agg(F.count(F.lit(1)).alias("k"), F.sum("label").alias("pos"))
    c = ranks.cumulative(s, ["prefix"], [F.desc("score")], ["k", "pos"])
    return c.select("prefix", "score", "pos", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_k") + F.col("k")).alias("n"), F.col("total_pos").alias("p"))


@query(f"SELECT prefix, round(sum(pos*1.0::double/p*tp/n),6) ap FROM {CUM} z GROUP BY 1")
def average_precision(spark, d):
    return cumulative(spark, d).groupBy("prefix").agg(F.round(F.sum(F.col("pos") / F.col("p") * F.col("tp") / F.col("n")), 6).alias("ap"))


@query(f"SELECT prefix, CAST(target AS double) target, round(coalesce(max(CASE WHEN tp*1.0::double/n>=target THEN tp*1.0::double/p END),0),6) recall FROM {CUM} z, (VALUES (0.5),(0.7),(0.75),(0.8),(0.9)) v(target) GROUP BY ALL")
def recall_at_precision(spark, d):
    c = cumulative(spark, d).withColumn("target", F.explode(F.array(*[F.lit(v) for v in (0.5, 0.7, 0.75, 0.8, 0.9)])))
    return c.groupBy("prefix", "target").agg(F.round(F.coalesce(F.max(F.when(F.col("tp") / F.col("n") >= F.col("target"), F.col("tp") / F.col("p"))), F.lit(0.0)), 6).alias("recall"))


@query(f"SELECT prefix, k, tp, fp, round(tp*1.0::double/(tp+fp),6) AS precision, round(tp*1.0::double/p,6) recall FROM (SELECT prefix, k, count(*) FILTER (WHERE rk<=k AND label=1) tp, count(*) FILTER (WHERE rk<=k AND label=0) fp, sum(label) p FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC,dataset,node_id) rk FROM {SCORED} z), (VALUES (10),(50),(100)) v(k) GROUP BY ALL)")
def topk_retrieval(spark, d):
    """Hits among the K best by family, precision and recall; the rank limit is taken before the sort is complete (top-k window)."""
    w = Window.partitionBy("prefix").orderBy(F.desc("score"), "dataset", "node_id")
    s = scored(spark, d)
    r = s.withColumn("rk", F.row_number().over(w)).where("rk <= 100").withColumn("k", F.explode(F.array(F.lit(10), F.lit(50), F.lit(100)))).where("rk <= k")
    a = r.groupBy("prefix", "k").agg(F.count(F.when(F.col("label") == 1, 1)).alias("tp"), F.count(F.when(F.col("label") == 0, 1)).alias("fp"))
    a = a.join(s.groupBy("prefix").agg(F.sum("label").alias("p")), "prefix")
    return a.select("prefix", "k", "tp", "fp", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.col("p"), 6).alias("recall"))


@query("SELECT dataset, node_id, round((p1+p2)/2,6) score FROM (SELECT dataset, node_id, (rank() OVER (PARTITION BY dataset ORDER BY d)+(count(*) OVER (PARTITION BY dataset,d)-1)/2.0::double)/count(*) OVER (PARTITION BY dataset) p1, (rank() OVER (PARTITION BY dataset ORDER BY tx)+(count(*) OVER (PARTITION BY dataset,tx)-1)/2.0::double)/count(*) OVER (PARTITION BY dataset) p2 FROM nodes)")
def rank_ensemble(spark, d):
    """Mean of two average percent ranks within each dataset."""
    per = Window.partitionBy("dataset")
    pct = lambda c: (F.rank().over(per.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("dataset", c)) - 1) / 2) / F.count(F.lit(1)).over(per)
    return rounded(tracks.nodes(spark, d).withColumn("score", (pct("d") + pct("tx")) / 2), "score").select("dataset", "node_id", "score")


SEEDS = ("d", "tx", "edge")
_PCT = ", ".join(f"(rank() OVER (PARTITION BY fold ORDER BY {c})+(count(*) OVER (PARTITION BY fold,{c})-1)/2.0::double)/count(*) OVER (PARTITION BY fold) p_{c}" for c in SEEDS)
_SEEDED = "SELECT n.dataset, n.node_id, n.t, n.d, n.tx, coalesce(e.edge,0) edge, s.fold FROM nodes n JOIN datasets s USING (dataset) LEFT JOIN (SELECT dataset, source_id node_id, max(edge_prob) edge FROM edges GROUP BY ALL) e USING (dataset,node_id)"


@query(f"SELECT dataset, node_id, fold, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, t, node_id) rank FROM (SELECT dataset, node_id, t, fold, round(({'+'.join(f'p_{c}' for c in SEEDS)})/{len(SEEDS)},9) score FROM (SELECT *, {_PCT} FROM ({_SEEDED})))")
def fold_rank_ensemble(spark, d):
    """Scores of several seeds as average percent ranks within each fold, their mean, and the rank by it inside each dataset."""
    n = tracks.nodes(spark, d)
    e = tracks.edges(n).groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.max("edge_prob").alias("edge"))
    rows = n.select("dataset", "node_id", "t", "d", "tx").join(e, ["dataset", "node_id"], "left").fillna(0.0, ["edge"]).join(tracks.datasets(n).select("dataset", "fold"), "dataset")
    rows = save(rows)
    long = rows.unpivot(["fold"], list(SEEDS), "seed", "value")
    pct = save(ranks.average_ranks(long, ["fold", "seed"], "value").select("fold", "seed", "value", (F.col("rank") / F.col("size")).alias("p")))
    out = rows
    for c in SEEDS:
        out = out.join(pct.where(F.col("seed") == c).select("fold", F.col("value").alias(c), F.col("p").alias(f"p_{c}")), ["fold", c])
    out = out.withColumn("score", F.round(sum((F.col(f"p_{c}") for c in SEEDS), F.lit(0.0)) / len(SEEDS), 9))
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), "t", "node_id")
    return out.select("dataset", "node_id", "fold", "score", F.row_number().over(w).alias("rank"))


POLICY = f"(SELECT CAST(gs AS int) gs, CAST(gm AS int) gm, count(*) FILTER (WHERE sep>=gs AND arm<=gm AND p2>=0.8) tp, count(*) FILTER (WHERE sep>=gs AND arm<=gm AND p2<0.8) fp FROM forks, {GRID} WHERE ga=60 AND gb=0.4 GROUP BY ALL)"


@query(f"SELECT gs, gm, tp, fp FROM {POLICY} a WHERE NOT EXISTS (SELECT 1 FROM {POLICY} b WHERE b.tp>=a.tp AND b.fp<=a.fp AND (b.tp>a.tp OR b.fp<a.fp))")
def pareto_frontier(spark, d):
    """Gates that no other gate beats in hits and false hits at once; the grid is 16 rows."""
    f = forks(spark, d).withColumn("gs", F.explode(F.array(*[F.lit(v) for v in (4, 5, 6, 7)]))).withColumn("gm", F.explode(F.array(*[F.lit(v) for v in (6, 8, 10, 12)])))
    ok = (F.col("sep") >= F.col("gs")) & (F.col("arm") <= F.col("gm"))
    a = f.groupBy("gs", "gm").agg(F.count(F.when(ok & (F.col("p2") >= 0.8), 1)).alias("tp"), F.count(F.when(ok & (F.col("p2") < 0.8), 1)).alias("fp"))
    b = a.select(F.col("tp").alias("btp"), F.col("fp").alias("bfp"))
    return a.join(F.broadcast(b), F.expr("btp >= tp AND bfp <= fp AND (btp > tp OR bfp < fp)"), "left_anti")
