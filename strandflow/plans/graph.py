"""Queries over sources and sinks, selections, degrees, components, neighbours and motion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import policies, ranks, spatial, topology
from strandflow.plans import oracle
from strandflow.plans.policies import graph, rounded, saved_graph
from strandflow.plans.registry import query
from strandflow.sources import submission, tracks
from strandflow.sources.shared import save


@query("""SELECT CAST(row_number() OVER (ORDER BY dataset, k, o) - 1 AS bigint) id, dataset, row_type, node_id, t, z, y, x, source_id, target_id FROM
 (SELECT dataset, 0 k, node_id o, 'node' row_type, node_id, t, CAST(round_even(z,0) AS bigint) z, CAST(round_even(y,0) AS bigint) y, CAST(round_even(x,0) AS bigint) x, -1::bigint source_id, -1::bigint target_id FROM nodes
 UNION ALL SELECT dataset, 1, edge_id, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM edges)""")
def submission_rows(spark, d):
    return submission.rows(*graph(spark, d))


@query("""SELECT n.dataset, n_nodes, coalesce(n_edges,0) n_edges, coords, coalesce(ends,0) ends FROM (SELECT dataset, count(*) n_nodes, sum(round_even(z,0)+round_even(y,0)+round_even(x,0))::bigint coords FROM nodes GROUP BY 1) n
 LEFT JOIN (SELECT dataset, count(*) n_edges, sum(source_id+target_id)::bigint ends FROM edges GROUP BY 1) e USING (dataset)""")
def submission_roundtrip(spark, d):
    n, e = submission.split(submission.rows(*graph(spark, d)))
    n = n.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("z") + F.col("y") + F.col("x")).alias("coords"))
    e = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("source_id") + F.col("target_id")).alias("ends"))
    return n.join(e, "dataset", "left").fillna(0, ["n_edges", "ends"])


@query("""SELECT coalesce(e.dataset,f.dataset) dataset, coalesce(f.n,0) found, CASE WHEN f.dataset IS NULL THEN 'missing' WHEN e.dataset IS NULL THEN 'extra' WHEN f.n>1 THEN 'duplicate' ELSE 'ok' END status
 FROM (SELECT dataset FROM datasets WHERE fold<>4) e FULL JOIN (SELECT dataset, CASE WHEN fold=1 THEN 2 ELSE 1 END n FROM datasets WHERE fold<>2) f ON e.dataset=f.dataset""")
def prediction_set_check(spark, d):
    """Expected datasets against found ones (here: by fold)."""
    ds = tracks.datasets(tracks.nodes(spark, d))
    found = ds.where("fold <> 2").unionByName(ds.where("fold = 1"))
    return submission.completeness(ds.where("fold <> 4").select("dataset"), found.select("dataset"))


@query("SELECT dataset, prefix, fold, n_frames, n_nodes FROM datasets WHERE prefix='6bba' AND fold IN (0,1)")
def select_datasets(spark, d):
    return submission.select_datasets(tracks.datasets(tracks.nodes(spark, d)), "6bba", [0, 1]).select("dataset", "prefix", "fold", "n_frames", "n_nodes")


KEY = "t, CAST(round_even(z,0) AS bigint) kz, CAST(round_even(y,0) AS bigint) ky, CAST(round_even(x,0) AS bigint) kx"


def keys(n):
    return n.select("dataset", "t", *[F.bround(c, 0).cast("long").alias(f"k{c}") for c in "zyx"])


@query(f"SELECT DISTINCT dataset, {KEY} FROM nodes")
def coordinate_keys(spark, d):
    return keys(tracks.nodes(spark, d)).distinct()


@query("SELECT DISTINCT a.dataset, a.t FROM nodes a JOIN nodes b ON a.dataset=b.dataset AND b.t=a.t+1")
def frame_pairs(spark, d):
    f = tracks.nodes(spark, d).select("dataset", "t").distinct()
    return f.join(f.select("dataset", (F.col("t") - 1).alias("t")), ["dataset", "t"], "left_semi")


@query("""SELECT dataset, start, start+2 stop FROM (SELECT dataset, unnest(list_distinct(list_append(range(1, greatest(n_frames-1,2), 2), greatest(n_frames-2,1)))) AS start FROM (SELECT dataset, max(t) n_frames FROM nodes GROUP BY 1))""")
def frame_windows(spark, d):
    """Windows of three frames with stride two; the last one is forced to end at the last frame."""
    f = tracks.nodes(spark, d).groupBy("dataset").agg(F.max("t").alias("n"))
    last = F.greatest(F.col("n") - 2, F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1)), F.lit(2)), F.array(last)))
    return f.select("dataset", F.explode(starts).alias("start")).select("dataset", F.col("start").cast("long").alias("start"), (F.col("start") + 2).cast("long").alias("stop"))


ROUTES = [("routed", "44b6", "A"), ("routed", "6bba", "B"), ("reverse", "44b6", "B"), ("reverse", "6bba", "A"), ("all_a", "44b6", "A"), ("all_a", "6bba", "A")]


@query(f"SELECT control, dataset, node_id, r.route FROM (SELECT dataset, split_part(dataset,'_',1) prefix, node_id, 'A' route FROM nodes WHERE high_conf UNION ALL SELECT dataset, split_part(dataset,'_',1), node_id, 'B' FROM nodes WHERE t%2=0) n JOIN (VALUES {', '.join(map(str, ROUTES))}) r(control, prefix, route) ON r.prefix=n.prefix AND r.route=n.route")
def domain_routing(spark, d):
    """Rows of two variants, each for the family that it is routed to, and under two controls: the other way round, and one variant for all."""
    n = tracks.nodes(spark, d).withColumn("prefix", F.split("dataset", "_")[0])
    a, b = n.where("high_conf").withColumn("route", F.lit("A")), n.where("t % 2 = 0").withColumn("route", F.lit("B"))
    routing = spark.createDataFrame(ROUTES, "control string, prefix string, route string")
    return a.unionByName(b).join(F.broadcast(routing), ["prefix", "route"]).select("control", "dataset", "node_id", "route")


@query("SELECT dataset, node_id, in_degree::bigint in_degree, out_degree::bigint out_degree FROM deg")
def degrees(spark, d):
    return topology.degrees(*graph(spark, d)).select("dataset", "node_id", "in_degree", "out_degree")


CHILD = "(SELECT n.dataset, n.node_id, n.t, count(b.node_id) children FROM gt_nodes n LEFT JOIN gt_edges e ON e.dataset=n.dataset AND e.source_id=n.node_id LEFT JOIN gt_nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id AND b.t=n.t+1 GROUP BY ALL)"


def gt(spark, d):
    n = tracks.nodes(spark, d)
    return tracks.um(tracks.gt_nodes(n)), tracks.gt_edges(tracks.gt_nodes(n))


def child_degrees(n, e):
    e = e.join(n.select("dataset", F.col("node_id").alias("source_id"), F.col("t").alias("ts")), ["dataset", "source_id"]).join(n.select("dataset", F.col("node_id").alias("target_id"), F.col("t").alias("tt")), ["dataset", "target_id"])
    k = e.where("tt = ts + 1").groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    return n.select("dataset", "node_id", "t").join(k, ["dataset", "node_id"], "left").fillna(0, ["children"])


@query(f"SELECT * FROM {CHILD} z")
def gt_child_degrees(spark, d):
    return child_degrees(*gt(spark, d))


@query(f"SELECT dataset, node_id, t, CASE WHEN children=2 THEN 1 ELSE 0 END label FROM {CHILD} z WHERE children IN (1,2)")
def division_labels(spark, d):
    return child_degrees(*gt(spark, d)).where("children IN (1, 2)").select("dataset", "node_id", "t", F.when(F.col("children") == 2, 1).otherwise(0).alias("label"))


@query(f"SELECT DISTINCT dataset, t FROM {CHILD} z WHERE children=2")
def division_frames(spark, d):
    return child_degrees(*gt(spark, d)).where("children = 2").select("dataset", "t").distinct()


@query("SELECT dataset, node_id, component FROM comp")
def components(spark, d):
    return topology.components(*graph(spark, d)).select("dataset", "node_id", "component")


STATS = """(SELECT c.dataset, c.component, count(*) size, max(n.t)-min(n.t)+1 span, count(DISTINCT n.t) frames, round(count(DISTINCT n.t)*1.0::double/(max(n.t)-min(n.t)+1),6) coverage FROM comp c JOIN nodes n USING (dataset,node_id) GROUP BY ALL)"""
PROBS = "(SELECT c.dataset, c.component, round(avg(edge_prob),6) mean_prob, round(min(edge_prob),6) min_prob, round(max(edge_prob),6) max_prob FROM comp c JOIN edges e ON e.dataset=c.dataset AND e.target_id=c.node_id GROUP BY ALL)"


def stats(n, e):
    c = topology.components(n, e)
    s = c.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"), (F.max("t") - F.min("t") + 1).alias("span"), F.countDistinct("t").alias("frames")).withColumn("coverage", F.round(F.col("frames") / F.col("span"), 6))
    p = e.join(c.select("dataset", F.col("node_id").alias("target_id"), "component"), ["dataset", "target_id"]).groupBy("dataset", "component").agg(
        F.round(F.avg("edge_prob"), 6).alias("mean_prob"), F.round(F.min("edge_prob"), 6).alias("min_prob"), F.round(F.max("edge_prob"), 6).alias("max_prob")
    )
    return s.join(p, ["dataset", "component"], "left")


@query(f"SELECT s.*, mean_prob, min_prob, max_prob FROM {STATS} s LEFT JOIN {PROBS} p USING (dataset,component)")
def component_stats(spark, d):
    return stats(*graph(spark, d))


BUCKET = "CASE WHEN size<=1 THEN '1' WHEN size=2 THEN '2' WHEN size<=4 THEN '3-4' WHEN size<=9 THEN '5-9' WHEN size<=19 THEN '10-19' ELSE '20+' END"


@query(f"SELECT {BUCKET} bucket, count(*) components, sum(size)::bigint nodes, round(avg(CASE WHEN coverage>=1 THEN 1.0 ELSE 0 END),6) full_rate FROM {STATS} s GROUP BY 1")
def component_size_buckets(spark, d):
    s = stats(*graph(spark, d)).withColumn("bucket", topology.size_bucket(F.col("size")))
    return s.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"), F.round(F.avg((F.col("coverage") >= 1).cast("double")), 6).alias("full_rate"))


@query(f"""SELECT prefix, bucket, quartile, count(*) n, round(avg(coverage),6) mean_coverage FROM (SELECT *, greatest(((rk-1)*4+n-2)//greatest(n-1,1),1)-1 quartile FROM
 (SELECT split_part(dataset,'_',1) prefix, {BUCKET} bucket, coverage, row_number() OVER (PARTITION BY split_part(dataset,'_',1), {BUCKET} ORDER BY mean_prob, dataset, component) rk, count(*) OVER (PARTITION BY split_part(dataset,'_',1), {BUCKET}) n FROM {STATS} s JOIN {PROBS} p USING (dataset,component))) GROUP BY ALL""")
def component_confidence_quartiles(spark, d):
    """Quartiles of mean probability within family and size bucket, ties broken by order (bins as equal-frequency cuts of ranks, which are taken range by range)."""
    s = stats(*graph(spark, d)).where("mean_prob IS NOT NULL").withColumns({"prefix": F.split("dataset", "_")[0], "bucket": topology.size_bucket(F.col("size"))})
    s = ranks.numbered(s, ["prefix", "bucket"], ["mean_prob", "dataset", "component"]).withColumns({"rk": F.col("pos") + 1, "n": F.col("of")})
    s = s.withColumn("quartile", F.expr("greatest(((rk-1)*4+n-2) div greatest(n-1,1), 1) - 1"))
    return s.groupBy("prefix", "bucket", "quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


oracle.VIEWS["nearby"] = "SELECT b.dataset, b.node_id, coalesce(min(sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)))<=7, false) near FROM nodes b LEFT JOIN gt_nodes a ON a.dataset=b.dataset AND a.t=b.t GROUP BY ALL"


def near_annotation(n):
    """(dataset, node_id, near) of the nodes within 7 um of an annotated one."""
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    return spatial.within(a, n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], 7.0).select("dataset", "node_id").distinct().withColumn("near", F.lit(True))


ROLE = "CASE WHEN in_degree=0 AND out_degree=0 THEN 'singleton' WHEN out_degree>=2 THEN 'division_parent' WHEN in_degree+out_degree=1 THEN 'endpoint' WHEN in_degree=1 AND out_degree=1 THEN 'internal' ELSE 'other' END"


@query(f"SELECT dataset, {ROLE} AS role, count(*) n FROM deg GROUP BY ALL")
def graph_roles(spark, d):
    n = topology.degrees(*graph(spark, d))
    return n.groupBy("dataset", topology.role(F.col("in_degree"), F.col("out_degree")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT split_part(dataset,'_',1) prefix, {ROLE} AS role, count(*) n, round(avg(CASE WHEN size<=2 THEN 1.0 ELSE 0 END),6) short_share, round(avg(CASE WHEN near THEN 1.0 ELSE 0 END),6) near_annotation FROM deg JOIN comp USING (dataset,node_id) JOIN compsize USING (dataset,component) JOIN nearby USING (dataset,node_id) WHERE NOT high_conf GROUP BY ALL")
def low_conf_roles(spark, d):
    """Low-confidence nodes by role: their number, how many stand in short components, how many near an annotated node."""
    n, e = saved_graph(spark, d)
    s = topology.degrees(policies.with_component_size(n, e), e).where("NOT high_conf").join(near_annotation(n), ["dataset", "node_id"], "left").fillna(False, ["near"])
    rate = lambda c, k: F.round(F.avg(c.cast("double")), 6).alias(k)
    return s.groupBy(F.split("dataset", "_")[0].alias("prefix"), topology.role(F.col("in_degree"), F.col("out_degree")).alias("role")).agg(F.count(F.lit(1)).alias("n"), rate(F.col("size") <= 2, "short_share"), rate(F.col("near"), "near_annotation"))


@query("""SELECT boundary, count(*) FILTER (WHERE was) original, count(*) FILTER (WHERE NOT was) created FROM (SELECT n.dataset, n.node_id, o.node_id IS NULL AND i.node_id IS NULL was, CASE WHEN least(n.t-1, mt-n.t)=0 THEN 'edge' WHEN least(n.t-1,mt-n.t)=1 THEN 'near' ELSE 'inner' END boundary
 FROM (SELECT *, max(t) OVER (PARTITION BY dataset) mt FROM nodes) n LEFT JOIN outd o USING (dataset,node_id) LEFT JOIN ind i ON i.dataset=n.dataset AND i.node_id=n.node_id
 WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dataset=n.dataset AND e.edge_prob>=0.6 AND (e.source_id=n.node_id OR e.target_id=n.node_id))) GROUP BY 1""")
def isolated_nodes(spark, d):
    """Nodes without links after edges below 0.6 go: those that had none before, and those that the cut leaves alone."""
    n, e = graph(spark, d)
    n = n.withColumn("mt", F.max("t").over(Window.partitionBy("dataset")))
    ends = lambda df: df.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    alone = n.join(ends(e.where("edge_prob >= 0.6")), ["dataset", "node_id"], "left_anti").join(ends(e).withColumn("linked", F.lit(True)), ["dataset", "node_id"], "left")
    near = F.least(F.col("t") - 1, F.col("mt") - F.col("t"))
    was = F.col("linked").isNull()
    return alone.groupBy(F.when(near == 0, "edge").when(near == 1, "near").otherwise("inner").alias("boundary")).agg(F.count(F.when(was, 1)).alias("original"), F.count(F.when(~was, 1)).alias("created"))


@query("SELECT a.dataset, a.target_id node_id, a.source_id prev_id, coalesce(b.source_id,-1) prev2_id FROM edges a LEFT JOIN edges b ON b.dataset=a.dataset AND b.target_id=a.source_id")
def lineage_predecessors(spark, d):
    n, e = graph(spark, d)
    return topology.predecessors(e, n).fillna(-1, ["prev2_id"])


@query("""SELECT fold, children, count(*) n FROM (SELECT d.fold, b.target_id, count(c.target_id) children FROM edges a JOIN edges b ON b.dataset=a.dataset AND b.source_id=a.target_id JOIN edges c ON c.dataset=b.dataset AND c.source_id=b.target_id JOIN datasets d ON d.dataset=a.dataset GROUP BY ALL) WHERE children IN (1,2) GROUP BY ALL""")
def multiframe_eligibility(spark, d):
    n, e = graph(spark, d)
    p = topology.predecessors(e, n).where("prev2_id IS NOT NULL")
    k = e.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children")).where("children IN (1, 2)")
    folds = tracks.datasets(n).select("dataset", "fold")
    return p.join(k, ["dataset", "node_id"]).join(folds, "dataset").groupBy("fold", "children").agg(F.count(F.lit(1)).alias("n"))


def next_frame(n, radius=None):
    """Pairs of nodes of consecutive frames with their distance (node_id, other_id)."""
    a = n.select("dataset", "t", "node_id", *g.AXES)
    b = n.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("other_id"), *g.AXES)
    return spatial.within(a, b, ["dataset", "t"], radius) if radius else spatial.frame_pairs(a, b, ["dataset", "t"])


def next_nearest(n, k):
    """The k nearest nodes of the next frame (node_id, other_id, dist, rk)."""
    n = save(n.select("dataset", "t", "node_id", *g.AXES))
    b = n.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("other_id"), *g.AXES)
    return spatial.knn(n, b, ["dataset", "t"], ["dataset", "node_id"], "other_id", k)


DIST = "sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux))"
NEXT = f"(SELECT a.dataset, a.t, a.node_id, b.node_id other_id, {DIST} dist FROM nodes a JOIN nodes b ON a.dataset=b.dataset AND b.t=a.t+1)"


@query(f"SELECT dataset, t, node_id, other_id, round(dist,6) dist, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset,node_id ORDER BY dist,other_id) AS int) rk FROM {NEXT} z) WHERE rk<=3")
def knn_frames(spark, d):
    return rounded(next_nearest(tracks.nodes(spark, d), 3), "dist").select("dataset", "t", "node_id", "other_id", "dist", "rk")


@query(f"SELECT dataset, t, node_id, other_id, round(dist,6) dist FROM {NEXT} z WHERE dist<=8")
def radius_join(spark, d):
    return rounded(next_frame(tracks.nodes(spark, d), 8.0), "dist").select("dataset", "t", "node_id", "other_id", "dist")


MNN = f"(SELECT dataset, t, node_id, other_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY dataset,node_id ORDER BY dist,other_id) ra, row_number() OVER (PARTITION BY dataset,other_id ORDER BY dist,node_id) rb FROM {NEXT} z WHERE dist<=8) WHERE ra=1 AND rb=1)"


@query(f"SELECT dataset, t, node_id, other_id, round(dist,6) dist FROM {MNN} z")
def mutual_nn(spark, d):
    return rounded(spatial.mutual(next_frame(tracks.nodes(spark, d), 8.0), "node_id", "other_id"), "dist").select("dataset", "t", "node_id", "other_id", "dist")


TRUE = f"(SELECT z.*, e.edge_id IS NOT NULL hit, rank() OVER (PARTITION BY z.dataset,node_id ORDER BY dist) rk FROM {NEXT} z LEFT JOIN edges e ON e.dataset=z.dataset AND e.source_id=node_id AND e.target_id=other_id)"


@query(f"SELECT split_part(dataset,'_',1) prefix, count(*) n, round(avg(CASE WHEN rk<=1 THEN 1.0 ELSE 0 END),6) top1, round(avg(CASE WHEN rk<=3 THEN 1.0 ELSE 0 END),6) top3, round(avg(CASE WHEN rk<=5 THEN 1.0 ELSE 0 END),6) top5 FROM {TRUE} z WHERE hit GROUP BY 1")
def nn_rank_accuracy(spark, d):
    """The rank of the true child among all nodes of the next frame: only nodes nearer than it count, so a link of some length needs a ball of that radius."""
    n, e = saved_graph(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    q = e.join(n.select("dataset", "t", F.col("node_id").alias("source_id"), *g.AXES), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"])
    q = save(q.withColumn("right_dist", g.norm(tuple(F.col(u) - F.col(f"b{u}") for u in g.AXES))).select("dataset", "t", "source_id", "target_id", "right_dist", *g.AXES))
    b = n.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("other_id"), *g.AXES)
    near = spatial.within(q.where("right_dist <= 16"), b, ["dataset", "t"], 16.0).unionByName(spatial.frame_pairs(q.where("right_dist > 16"), b, ["dataset", "t"]))
    r = near.groupBy("dataset", "source_id", "target_id").agg((F.count(F.when(F.col("dist") < F.col("right_dist"), 1)) + 1).alias("rk"))
    top = lambda k: F.round(F.avg((F.col("rk") <= k).cast("double")), 6).alias(f"top{k}")
    return r.groupBy(F.split("dataset", "_")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"), top(1), top(3), top(5))


@query(f"SELECT dataset, count(*) n, sum(CASE WHEN wrong<right_dist THEN 1 ELSE 0 END)::bigint failures, round(avg(wrong-right_dist),6) mean_margin, round(avg(CASE WHEN wrong>0 THEN right_dist/wrong END),6) mean_ratio FROM (SELECT dataset, node_id, min(dist) FILTER (WHERE hit) right_dist, min(dist) FILTER (WHERE NOT hit) wrong FROM {TRUE} z GROUP BY ALL) WHERE right_dist IS NOT NULL GROUP BY 1")
def association_margin(spark, d):
    """How much nearer the true child is than the nearest other node, and their ratio; a node has two children at most, so three neighbours tell."""
    n, e = saved_graph(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    far = g.norm(tuple(F.col(f"a{u}") - F.col(f"b{u}") for u in g.AXES))
    right = e.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"]).groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.min(far).alias("r"))
    links = e.select("dataset", F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"))
    a = n.join(right, ["dataset", "node_id"], "left_semi").select("dataset", "t", "node_id", *g.AXES)
    b = n.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("other_id"), *g.AXES)
    near = spatial.knn(a, b, ["dataset", "t"], ["dataset", "node_id"], "other_id", 3).join(links, ["dataset", "node_id", "other_id"], "left_anti")
    m = right.join(near.groupBy("dataset", "node_id").agg(F.min("dist").alias("w")), ["dataset", "node_id"], "left")
    return m.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("w") < F.col("r"), 1).otherwise(0)).alias("failures"), F.round(F.avg(F.col("w") - F.col("r")), 6).alias("mean_margin"), F.round(F.avg(F.when(F.col("w") > 0, F.col("r") / F.col("w"))), 6).alias("mean_ratio")
    )


GTD = "sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux))"


def gt_pairs(spark, d, radius):
    n = tracks.nodes(spark, d)
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    return spatial.within(a, n.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], radius), a


@query(f"SELECT r radius, count(*) n, round(avg(CASE WHEN best<=r THEN 1.0 ELSE 0 END),6) coverage FROM (SELECT a.dataset, a.node_id, min({GTD}) best FROM gt_nodes a JOIN nodes b ON a.dataset=b.dataset AND a.t=b.t GROUP BY ALL), (VALUES (1),(2),(3),(4)) v(r) GROUP BY 1")
def detection_coverage(spark, d):
    p, a = gt_pairs(spark, d, 4.0)
    best = a.join(p.groupBy("dataset", "gt_id").agg(F.min("dist").alias("best")), ["dataset", "gt_id"], "left").withColumn("radius", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    return best.groupBy("radius").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("best") <= F.col("radius")).cast("double"), F.lit(0.0))), 6).alias("coverage"))


@query(f"SELECT budget, count(*) n, round(avg(CASE WHEN best<=3 THEN 1.0 ELSE 0 END),6) coverage FROM (SELECT budget, a.dataset, a.node_id, min(CASE WHEN b.rk<=budget THEN {GTD} END) best FROM gt_nodes a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dataset,t ORDER BY d DESC,node_id) rk FROM nodes) b ON a.dataset=b.dataset AND a.t=b.t, (VALUES (10),(25),(50),(100)) v(budget) GROUP BY ALL) GROUP BY 1")
def budget_coverage(spark, d):
    """Coverage within 3 um by the best-scored detections of each frame; the pairs are made once for all budgets."""
    n = tracks.nodes(spark, d).withColumn("rk", F.row_number().over(Window.partitionBy("dataset", "t").orderBy(F.desc("d"), "node_id")))
    a = tracks.um(tracks.gt_nodes(n)).select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    p = spatial.within(a, n.select("dataset", "t", "node_id", "rk", *g.AXES), ["dataset", "t"], 3.0).groupBy("dataset", "gt_id").agg(F.min("rk").alias("rk"))
    b = a.join(p, ["dataset", "gt_id"], "left").withColumn("budget", F.explode(F.array(*[F.lit(i) for i in (10, 25, 50, 100)])))
    return b.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("rk") <= F.col("budget")).cast("double"), F.lit(0.0))), 6).alias("coverage"))


GM = "(SELECT a.dataset, a.t, b.uz-a.uz dz, b.uy-a.uy dy, b.ux-a.ux dx FROM gt_edges e JOIN gt_nodes a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN gt_nodes b ON b.dataset=e.dataset AND b.node_id=e.target_id)"


def moves(spark, d):
    n, e = gt(spark, d)
    at = lambda k, p: n.select("dataset", F.col("node_id").alias(k), F.col("t").alias(f"{p}t"), *[F.col(u).alias(f"{p}{u}") for u in g.AXES])
    m = e.join(at("source_id", "a"), ["dataset", "source_id"]).join(at("target_id", "b"), ["dataset", "target_id"])
    return m.select("dataset", "source_id", "target_id", F.col("at").alias("t"), *[(F.col(f"b{u}") - F.col(f"a{u}")).alias(f"d{u[1]}") for u in g.AXES])


@query(f"""SELECT dataset, t, n, round(mz,6) mz, round(my,6) my, round(mx,6) mx, round(CASE WHEN ml>0 THEN least(1.0::double, sqrt(mz*mz+my*my+mx*mx)/ml) ELSE 0 END,6) coherence FROM
 (SELECT dataset, t, count(*) n, quantile_cont(dz,0.5) mz, quantile_cont(dy,0.5) my, quantile_cont(dx,0.5) mx, quantile_cont(sqrt(dz*dz+dy*dy+dx*dx),0.5) ml FROM {GM} z GROUP BY ALL)""")
def frame_motion(spark, d):
    return frame_shift(moves(spark, d))


def frame_shift(m):
    mid = lambda c: F.percentile(c, 0.5)
    f = m.withColumn("l", g.norm((F.col("dz"), F.col("dy"), F.col("dx")))).groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), mid("dz").alias("mz"), mid("dy").alias("my"), mid("dx").alias("mx"), mid("l").alias("ml"))
    c = F.when(F.col("ml") > 0, F.least(F.lit(1.0), g.norm((F.col("mz"), F.col("my"), F.col("mx"))) / F.col("ml"))).otherwise(0.0)
    return rounded(f.withColumn("coherence", c), "mz", "my", "mx", "coherence").drop("ml")


@query(f"""SELECT threshold, count(*) FILTER (WHERE coherence>=0.8 AND jump>=threshold) jumps FROM (SELECT sqrt(mz*mz+my*my+mx*mx) jump, CASE WHEN ml>0 THEN least(1.0::double, sqrt(mz*mz+my*my+mx*mx)/ml) ELSE 0 END coherence FROM
 (SELECT dataset, t, quantile_cont(dz,0.5) mz, quantile_cont(dy,0.5) my, quantile_cont(dx,0.5) mx, quantile_cont(sqrt(dz*dz+dy*dy+dx*dx),0.5) ml FROM {GM} z GROUP BY ALL)), (VALUES (0.5),(1.0),(2.0),(5.0)) v(threshold) GROUP BY 1""")
def coherent_jumps(spark, d):
    f = frame_shift(moves(spark, d)).withColumn("jump", g.norm((F.col("mz"), F.col("my"), F.col("mx")))).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 5.0)])))
    return f.groupBy(F.col("threshold").cast("decimal(2,1)").alias("threshold")).agg(F.count(F.when((F.col("coherence") >= 0.8) & (F.col("jump") >= F.col("threshold")), 1)).alias("jumps"))


@query(f"""SELECT dataset, t, count(*) n, round(quantile_cont(b.uz-a.uz,0.5),6) mz, round(quantile_cont(b.uy-a.uy,0.5),6) my, round(quantile_cont(b.ux-a.ux,0.5),6) mx FROM (SELECT z.dataset, z.t, z.node_id, z.other_id FROM {MNN} z) m JOIN nodes a USING (dataset,t,node_id) JOIN nodes b ON b.dataset=m.dataset AND b.node_id=m.other_id GROUP BY ALL""".replace("SELECT dataset, t, count", "SELECT m.dataset, m.t, count"))
def mnn_motion(spark, d):
    n = tracks.nodes(spark, d)
    p = spatial.mutual(next_frame(n, 8.0), "node_id", "other_id").select("dataset", "t", "node_id", "other_id")
    at = lambda k, q: n.select("dataset", F.col("node_id").alias(k), *[F.col(u).alias(f"{q}{u}") for u in g.AXES])
    m = p.join(at("node_id", "a"), ["dataset", "node_id"]).join(at("other_id", "b"), ["dataset", "other_id"])
    mid = [F.round(F.percentile(F.col(f"b{u}") - F.col(f"a{u}"), 0.5), 6).alias(f"m{u[1]}") for u in g.AXES]
    return m.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), *mid)


def others_shift(m):
    """Adds sz, sy, sx: the median move of the other links of the frame, where there are three at least.

    A median without one value needs only the sorted values of the frame, which go along as one array per frame (bounded by the volume)."""
    out = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dataset", "t"))).where("n >= 3")
    frame = out.groupBy("dataset", "t").agg(*[F.array_sort(F.collect_list(f"d{k}")).alias(f"_s{k}") for k in "zyx"])
    out = out.join(frame, ["dataset", "t"])

    def rest(k):
        i = F.array_position(F.col(f"_s{k}"), F.col(f"d{k}")).cast("int") - 1
        pick = lambda j: F.get(F.col(f"_s{k}"), F.when(j >= i, j + 1).otherwise(j).cast("int"))
        left = F.col("n") - 1
        return (pick(F.floor((left - 1) / 2)) + pick(F.floor(left / 2))) / 2

    return out.withColumns({f"s{k}": rest(k) for k in "zyx"}).drop("n", "_sz", "_sy", "_sx")


@query(f"""SELECT a.dataset, a.source_id, a.t, round(sqrt(power(a.dz-quantile_cont(b.dz,0.5),2)+power(a.dy-quantile_cont(b.dy,0.5),2)+power(a.dx-quantile_cont(b.dx,0.5),2)),6) residual
 FROM {GM.replace("a.t,", "a.t, a.node_id source_id, e.target_id,")} a JOIN {GM.replace("a.t,", "a.t, a.node_id source_id, e.target_id,")} b ON a.dataset=b.dataset AND a.t=b.t AND a.target_id<>b.target_id GROUP BY a.dataset,a.source_id,a.target_id,a.t,a.dz,a.dy,a.dx HAVING count(*)>=2""")
def motion_residuals(spark, d):
    """Each link's distance from the median of the other links of its frame (three links at least)."""
    m = others_shift(moves(spark, d))
    diff = tuple(F.col(f"d{k}") - F.col(f"s{k}") for k in "zyx")
    return m.select("dataset", "source_id", "t", F.round(g.norm(diff), 6).alias("residual"))
