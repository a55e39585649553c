"""Queries over matching, scores and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import metrics as M
from strandflow.operators import policies
from strandflow.plans import oracle
from strandflow.plans.graph import gt
from strandflow.plans.policies import graph, saved_graph
from strandflow.plans.registry import query
from strandflow.sources import tracks
from strandflow.sources.shared import save

RAW, G2 = oracle.records("edges"), oracle.records("g2_edges")


class Study:
    """Detections, links, annotations and their matches, each written once per query."""

    def __init__(self, spark, d):
        self.nodes, self.edges = saved_graph(spark, d)
        gn = tracks.gt_nodes(self.nodes)
        self.gt_nodes, self.gt_edges = save(tracks.um(gn)), save(tracks.gt_edges(gn))
        self.matches = save(M.match_nodes(self.gt_nodes, self.nodes))
        self.sizes = tracks.datasets(self.nodes).withColumn("estimated_nodes", F.col("estimated_nodes") * F.lit(0.95))

    def records(self, edges):
        """The metrics of each dataset for a set of links."""
        counts = M.edge_accounting(edges, self.gt_edges, self.matches)
        division, _ = M.division_accounting(edges, self.gt_edges, self.matches)
        return save(M.dataset_metrics(counts, division, self.matches, self.gt_nodes, self.sizes))

    def filtered(self):
        return save(policies.division_filter(self.nodes, self.edges))


@query("SELECT dataset, t, gt_id, node_id, round(dist,6) dist FROM matches")
def match_nodes(spark, d):
    g, _ = gt(spark, d)
    return M.match_nodes(g, tracks.nodes(spark, d)).select("dataset", "t", "gt_id", "node_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT dataset, tp, fp, fn FROM {oracle.edge_counts('edges')} z")
def edge_accounting(spark, d):
    s = Study(spark, d)
    return M.edge_accounting(s.edges, s.gt_edges, s.matches)


@query(f"SELECT dataset, tp, fp, fn FROM {oracle.division_counts('edges')} z")
def division_accounting(spark, d):
    s = Study(spark, d)
    return M.division_accounting(s.edges, s.gt_edges, s.matches)[0]


VALUES = ["edge_jaccard", "node_ratio", "adjusted", "node_recall"]
COUNTS = ["tp", "fp", "fn", "division_tp", "division_fp", "division_fn"]


@query(f"SELECT dataset, prefix, fold, {', '.join(COUNTS)}, {', '.join(f'round({v},6) {v}' for v in VALUES)} FROM {RAW} z")
def dataset_metrics(spark, d):
    s = Study(spark, d)
    return s.records(s.edges).select("dataset", "prefix", "fold", *COUNTS, *[F.round(v, 6).alias(v) for v in VALUES])


@query("SELECT g.dataset, count(*) gt_nodes, count(m.gt_id) matched, round(count(m.gt_id)*1.0::double/count(*),6) node_recall FROM gt_nodes g LEFT JOIN matches m ON m.dataset=g.dataset AND m.gt_id=g.node_id GROUP BY 1")
def node_recall(spark, d):
    """The share of annotated nodes that a detection is matched to."""
    g, _ = gt(spark, d)
    g = save(g)
    m = M.match_nodes(g, tracks.nodes(spark, d)).select("dataset", F.col("gt_id").alias("node_id"), F.lit(1).alias("m"))
    r = g.join(m, ["dataset", "node_id"], "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("gt_nodes"), F.count("m").alias("matched"))
    return r.withColumn("node_recall", F.round(F.col("matched") / F.col("gt_nodes"), 6))


@query(f"SELECT dataset, round(node_ratio,6) node_ratio, round(edge_jaccard,6) edge_jaccard, round(adjusted,6) adjusted FROM {RAW} z")
def node_count_penalty(spark, d):
    s = Study(spark, d)
    return s.records(s.edges).select("dataset", *[F.round(c, 6).alias(c) for c in ("node_ratio", "edge_jaccard", "adjusted")])


SUM = """count(*) n, sum(tp)*1.0::double/sum(tp+fp+fn) edge_jaccard, sum(adjusted*(tp+fp+fn))/sum(tp+fp+fn) adjusted, CASE WHEN sum(division_tp+division_fp+division_fn)>0 THEN sum(division_tp)*1.0::double/sum(division_tp+division_fp+division_fn) ELSE 0 END division_jaccard, avg(node_recall) node_recall"""
SUMMED = ["edge_jaccard", "adjusted", "division_jaccard", "node_recall", "score"]
SHOW = ", ".join(f"round({c},6) {c}" for c in SUMMED[:-1]) + ", round(adjusted+0.1::double*division_jaccard,6) score"


@query(f"SELECT n, {SHOW} FROM (SELECT {SUM} FROM {RAW} z)")
def score_summary(spark, d):
    s = Study(spark, d)
    return M.summary(s.records(s.edges)).select("n", *[F.round(c, 6).alias(c) for c in SUMMED])


@query(f"SELECT a.prefix, a.n, {', '.join(f'round(a.{c},6) {c}' for c in SUMMED[:-1])}, round(a.adjusted+0.1::double*a.division_jaccard,6) score, round(b.adjusted+0.1::double*b.division_jaccard-a.adjusted-0.1::double*a.division_jaccard,6) filtered_delta FROM (SELECT prefix, {SUM} FROM {RAW} z GROUP BY 1) a JOIN (SELECT prefix, {SUM} FROM {G2} z GROUP BY 1) b USING (prefix)")
def summary_by_prefix(spark, d):
    """Scores by family, and what the division filter adds to them."""
    s = Study(spark, d)
    a, b = M.summary(s.records(s.edges), "prefix"), M.summary(s.records(s.filtered()), "prefix")
    j = a.join(b.select("prefix", F.col("score").alias("b")), "prefix")
    return j.select("prefix", "n", *[F.round(c, 6).alias(c) for c in SUMMED], F.round(F.col("b") - F.col("score"), 6).alias("filtered_delta"))


@query(f"SELECT coalesce(prefix,'all') prefix, coalesce(fold,-1) fold, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn FROM {RAW} z GROUP BY GROUPING SETS ((),(prefix),(prefix,fold))")
def fold_stability(spark, d):
    """Totals, families and folds in one pass of rollup."""
    s = Study(spark, d)
    r = s.records(s.edges).rollup("prefix", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return r.select(F.coalesce("prefix", F.lit("all")).alias("prefix"), F.coalesce("fold", F.lit(-1)).alias("fold"), "tp", "fp", "fn")


THRESHOLDS = (0.5, 0.6, 0.75)


@query("SELECT fold, " + ", ".join(f"round(max(CASE WHEN threshold={v} THEN j END),6) j{round(100 * v)}" for v in THRESHOLDS) + " FROM (" + " UNION ALL ".join(f"SELECT {v} threshold, fold, sum(tp)*1.0::double/sum(tp+fp+fn) j FROM {oracle.edge_counts(f'(SELECT * FROM edges WHERE edge_prob>={v}::double)')} a JOIN datasets d USING (dataset) GROUP BY ALL" for v in THRESHOLDS) + ") GROUP BY 1")
def threshold_by_fold(spark, d):
    """Pooled edge Jaccard of links above several thresholds, folds down and thresholds across; thresholds are part of the key, so it is one job."""
    s = Study(spark, d)
    e = s.edges.withColumn("v", F.explode(F.array(*[F.lit(v) for v in THRESHOLDS]))).where(F.col("edge_prob") >= F.col("v"))
    key = lambda df: df.withColumn("v", F.explode(F.array(*[F.lit(v) for v in THRESHOLDS])))
    named = lambda df: df.withColumn("dataset", F.concat_ws("|", "dataset", F.col("v").cast("string")))
    c = M.edge_accounting(named(e), named(key(s.gt_edges)), named(key(s.matches)))
    c = c.select(F.split("dataset", r"\|")[0].alias("dataset"), F.split("dataset", r"\|")[1].cast("double").alias("v"), "tp", "fp", "fn").join(s.sizes.select("dataset", "fold"), "dataset")
    p = c.groupBy("fold").pivot("v", list(THRESHOLDS)).agg(F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fp") + F.col("fn")), 6))
    return p.select("fold", *[F.col(f"`{v}`").alias(f"j{round(100 * v)}") for v in THRESHOLDS])


PAIRED = f"(SELECT a.prefix, a.dataset, b.tp-a.tp tp_delta, b.fp-a.fp fp_delta, b.edge_jaccard-a.edge_jaccard delta FROM {RAW} a JOIN {G2} b USING (dataset))"


def paired(spark, d):
    """Raw links and those after the division filter, side by side by dataset."""
    s = Study(spark, d)
    a = s.records(s.edges).select("dataset", "prefix", F.col("tp").alias("atp"), F.col("fp").alias("afp"), F.col("edge_jaccard").alias("aj"))
    j = a.join(s.records(s.filtered()).select("dataset", "tp", "fp", "edge_jaccard"), "dataset")
    return j.select("dataset", "prefix", (F.col("tp") - F.col("atp")).alias("tp_delta"), (F.col("fp") - F.col("afp")).alias("fp_delta"), (F.col("edge_jaccard") - F.col("aj")).alias("delta"))


@query(f"SELECT prefix, count(*) n, round(avg(CASE WHEN delta>1e-12 THEN 1.0 ELSE 0 END),6) improved, sum(tp_delta)::bigint tp_delta, sum(fp_delta)::bigint fp_delta, round(avg(delta),6) mean_delta FROM {PAIRED} z GROUP BY 1")
def paired_deltas(spark, d):
    g = paired(spark, d).groupBy("prefix")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("delta") > 1e-12).cast("double")), 6).alias("improved"), F.sum("tp_delta").alias("tp_delta"), F.sum("fp_delta").alias("fp_delta"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query(f"SELECT count(*) FILTER (WHERE abs(delta)<=1e-12) unchanged, count(*) FILTER (WHERE delta>1e-12) improved, count(*) FILTER (WHERE delta< -1e-12) worsened FROM {PAIRED} z")
def paired_outcomes(spark, d):
    v = F.col("delta")
    return paired(spark, d).agg(F.count(F.when(F.abs(v) <= 1e-12, 1)).alias("unchanged"), F.count(F.when(v > 1e-12, 1)).alias("improved"), F.count(F.when(v < -1e-12, 1)).alias("worsened"))


@query("SELECT CAST(ratio AS double) ratio, round(greatest(0, 0.5*(1-0.1*ratio)),6)::double j50, round(greatest(0, 0.75*(1-0.1*ratio)),6)::double j75, round(greatest(0, 1.0*(1-0.1*ratio)),6)::double j100 FROM (SELECT DISTINCT (fold-2)*0.5 ratio FROM datasets)")
def penalty_grid(spark, d):
    r = tracks.datasets(tracks.nodes(spark, d)).select(((F.col("fold") - 2) * 0.5).alias("ratio")).distinct().withColumn("j", F.explode(F.array(F.lit(50), F.lit(75), F.lit(100))))
    v = F.round(F.greatest(F.lit(0.0), F.col("j") / 100 * (1 - 0.1 * F.col("ratio"))), 6)
    p = r.groupBy("ratio").pivot("j", [50, 75, 100]).agg(F.max(v))
    return p.select("ratio", *[F.col(str(j)).alias(f"j{j}") for j in (50, 75, 100)])


GATED = [*COUNTS, *VALUES]


@query(f"SELECT a.dataset, u.metric, abs(u.x-u.y)<=CASE WHEN u.metric IN ({', '.join(repr(c) for c in COUNTS)}) THEN 0 ELSE 5e-7 END ok FROM {RAW} a JOIN {G2} b USING (dataset), LATERAL (SELECT unnest([{', '.join(repr(c) for c in GATED)}]) metric, unnest([{', '.join(f'a.{c}::double' for c in GATED)}]) x, unnest([{', '.join(f'b.{c}::double' for c in GATED)}]) y) u")
def reproduction_gate(spark, d):
    """Does the filtered graph reproduce the raw graph's record? Counts exactly, values to 5e-7, one row per dataset and metric."""
    s = Study(spark, d)
    long = lambda r, v: r.select("dataset", *[F.col(c).cast("double").alias(c) for c in GATED]).unpivot(["dataset"], GATED, "metric", v)
    j = long(s.records(s.filtered()), "measured").join(long(s.records(s.edges), "expected"), ["dataset", "metric"])
    return j.select("dataset", "metric", (F.abs(F.col("measured") - F.col("expected")) <= F.when(F.col("metric").isin(COUNTS), 0.0).otherwise(5e-7)).alias("ok"))


@query(f"SELECT dataset, tp, fp, fn FROM {oracle.edge_counts('edges')} z ORDER BY round(tp*1.0::double/(tp+fp+fn),9), dataset LIMIT 15")
def worst_datasets(spark, d):
    s = Study(spark, d)
    return M.edge_accounting(s.edges, s.gt_edges, s.matches).orderBy(F.round(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")), 9), "dataset").limit(15)


MISS = """(SELECT g.*, a.node_id ps, b.node_id pt, CASE WHEN a.gt_id IS NULL AND b.gt_id IS NULL THEN 'both_missing' WHEN a.gt_id IS NULL THEN 'source_missing' WHEN b.gt_id IS NULL THEN 'target_missing' ELSE 'linking' END cause
 FROM gt_edges g LEFT JOIN matches a ON a.dataset=g.dataset AND a.gt_id=g.source_id LEFT JOIN matches b ON b.dataset=g.dataset AND b.gt_id=g.target_id LEFT JOIN edges e ON e.dataset=g.dataset AND e.source_id=a.node_id AND e.target_id=b.node_id WHERE e.edge_id IS NULL)"""


def missed(s: Study):
    """Annotated links that the graph lacks: source_id and target_id of the annotation, the detections ps and pt matched to them, and the cause."""
    m = s.matches
    j = s.gt_edges.join(m.select("dataset", F.col("gt_id").alias("source_id"), F.col("node_id").alias("ps")), ["dataset", "source_id"], "left").join(m.select("dataset", F.col("gt_id").alias("target_id"), F.col("node_id").alias("pt")), ["dataset", "target_id"], "left")
    j = j.join(s.edges.select("dataset", F.col("source_id").alias("ps"), F.col("target_id").alias("pt")), ["dataset", "ps", "pt"], "left_anti")
    a, b = F.col("ps").isNull(), F.col("pt").isNull()
    return j.withColumn("cause", F.when(a & b, "both_missing").when(a, "source_missing").when(b, "target_missing").otherwise("linking"))


@query(f"SELECT cause, topology, count(*) n, count(*) FILTER (WHERE swap) swap_support FROM (SELECT cause, CASE WHEN cause<>'linking' THEN 'unmatched' WHEN o.node_id IS NULL AND i.node_id IS NULL THEN 'free_pair' WHEN o.node_id IS NULL THEN 'target_taken' WHEN i.node_id IS NULL THEN 'source_taken' ELSE 'both_taken' END topology, cause='linking' AND o.node_id IS NOT NULL AND i.node_id IS NOT NULL swap FROM {MISS} m LEFT JOIN outd o ON o.dataset=m.dataset AND o.node_id=m.ps LEFT JOIN ind i ON i.dataset=m.dataset AND i.node_id=m.pt) GROUP BY ALL")
def edge_fn_causes(spark, d):
    """Missed annotated links by cause and by what the ends that were found are linked to; swap support: both ends are taken by other links."""
    s = Study(spark, d)
    out = s.edges.select("dataset", F.col("source_id").alias("ps"), F.lit(True).alias("o")).distinct()
    inn = s.edges.select("dataset", F.col("target_id").alias("pt"), F.lit(True).alias("i")).distinct()
    j = missed(s).join(out, ["dataset", "ps"], "left").join(inn, ["dataset", "pt"], "left")
    o, i, linking = F.col("o").isNotNull(), F.col("i").isNotNull(), F.col("cause") == "linking"
    label = F.when(~linking, "unmatched").when(~o & ~i, "free_pair").when(~o, "target_taken").when(~i, "source_taken").otherwise("both_taken")
    return j.groupBy("cause", label.alias("topology")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(linking & o & i, 1)).alias("swap_support"))


@query("SELECT coalesce(max(CASE WHEN s AND NOT t THEN n END),0)::bigint source_only, coalesce(max(CASE WHEN t AND NOT s THEN n END),0)::bigint target_only, coalesce(max(CASE WHEN s AND t THEN n END),0)::bigint both_ends, prefix FROM (SELECT split_part(e.dataset,'_',1) prefix, a.gt_id IS NOT NULL s, b.gt_id IS NOT NULL t, count(*) n FROM edges e LEFT JOIN matches a ON a.dataset=e.dataset AND a.node_id=e.source_id LEFT JOIN matches b ON b.dataset=e.dataset AND b.node_id=e.target_id LEFT JOIN gt_edges g ON g.dataset=e.dataset AND g.source_id=a.gt_id AND g.target_id=b.gt_id WHERE g.source_id IS NULL AND (a.gt_id IS NOT NULL OR b.gt_id IS NOT NULL) GROUP BY ALL) GROUP BY prefix")
def edge_fp_support(spark, d):
    """Wrong links by which of their ends is matched, a row per family (a crosstab)."""
    s = Study(spark, d)
    m = s.matches
    e = s.edges.join(m.select("dataset", F.col("node_id").alias("source_id"), F.col("gt_id").alias("gs")), ["dataset", "source_id"], "left").join(m.select("dataset", F.col("node_id").alias("target_id"), F.col("gt_id").alias("gg")), ["dataset", "target_id"], "left")
    wrong = e.where("gs IS NOT NULL OR gg IS NOT NULL").join(s.gt_edges.select("dataset", F.col("source_id").alias("gs"), F.col("target_id").alias("gg")), ["dataset", "gs", "gg"], "left_anti")
    side = F.when(F.col("gg").isNull(), "source_only").when(F.col("gs").isNull(), "target_only").otherwise("both_ends")
    return wrong.withColumn("side", side).groupBy(F.split("dataset", "_")[0].alias("prefix")).pivot("side", ["source_only", "target_only", "both_ends"]).count().fillna(0)


@query("SELECT d.dataset, d.prefix, d.n_frames, d.n_nodes, coalesce(e.n,0) n_edges, coalesce(f.n,0) n_divisions, coalesce(g.n,0) n_annotated, round(coalesce(g.n,0)/d.estimated_nodes,6) sparse_fraction FROM datasets d LEFT JOIN (SELECT dataset, count(*) n FROM edges GROUP BY 1) e USING (dataset) LEFT JOIN (SELECT dataset, count(*) n FROM forkpairs GROUP BY 1) f USING (dataset) LEFT JOIN (SELECT dataset, count(*) n FROM gt_nodes GROUP BY 1) g USING (dataset)")
def dataset_facts(spark, d):
    n, e = graph(spark, d)
    k = lambda df, name: df.groupBy("dataset").agg(F.count(F.lit(1)).alias(name))
    forks = e.groupBy("dataset", "source_id").count().where("count = 2")
    f = tracks.datasets(n).join(k(e, "n_edges"), "dataset", "left").join(k(forks, "n_divisions"), "dataset", "left").join(k(tracks.gt_nodes(n), "n_annotated"), "dataset", "left").fillna(0, ["n_edges", "n_divisions", "n_annotated"])
    return f.select("dataset", "prefix", "n_frames", "n_nodes", "n_edges", "n_divisions", "n_annotated", F.round(F.col("n_annotated") / F.col("estimated_nodes"), 6).alias("sparse_fraction"))


@query("SELECT dataset, prefix, greatest(((rk-1)*5+n-2)//greatest(n-1,1),1)-1 density_bin FROM (SELECT dataset, prefix, row_number() OVER (PARTITION BY prefix ORDER BY n_nodes*1.0/n_frames, dataset) rk, count(*) OVER (PARTITION BY prefix) n FROM datasets)")
def density_bins(spark, d):
    return bins(spark, d).select("dataset", "prefix", "density_bin")


def bins(spark, d):
    w = Window.partitionBy("prefix")
    s = tracks.datasets(tracks.nodes(spark, d)).withColumns({"rk": F.row_number().over(w.orderBy(F.col("n_nodes") / F.col("n_frames"), "dataset")), "n": F.count(F.lit(1)).over(w)})
    return s.withColumn("density_bin", F.expr("greatest(((rk-1)*5+n-2) div greatest(n-1,1), 1) - 1"))


SEEDS = 5000


def candidate_folds(spark, d, seeds=SEEDS):
    """(seed, dataset, prefix, cand_fold): fold assignments for many seeds, stratified by family and density bin, all seeds in one job."""
    s = bins(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    w = Window.partitionBy("seed", "prefix", "density_bin").orderBy(F.xxhash64("seed", "dataset"), "dataset")
    return s.select("seed", "dataset", "prefix", "n_nodes", ((F.row_number().over(w) - 1 + F.pmod(F.xxhash64("seed", "prefix", "density_bin"), F.lit(5))) % 5).cast("int").alias("cand_fold"))


@query()
def fold_candidates(spark, d):
    return candidate_folds(spark, d)


def balance(f, *by):
    """Weighted relative spread over folds of divisions, datasets with divisions, edges, nodes, datasets, and divisions of each family; f has a row per dataset (and by)."""
    mine = lambda p: F.sum(F.when(F.col("prefix") == p, F.col("n_divisions")).otherwise(0))
    k = f.groupBy(*by, "fold").agg(
        F.sum("n_divisions").alias("divs"), F.sum((F.col("n_divisions") > 0).cast("int")).alias("has"), F.sum("n_edges").alias("edgs"), F.sum("n_nodes").alias("nods"), F.count(F.lit(1)).alias("n"), mine("44b6").alias("d44"), mine("6bba").alias("d6b")
    )
    part = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    return k.groupBy(*by).agg(F.round(4 * part("divs") + 2 * part("has") + 2 * part("edgs") + part("nods") + part("n") + 2 * part("d44") + 2 * part("d6b"), 6).alias("score"))


@query()
def fold_choice(spark, d):
    """The best balanced of all seeds' assignments."""
    facts = save(dataset_facts(spark, d).select("dataset", "n_divisions", "n_edges"))
    c = save(candidate_folds(spark, d).withColumnRenamed("cand_fold", "fold"))
    best = balance(c.join(F.broadcast(facts), "dataset"), "seed").orderBy("score", "seed").limit(1)  # one row a dataset is broadcast
    return c.join(F.broadcast(best), "seed").select("dataset", "fold", "seed", "score")


SPREAD = "CASE WHEN avg({0})>0 THEN stddev_pop({0})/avg({0}) ELSE 0 END"


@query(f"SELECT round(4*{SPREAD.format('divs')}+2*{SPREAD.format('has')}+2*{SPREAD.format('edgs')}+{SPREAD.format('nods')}+{SPREAD.format('n')}+2*{SPREAD.format('d44')}+2*{SPREAD.format('d6b')},6) score FROM (SELECT fold, sum(n_nodes)::double nods, count(*)::double n, sum(coalesce(e.k,0))::double edgs, sum(coalesce(f.k,0))::double divs, (count(*) FILTER (WHERE f.k>0))::double has, sum(CASE WHEN prefix='44b6' THEN coalesce(f.k,0) ELSE 0 END)::double d44, sum(CASE WHEN prefix='6bba' THEN coalesce(f.k,0) ELSE 0 END)::double d6b FROM datasets d LEFT JOIN (SELECT dataset, count(*) k FROM edges GROUP BY 1) e USING (dataset) LEFT JOIN (SELECT dataset, count(*) k FROM forkpairs GROUP BY 1) f USING (dataset) GROUP BY 1)")
def fold_balance_score(spark, d):
    """How unevenly the folds of the manifest share what there is."""
    f = dataset_facts(spark, d).join(tracks.datasets(tracks.nodes(spark, d)).select("dataset", "fold"), "dataset")
    return balance(f)


@query("SELECT fold, count(*) FILTER (WHERE prefix='44b6') n_44b6, count(*) FILTER (WHERE prefix='6bba') n_6bba, sum(n_nodes)::bigint nodes FROM datasets GROUP BY 1")
def fold_summary(spark, d):
    s = tracks.datasets(tracks.nodes(spark, d))
    p = s.groupBy("fold").pivot("prefix", ["44b6", "6bba"]).count().fillna(0)
    return p.join(s.groupBy("fold").agg(F.sum("n_nodes").alias("nodes")), "fold").select("fold", F.col("44b6").alias("n_44b6"), F.col("6bba").alias("n_6bba"), "nodes")


@query("SELECT f.fold, string_agg(d.dataset, ',' ORDER BY d.dataset) FILTER (WHERE d.fold=f.fold) test, string_agg(d.dataset, ',' ORDER BY d.dataset) FILTER (WHERE d.fold<>f.fold) train FROM datasets d, (SELECT DISTINCT fold FROM datasets) f GROUP BY 1")
def fold_lists(spark, d):
    s = tracks.datasets(tracks.nodes(spark, d)).select("dataset", "fold")
    j = s.crossJoin(F.broadcast(s.select(F.col("fold").alias("f")).distinct()))  # folds are a handful
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("dataset")))), ",")
    return j.groupBy(F.col("f").alias("fold")).agg(names(F.col("fold") == F.col("f")).alias("test"), names(F.col("fold") != F.col("f")).alias("train"))
