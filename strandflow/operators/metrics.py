"""Matching of annotations to detections and the scores built on it. The rules are this library's own definition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.operators import spatial
from strandflow.sources.shared import save

RADIUS = 7.0
UNMATCHED = 7.0001
FRAMES = 16


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment (rows no more than columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, way, taken = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        taken[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            now = cost[taken[j0] - 1] - u[taken[j0]] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[taken[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if taken[j0] == 0:
                break
        while j0:
            taken[j0], j0 = taken[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[taken[1:][taken[1:] > 0] - 1] = np.flatnonzero(taken[1:] > 0)
    return out


def tie(gt_id, node_id):
    """What settles assignments of equal cost: a ten-millionth of a micrometre at most."""
    return (gt_id % 1009) * (node_id % 997) % 1013 * 1e-10


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cheapest assignment of pairs (gt_id, node_id, dist), one small matrix per component of the graph that they make."""
    pdf = pdf.sort_values(["gt_id", "node_id"], ignore_index=True)
    rows, i = np.unique(pdf.gt_id, return_inverse=True)
    cols, j = np.unique(pdf.node_id, return_inverse=True)
    comp = np.arange(len(rows))
    while True:  # components here are a handful of nodes
        low = np.full(len(cols), len(rows))
        np.minimum.at(low, j, comp[i])
        now = comp.copy()
        np.minimum.at(now, i, low[j])
        if (now == comp).all():
            break
        comp = now
    keep = np.zeros(len(pdf), bool)
    dist = pdf.dist.to_numpy() + tie(pdf.gt_id.to_numpy(), pdf.node_id.to_numpy())
    order = np.argsort(comp[i], kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(comp[i][order])) + 1):
        r, x = np.unique(i[part], return_inverse=True)
        c, y = np.unique(j[part], return_inverse=True)
        if len(r) == 1:
            keep[part[np.argmin(dist[part])]] = True
            continue
        cost = np.full((len(r), len(c) + len(r)), 1e6)
        cost[:, len(c) :] = UNMATCHED
        cost[x, y] = dist[part]
        keep[part[assign(cost)[x] == y]] = True
    return pdf[keep]


def match_nodes(gt: DataFrame, nodes: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(dataset, t, gt_id, node_id, dist): one-to-one per frame, at the least total distance, where going unmatched costs UNMATCHED.

    Pairs within the radius come from the grid join. Pairs that have no rival on either side are decided in the join; the others go
    by dataset and FRAMES frames to small assignments, one per component.
    """
    a = gt.select("dataset", "t", F.col("node_id").alias("gt_id"), *g.AXES)
    p = spatial.within(a, nodes.select("dataset", "t", "node_id", *g.AXES), ["dataset", "t"], radius)
    cols = ["dataset", "t", "gt_id", "node_id", "dist"]
    p = p.withColumns({"na": F.count(F.lit(1)).over(Window.partitionBy("dataset", "gt_id")), "nb": F.count(F.lit(1)).over(Window.partitionBy("dataset", "node_id"))})
    p = save(p.select(*cols, ((F.col("na") == 1) & (F.col("nb") == 1)).alias("alone")))
    rivals = p.where("not alone").select(*cols).groupBy("dataset", F.floor(F.col("t") / FRAMES)).applyInPandas(lambda pdf: solve(pdf)[cols], p.select(*cols).schema)
    return p.where("alone").select(*cols).unionByName(rivals)


def edge_accounting(edges: DataFrame, gt_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Per dataset tp, fp, fn: an edge counts if an end is matched; it is right if both are and the annotation links them."""
    m = matches.select("dataset", "node_id", "gt_id")
    e = edges.select("dataset", "source_id", "target_id").join(m.select("dataset", F.col("node_id").alias("source_id"), F.col("gt_id").alias("gs")), ["dataset", "source_id"], "left").join(m.select("dataset", F.col("node_id").alias("target_id"), F.col("gt_id").alias("gtt")), ["dataset", "target_id"], "left")
    e = e.where("gs IS NOT NULL OR gtt IS NOT NULL").join(gt_edges.select("dataset", F.col("source_id").alias("gs"), F.col("target_id").alias("gtt"), F.lit(1).alias("hit")), ["dataset", "gs", "gtt"], "left")
    pred = e.groupBy("dataset").agg(F.count("hit").alias("tp"), F.count(F.when(F.col("hit").isNull(), 1)).alias("fp"))
    total = gt_edges.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    j = total.join(pred, "dataset", "full_outer").fillna(0, ["n", "tp", "fp"])
    return j.select("dataset", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"))


def division_accounting(edges: DataFrame, gt_edges: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, tp, fp, fn) of divisions, and the verdict (tp, fp or not_evaluated) on each predicted fork (dataset, source_id).

    A fork is right if its source is matched to an annotated mother and its branches show both daughters: a branch shows a daughter if its first node, or a node after
    it, is matched to the daughter or to a child of it. A fork is wrong only if the annotation can judge it: its source is matched to a node with an annotated child.
    """
    e = edges.select("dataset", "source_id", "target_id")
    m = matches.select("dataset", "node_id", "gt_id")
    children = gt_edges.groupBy("dataset", F.col("source_id").alias("gt_id")).agg(F.count(F.lit(1)).alias("children"))
    mothers = children.where("children = 2").select("dataset", "gt_id")
    daughters = gt_edges.select("dataset", F.col("source_id").alias("gt_id"), F.col("target_id").alias("daughter")).join(mothers, ["dataset", "gt_id"], "left_semi")
    after = gt_edges.select("dataset", F.col("source_id").alias("daughter"), F.col("target_id").alias("shown"))
    shows = daughters.withColumn("shown", F.col("daughter")).unionByName(daughters.join(after, ["dataset", "daughter"]))
    forks = e.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    judged = forks.join(m.select("dataset", F.col("node_id").alias("source_id"), "gt_id"), ["dataset", "source_id"], "left").join(children, ["dataset", "gt_id"], "left")
    judged = judged.select("dataset", "source_id", "gt_id", F.coalesce("children", F.lit(0)).alias("children"))
    branch = e.join(judged.where("children = 2").drop("children"), ["dataset", "source_id"]).withColumnRenamed("target_id", "branch")
    second = e.select("dataset", F.col("source_id").alias("branch"), F.col("target_id").alias("node_id"))
    seen = branch.withColumn("node_id", F.col("branch")).unionByName(branch.join(second, ["dataset", "branch"]), allowMissingColumns=True).join(m.withColumnRenamed("gt_id", "shown"), ["dataset", "node_id"])
    right = seen.join(shows, ["dataset", "gt_id", "shown"]).groupBy("dataset", "source_id").agg(F.countDistinct("daughter").alias("d"), F.countDistinct("branch").alias("b")).where("d = 2 AND b = 2")
    verdict = judged.join(right.select("dataset", "source_id", F.lit(True).alias("right")), ["dataset", "source_id"], "left")
    verdict = verdict.select("dataset", "source_id", "gt_id", "children", F.when(F.col("right"), "tp").when(F.col("children") > 0, "fp").otherwise("not_evaluated").alias("verdict"))
    total = mothers.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    counts = verdict.groupBy("dataset").agg(F.count(F.when(F.col("verdict") == "tp", 1)).alias("tp"), F.count(F.when(F.col("verdict") == "fp", 1)).alias("fp"))
    every = total.join(counts, "dataset", "full_outer").fillna(0, ["n", "tp", "fp"])
    return every.select("dataset", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn")), verdict


def dataset_metrics(edge: DataFrame, division: DataFrame, matches: DataFrame, gt: DataFrame, sizes: DataFrame) -> DataFrame:
    """One record per dataset of sizes (n_nodes, estimated_nodes): counts, Jaccards, the edge Jaccard adjusted for surplus nodes, node recall."""
    d = division.select("dataset", *[F.col(c).alias(f"division_{c}") for c in ("tp", "fp", "fn")])
    recall = gt.groupBy("dataset").agg(F.count(F.lit(1)).alias("gt_nodes")).join(matches.groupBy("dataset").agg(F.count(F.lit(1)).alias("matched")), "dataset", "left")
    r = sizes.join(edge, "dataset", "left").join(d, "dataset", "left").join(recall, "dataset", "left")
    r = r.fillna(0, ["tp", "fp", "fn", "division_tp", "division_fp", "division_fn", "gt_nodes", "matched"])
    return rates(r)


def rates(r: DataFrame) -> DataFrame:
    """Adds what follows from a dataset's counts: edge_jaccard, node_ratio, adjusted and node_recall."""
    every = F.col("tp") + F.col("fp") + F.col("fn")
    r = r.withColumns({"edge_jaccard": F.when(every > 0, F.col("tp") / every).otherwise(0.0), "node_ratio": F.col("n_nodes") / F.col("estimated_nodes") - 1})
    return r.withColumns({"adjusted": F.greatest(F.lit(0.0), F.col("edge_jaccard") * (1 - 0.1 * F.col("node_ratio"))), "node_recall": F.when(F.col("gt_nodes") > 0, F.col("matched") / F.col("gt_nodes")).otherwise(0.0)})


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Pooled edge and division Jaccard, the edge-weighted mean of the adjusted one, the plain mean of node recall, and the score."""
    w = F.col("tp") + F.col("fp") + F.col("fn")
    v = F.sum(F.col("division_tp") + F.col("division_fp") + F.col("division_fn"))
    s = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("tp") / F.sum(w)).alias("edge_jaccard"), (F.sum(F.col("adjusted") * w) / F.sum(w)).alias("adjusted"),
        F.when(v > 0, F.sum("division_tp") / v).otherwise(0.0).alias("division_jaccard"), F.avg("node_recall").alias("node_recall"),
    )
    return s.withColumn("score", F.col("adjusted") + 0.1 * F.col("division_jaccard"))
