"""Association scores between frames: softmax, ranks and margins, reciprocal pairs, candidate rules.

Scores are a long table (dataset, t, source_id, target_id, raw_logit); a column is all sources of a target, a row all targets of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def column():
    """The window of a column (made on use: windows need a session)."""
    return Window.partitionBy("dataset", "t", "target_id")


def row():
    return Window.partitionBy("dataset", "t", "source_id")


def column_softmax(scores: DataFrame) -> DataFrame:
    """Adds prob: softmax of the raw logit over the sources of each target (the greatest one is taken off first)."""
    e = F.exp(F.col("raw_logit") - F.max("raw_logit").over(column()))
    return scores.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(column())).drop("_e")


def greedy_edges(probs: DataFrame, least: float = 0.5, children: int = 2) -> DataFrame:
    """Edges above the threshold, at most so many per source by descending probability; above 0.5 a column has one at most, so parents need no cap."""
    w = row().orderBy(F.desc(F.round("prob", 9)), F.desc("target_id"))  # equal up to the order of summing
    return probs.where(F.col("prob") > least).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= children).drop("rk")


def column_stats(probs: DataFrame) -> DataFrame:
    """Rank of each pair in its column (ties by source), the column's two best sources, the margin to the best, and its size."""
    w = column().orderBy(F.desc("prob"), "source_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return probs.withColumns({
        "rank": F.row_number().over(w), "top1": F.first("source_id").over(whole), "top2": F.nth_value("source_id", 2).over(whole), "margin": F.first("prob").over(whole) - F.col("prob"), "size": F.count(F.lit(1)).over(column()),
    })


def row_stats(scores: DataFrame) -> DataFrame:
    """Rank of each pair in its row by raw logit (ties by target), the row's three best targets, and its size."""
    w = row().orderBy(F.desc("raw_logit"), "target_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scores.withColumns({"rank": F.row_number().over(w), **{f"top{k}": F.nth_value("target_id", k).over(whole) for k in (1, 2, 3)}, "size": F.count(F.lit(1)).over(row())})


def top2_targets(scores: DataFrame) -> DataFrame:
    """(dataset, t, source_id, t1, t2, raw1, raw2): the two best targets per source by raw logit."""
    r = scores.withColumn("rk", F.row_number().over(row().orderBy(F.desc("raw_logit"), "target_id"))).where("rk <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c)))
    return r.groupBy("dataset", "t", "source_id").agg(pick("target_id", 1).alias("t1"), pick("target_id", 2).alias("t2"), pick("raw_logit", 1).alias("raw1"), pick("raw_logit", 2).alias("raw2"))


def reciprocal(probs: DataFrame) -> DataFrame:
    """Pairs that are best in their row (raw logit) and best in their column (probability)."""
    p = probs.withColumns({"_r": F.row_number().over(row().orderBy(F.desc("raw_logit"), "target_id")), "_c": F.row_number().over(column().orderBy(F.desc("prob"), "source_id"))})
    return p.where("_r = 1 AND _c = 1").drop("_r", "_c")


def free_pairs(probs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose source has no edge out and whose target has none in."""
    return probs.join(edges.select("dataset", "source_id").distinct(), ["dataset", "source_id"], "left_anti").join(edges.select("dataset", "target_id").distinct(), ["dataset", "target_id"], "left_anti")


def candidate_rules(probs: DataFrame) -> DataFrame:
    """One row per pair and rule that exposes it: column thresholds, the column's best two, the row's best two or three."""
    c, r = F.row_number().over(column().orderBy(F.desc("prob"), "source_id")), F.row_number().over(row().orderBy(F.desc("raw_logit"), "target_id"))
    p = probs.withColumns({"_c": c, "_r": r})
    rules = [(f"column>{v}", F.col("prob") > v) for v in (0.5, 0.4, 0.3, 0.2)] + [("column_top2", F.col("_c") <= 2), ("row_top2", F.col("_r") <= 2), ("row_top3", F.col("_r") <= 3)]
    return p.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])))).drop("_c", "_r")
