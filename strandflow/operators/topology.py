"""Degrees, roles, lineages and components of lineage graphs (nodes, edges keyed by dataset)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandflow.sources.shared import save


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree (0 if none): one pass over the edge ends, one join."""
    ends = edges.select("dataset", F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    d = ends.groupBy("dataset", F.col("e.node_id").alias("node_id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.join(d, ["dataset", "node_id"], "left").fillna(0, ["in_degree", "out_degree"])


def role(i: Column, o: Column) -> Column:
    return (
        F.when((i == 0) & (o == 0), "singleton").when(o >= 2, "division_parent").when((i + o) == 1, "endpoint").when((i == 1) & (o == 1), "internal").otherwise("other")
    )


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with component: the least node id of each weakly connected component."""
    many = edges.groupBy("dataset", "target_id").count().where("count > 1")
    found = rooted(nodes, edges) if many.isEmpty() else stars(nodes, edges)
    return nodes.join(found, ["dataset", "node_id"])


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, node_id, component) of a forest (no node with two edges in), by pointer doubling.

    Each node points to its parent; in each round to where its parent points, so a lineage over n frames takes log2(n) joins. Rounds go
    on until no pointer moves, each written out, else the plan would double with each. A tree is then named by its least node.
    """
    up = edges.select("dataset", F.col("target_id").alias("node_id"), F.col("source_id").alias("up"))
    p = nodes.select("dataset", "node_id").join(up, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce("up", "node_id").alias("up"))
    p = save(p)
    while True:
        q = p.select("dataset", F.col("node_id").alias("up"), F.col("up").alias("next"))
        seen = Observation()
        p = save(p.join(q, ["dataset", "up"]).select("dataset", "node_id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), seen, F.max("moved").alias("moved"))
        if not seen.get["moved"]:
            break
        p = p.drop("moved")
    least = p.groupBy("dataset", "up").agg(F.min("node_id").alias("component"))
    return p.drop("moved").join(least, ["dataset", "up"]).select("dataset", "node_id", "component")


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, node_id, component) of any graph, by alternating stars.

    A large star links each node's greater neighbours to its least neighbour, a small star its lesser ones; both are a minimum per node and
    a join, and chains and hubs shrink in a logarithmic number of rounds. Rounds go on until the edges stay the same, which two sums tell.
    """
    ends = lambda e, a, b: e.select("dataset", F.col(a).alias("a"), F.col(b).alias("b"))
    e = save(edges.where("source_id <> target_id").select("dataset", F.greatest("source_id", "target_id").alias("a"), F.least("source_id", "target_id").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(ends(e, "b", "a"))
        least = both.groupBy("dataset", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, ["dataset", "a"]).select("dataset", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.join(large.groupBy("dataset", "a").agg(F.min("b").alias("m")), ["dataset", "a"])
        seen = Observation()
        e = save(ends(small, "a", "m").unionByName(ends(small, "b", "m")).where("a <> b").distinct(), seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("dataset", "a", "b").cast("decimal(38,0)")).alias("s"))
        now = seen.get
        if now == before:
            break
        before = now
    found = e.select("dataset", F.col("a").alias("node_id"), F.col("b").alias("component"))
    return nodes.select("dataset", "node_id").join(found, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce("component", "node_id").alias("component"))


def predecessors(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(dataset, node_id, prev_id, prev2_id): the lineage one and two exactly consecutive frames back."""
    t = times.select("dataset", "node_id", "t")
    e = (
        edges.select("dataset", "source_id", "target_id")
        .join(t.select("dataset", F.col("node_id").alias("source_id"), F.col("t").alias("ts")), ["dataset", "source_id"])
        .join(t.select("dataset", F.col("node_id").alias("target_id"), F.col("t").alias("tt")), ["dataset", "target_id"])
        .where("tt = ts + 1")
        .select("dataset", "source_id", "target_id")
    )
    one = e.select("dataset", F.col("target_id").alias("node_id"), F.col("source_id").alias("prev_id"))
    two = e.select("dataset", F.col("target_id").alias("prev_id"), F.col("source_id").alias("prev2_id"))
    return one.join(two, ["dataset", "prev_id"], "left").select("dataset", "node_id", "prev_id", "prev2_id")
