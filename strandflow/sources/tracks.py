"""Lineage tables derived from the given tables: order lines become tracks (one per order, one frame per line number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.geometry import SCALE


def number(ds: str) -> str:
    """SQL of a dataset's number in its name: four digits at least, and all of them (a plain lpad would cut 10000 to 1000, a name that is taken)."""
    text = f"CAST({ds} AS varchar(20))"
    return f"lpad({text},CAST(greatest(4,length({text})) AS int),'0')"


#: The node and edge rules, in SQL that Spark and DuckDB share.
TRACK = ["*", "CAST(floor(c/300) AS bigint) AS ds", "c % 10 AS r", "CASE WHEN c % 10 = 1 THEN c-1 ELSE c END AS p"]
NODE = [
    f"concat(CASE WHEN ds % 3 = 0 THEN '44b6_' ELSE '6bba_' END, {number('ds')}) AS dataset",
    "c*10+t AS node_id", "c", "t", "r", "d", "tx", "ds",
    "CAST((p*1299709)%60 + 1 + (p%2)*(t-4)*0.5 + (CAST(q AS bigint)%3-1)*0.5 AS double) AS z",
    "CAST((p*104729)%240 + 8 + (p%5-2)*(t-4) + (CAST(q AS bigint)%3-1)*2 AS double) AS y",
    "CAST((p*7919)%240 + CASE WHEN r=1 THEN 27 WHEN r=0 AND t>=4 THEN 5 ELSE 16 END + (p%7-3)*(t-4) + (pk%3-1)*2 AS double) AS x",
    "pk % 4 <> 0 AS high_conf",
]
PROB = "least(1.0, 0.5+b_d*5-b_tx*0.5+CASE WHEN a_c<>b_c THEN 0.0 ELSE 0.04 END)"


def um(df: DataFrame) -> DataFrame:
    """Adds uz, uy, ux: voxel coordinates times the scale."""
    return df.withColumns({u: F.col(v) * F.lit(s) for u, v, s in zip(("uz", "uy", "ux"), ("z", "y", "x"), SCALE, strict=True)})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    obs = lines.groupBy(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("t")).agg(
        F.min("l_quantity").alias("q"), F.min("l_partkey").alias("pk"), F.min("l_discount").alias("d"), F.min("l_tax").alias("tx")
    )
    return um(obs.selectExpr(*TRACK).where("NOT (r=1 AND t<4)").selectExpr(*NODE))


def edges(nodes: DataFrame) -> DataFrame:
    """Edges of consecutive frames: along a track (some links are missing), and from a mother to its daughter track at frame 3."""
    a = nodes.select("dataset", F.col("node_id").alias("source_id"), F.col("t").alias("a_t"), F.col("c").alias("a_c"), F.col("r").alias("a_r"))
    a = a.withColumn("to", F.explode(F.when((F.col("a_r") == 0) & (F.col("a_t") == 3), F.array(F.col("a_c"), F.col("a_c") + 1)).otherwise(F.array("a_c"))))
    b = nodes.select("dataset", F.col("node_id").alias("target_id"), (F.col("t") - 1).alias("a_t"), F.col("c").alias("to"), F.col("d").alias("b_d"), F.col("tx").alias("b_tx"))
    both = a.join(b, ["dataset", "a_t", "to"]).withColumn("b_c", F.col("to")).where("(a_c = b_c AND (a_c + a_t) % 11 <> 0) OR (a_r = 0 AND b_c = a_c + 1 AND a_t = 3)")
    return both.select("dataset", (F.col("source_id") * 100000000 + F.col("target_id")).alias("edge_id"), "source_id", "target_id", F.expr(PROB).alias("edge_prob"))


def gt_nodes(nodes: DataFrame) -> DataFrame:
    """Annotated tracks: every third group of ten orders, without the jitter of the detections."""
    return nodes.where("floor(c/10) % 3 = 0").select(
        "dataset", "node_id", "c", "t", "r", (F.col("z") + F.lit(0.25)).alias("z"), (F.col("y") + (F.col("c") % 3)).alias("y"), (F.col("x") - (F.col("t") % 2)).alias("x")
    )


def datasets(nodes: DataFrame) -> DataFrame:
    """One row per dataset: prefix, fold, frames, nodes and the estimated number of nodes."""
    return nodes.groupBy("dataset", "ds").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("t").alias("n_frames")).select(
        "dataset", F.split("dataset", "_")[0].alias("prefix"), (F.col("ds") % 5).cast("int").alias("fold"), "n_frames", "n_nodes", (F.col("n_nodes") * F.lit(1.1)).alias("estimated_nodes")
    )


def pair_scores(nodes: DataFrame, radius: float = 12.0) -> DataFrame:
    """(dataset, t, source_id, target_id, raw_logit, dist): all pairs of frames t and t + 1 within the radius."""
    from strandflow.operators.spatial import within

    a = nodes.select("dataset", "t", F.col("node_id").alias("source_id"), "uz", "uy", "ux")
    b = nodes.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"), "uz", "uy", "ux")
    p = within(a, b, ["dataset", "t"], radius)
    return p.select("dataset", "t", "source_id", "target_id", (F.lit(4.0) - F.col("dist") + ((F.col("source_id") * 7 + F.col("target_id")) % 5) * F.lit(0.125)).alias("raw_logit"), "dist")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored peaks: every order line, of which only some are persisted detections."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("t"), F.col("l_suppkey").alias("s")).agg(F.min("l_extendedprice").alias("price")).selectExpr(
        f"concat('6bba_', {number('CAST(floor(c/300) AS bigint)')}) AS dataset", "t", "CAST((c*31+s)%20 AS int) AS z", "CAST((c*17+s*3)%60 AS int) AS y", "CAST((c*13+s*7)%60 AS int) AS x",
        "CAST(0.88 AS double) + (CAST(floor(price) AS bigint) % 1200) * CAST(0.0001 AS double) AS prob",
    ).groupBy("dataset", "t", "z", "y", "x").agg(F.max("prob").alias("prob"))


def gt_edges(gt: DataFrame) -> DataFrame:
    """Annotated links of consecutive frames, mother to daughter at frame 3 included."""
    a = gt.select("dataset", F.col("node_id").alias("source_id"), (F.col("t") + 1).alias("t"), F.explode(F.when((F.col("r") == 0) & (F.col("t") == 3), F.array(F.col("c"), F.col("c") + 1)).otherwise(F.array("c"))).alias("c"))
    return a.join(gt.select("dataset", F.col("node_id").alias("target_id"), "t", "c"), ["dataset", "t", "c"]).select("dataset", "source_id", "target_id")
