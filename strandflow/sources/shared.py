"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A saved table of more rows is never broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one (tests) gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def save(df: DataFrame, seen: Observation | None = None, *counts) -> DataFrame:
    """Write a table and read it back: cuts lineage in iterations and survives lost executors; seen gets aggregates of what is written.

    Spark takes the compressed size of the files for the table's size and would broadcast millions of rows through the driver, so joins with a table of
    more than BROADCAST_ROWS rows, or with what is selected from it or grouped, are merge joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    size = Observation()
    (df if seen is None else df.observe(seen, *counts)).observe(size, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if size.get.get("rows", 0) > BROADCAST_ROWS else table
