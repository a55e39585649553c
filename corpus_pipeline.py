"""A corpus pipeline from raw documents to packed training windows.

Toxic documents go, then all but one of equal texts, then all but one of each group of near-duplicates (five-word shingles,
similarity 0.8), then secrets are masked, and what is left is packed into windows of 1024 tokens. Each stage works on all rows
that the one before kept; all but the last return the columns of documents.

The two stages that drop copies name rows by doc_id where it is unique. Where ids are missing or repeated (odd input), the rows get
numbers of their own first, so a text is never lost because another one bears the same id, and nameless and repeated rows are deduplicated like any
other. Empty texts equal each other: one stays. Very long texts pass whole. An empty table stays empty. Of columns whatever their names, none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from strandflow.llm.common import fresh, read, save, split_by_ids
from strandflow.llm.queries import vocabulary


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows that ids (doc_id) names, columns in order; only rows that may be among them are shuffled."""
    ids = save(ids.select("doc_id").distinct())
    inside, outside = split_by_ids(docs, ids)
    return inside.join(ids.hint("merge"), "doc_id", "left_anti").select(*docs.columns).unionByName(outside)


def dropped(docs: DataFrame, marked) -> DataFrame:
    """docs without the rows that marked(docs) doesn't keep."""
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return without(docs, marked(docs).where("not kept"))
    old = fresh(docs, "__doc_id")
    numbered = save(docs.withColumnRenamed("doc_id", old).withColumn("doc_id", F.monotonically_increasing_id()))
    kept = without(numbered, marked(numbered).where("not kept")).drop("doc_id").withColumnRenamed(old, "doc_id")
    return kept.select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dropped(docs, exact_dedup.exact_dedup)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dropped(docs, near_dedup.near_dedup)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
