"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import collocations, exact_dedup, language_id, line_dedup, manifest, merkle, near_dedup, packing, secret_scan, sentence_piece, suffix_dedup, toxicity, vector_search
from strandflow.llm.common import read


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), words=3, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_report(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op8_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.sentence_piece(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_report(read(spark, sf_dir, "documents"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents")).drop("doc_id", "offset")


REGISTERED = [
    op1_near_dedup, op2_exact_dedup, op3_packing, op4_toxicity, op5_fingerprints, op6_secret_scan, op7_language_id, op8_sentence_piece, op9_suffix_dedup, op10_line_dedup,
    op11_dataset_manifest, op12_topk_search, op13_collocations,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    from strandflow.llm.oracles import ORACLES

    return dict(ORACLES)
