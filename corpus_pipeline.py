"""A corpus from raw documents to packed sequences: quality rules, near-duplicates, personal data, mix, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import op1_mix, op3_pii, op6_simhash, op8_packing, op10_quality
from rankloom.llm.common import documents
from rankloom.plans.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the quality rules keep. Null and empty texts fail them; repeated rows are judged alike."""
    return op10_quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id."""
    return op6_simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, with personal data replaced in their texts."""
    return op3_pii.sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs as often as the target weights of the sources take them."""
    return op1_mix.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of docs' texts in bins: one row per piece with its bin, its place there and its ids, from which
    op8_packing.sequences makes the sequences."""
    return op8_packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mix_sources", mixing),
    ("best_fit_packing", packing),
]
#: No SQL: tokeniser bands, fingerprints, disclosure and best fit can't be expressed; each stage has a brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's docs. What a
    stage does with nulls, repeated rows, ties and empty tables is stated at its operator; extra columns pass through."""
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
