"""Training corpus from `documents`: rate, deduplicate, redact, mix, pack.

Each stage is written as Parquet and read again as the next one's input. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import mixing, near_copies, ordinal, packing, pii
from weftline.llm.common import table
from weftline.llm.queries import tokenizer_path
from weftline.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are probably of the highest grade; poor and toxic ones go."""
    return ordinal.select(docs, ordinal.graded(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every group of near copies: five-word shingles, similarity >= 0.8."""
    return near_copies.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by the names of their kinds."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until every source is near its target weight."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: one row per piece, with its place in its sequence."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The tokenizer, the trained models and SimHash have no SQL form; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage's rows lie in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
