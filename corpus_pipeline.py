"""Corpus pipeline: each stage takes the documents its predecessor kept, written as Parquet and read again.

Stages: drop documents scored toxic; drop documents scored of bad quality; keep one document of each
near-duplicate class; blank out secrets; pack what is left into sequences. All but the last return the columns
of documents, in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from floorline.llm import packing, secrets
from floorline.llm.common import fresh, stored, table
from floorline.llm.near_dup import keep_first
from floorline.llm.quality_crf import keep_good
from floorline.llm.toxicity import keep_clean

#: No SQL expresses the models, the sketches or the packing; tests compare with plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that of its smallest doc_id; rows without a text or an id stay."""
    return keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a placeholder; n_chars follows the text where it changed."""
    before = fresh(docs, "before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences."""
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
