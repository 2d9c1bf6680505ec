"""The opN_ queries and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import bpe, chat, packing, secrets
from .common import table
from .language import identify
from .near_dup import classes
from .quality_crf import score_quality
from .quality_rules import COUNTS, judge
from .topk import TOP_SQL, top_k
from .toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "evidence_ids")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(rows.unionByName(extra)))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op9_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "part", "bins", "bound")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("secret_base")), 256).alias("base_sha256"),
        secrets.joined(F.col("secret_spans")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_chat_format": op2_chat_format,
        "op3_language_fusion": op3_language_fusion,
        "op4_quality_crf": op4_quality_crf,
        "op5_bpe_automaton": op5_bpe_automaton,
        "op6_isolation_rules": op6_isolation_rules,
        "op7_order_minhash": op7_order_minhash,
        "op8_segment_topk": op8_segment_topk,
        "op9_bound_packing": op9_bound_packing,
        "op10_secret_scan": op10_secret_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.DIGEST_SQL,
        "op8_segment_topk": TOP_SQL,
    }
