"""Queries about replays, manifests, sweeps and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floorline import fixtures as fx
from floorline.operators import metrics as mt, replay as rp
from floorline.plans.evaluation import scores
from floorline.plans.timeline import SPURT_SQL
from floorline.registry import register
from floorline.sources import sinks

_CLOSES_SQL = """closes AS (SELECT base || side AS leg, end_ms + 96 AS t_ms FROM span WHERE k % 4 <> 0
), bounds AS (SELECT base || side AS leg, end_ms AS t_ms, k FROM span WHERE k % 3 = 0
), asked AS (SELECT b.*, (SELECT min(c.t_ms) FROM closes c WHERE c.leg = b.leg AND c.t_ms >= b.t_ms - 50) AS asked_ms FROM bounds b)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spans(spark, sf_dir).withColumn("leg", F.concat("base", "side"))
    closes = s.where("k % 4 <> 0").select("leg", (F.col("end_ms") + 96).alias("t_ms"))
    return rp.first_close(s.where("k % 3 = 0").select("leg", F.col("end_ms").alias("t_ms"), "k"), closes)


@register("replay_closes", fx.with_tables(fx.SPANS_SQL, _CLOSES_SQL) + " SELECT * FROM asked")
def replay_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("leg", "t_ms", "k", "asked_ms")


@register(
    "replay_coverage",
    fx.with_tables(fx.SPANS_SQL, _CLOSES_SQL)
    + " SELECT k % 2 AS label_rule, count(*) AS n, count(*) FILTER (asked_ms - t_ms <= 2000) AS asked, CAST(count(*) FILTER (asked_ms - t_ms <= 2000) AS DOUBLE) / count(*) AS share FROM asked GROUP BY 1",
)
def replay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).select((F.col("k") % 2).alias("label_rule"), F.when(F.col("asked_ms") - F.col("t_ms") <= 2000, F.col("asked_ms")).alias("at"))
    return rp.coverage(rows, "at", "label_rule")


@register(
    "replay_offsets",
    fx.with_tables(fx.SPANS_SQL, _CLOSES_SQL)
    + """ SELECT label_rule, n, v[n // 10 + 1] AS p10, v[n // 2 + 1] AS p50, v[least(9 * n // 10, n - 1) + 1] AS p90
    FROM (SELECT k % 2 AS label_rule, count(*) AS n, list_sort(list(asked_ms - t_ms)) AS v FROM asked WHERE asked_ms IS NOT NULL GROUP BY 1)""",
)
def replay_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).select((F.col("k") % 2).alias("label_rule"), (F.col("asked_ms") - F.col("t_ms")).alias("offset_ms"))
    return rp.spread(rows, "offset_ms", "label_rule")


@register(
    "paired_accuracy",
    """WITH s AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CAST(embedding[1] AS DOUBLE) AS live, CAST(embedding[2] AS DOUBLE) AS off FROM embeddings WHERE vec_id % 10 <> 0),
    c AS (SELECT count(*) AS n, count(*) FILTER (CAST(live > 0.0 AS INTEGER) = y) AS a, count(*) FILTER (CAST(off > 0.0 AS INTEGER) = y) AS b FROM s)
    SELECT n, CAST(a AS DOUBLE) / n AS live_acc, CAST(b AS DOUBLE) / n AS offline_acc, CAST(a - b AS DOUBLE) / n AS delta FROM c""",
)
def paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    part = lambda i: F.col("embedding")[i].cast("double")
    rows = e.select((F.col("label") >= 5).cast("int").alias("y"), F.when(F.col("vec_id") % 10 != 0, part(0)).alias("live"), part(1).alias("offline"))
    return rp.paired_accuracy(rows, "y", "live", "offline", 0.0)


@register(
    "manifest",
    fx.with_tables(fx.SPANS_SQL)
    + """ , d AS (SELECT base, max(CASE WHEN side = 'Left' THEN end_ms + 700 ELSE end_ms + 500 END) AS hi, count(DISTINCT side) AS legs,
      max(end_ms + 700) FILTER (side = 'Left') AS l, max(end_ms + 500) FILTER (side = 'Right') AS r FROM span GROUP BY base),
    m AS (SELECT base, count(*) FILTER (side = 'Left') AS left_segments, CAST(sum(end_ms - start_ms) FILTER (side = 'Left') AS BIGINT) AS left_ms,
      count(*) FILTER (side = 'Right') AS right_segments, CAST(sum(end_ms - start_ms) FILTER (side = 'Right') AS BIGINT) AS right_ms, max(end_ms) AS span_ms FROM span GROUP BY base)
    SELECT m.*, greatest(l, r) AS wav_ms, abs(l - r) AS mismatch_ms, CAST(least(left_ms, right_ms) AS DOUBLE) / greatest(left_ms, right_ms) AS balance FROM m JOIN d ON d.base = m.base WHERE legs = 2""",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spans(spark, sf_dir)
    wav = s.groupBy("base", "side").agg((F.max("end_ms") + F.when(F.col("side") == "Left", 700).otherwise(500)).alias("wav_ms"))
    return rp.manifest(s.select("base", "side", "start_ms", "end_ms"), wav)


@register(
    "best_by_key",
    """WITH b AS (SELECT label % 4 AS part, max(CAST(embedding[1] AS DOUBLE)) AS best FROM embeddings GROUP BY 1)
    SELECT part, best, best - lag(best) OVER (ORDER BY part) AS gain FROM b""",
)
def best_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("part"), F.col("embedding")[0].cast("double").alias("acc"))
    return mt.best_by(rows, "part", "acc")


@register(
    "job_progress",
    """SELECT lang AS model, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'running' END AS state, count(*) AS jobs, CAST(sum(doc_id % 10) AS BIGINT) AS ok, CAST(sum(doc_id % 3) AS BIGINT) AS failed,
    12 * count(*) AS total, 100.0::DOUBLE * CAST(sum(doc_id % 10) + sum(doc_id % 3) AS BIGINT) / CAST(12 * count(*) AS BIGINT) AS percent FROM documents GROUP BY 1, 2""",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    jobs = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("model"), F.when(i % 2 == 0, "done").otherwise("running").alias("state"), (i % 10).alias("ok"), (i % 3).alias("failed"), F.lit(12).cast("long").alias("total"))
    return sinks.job_progress(jobs)


@register("logistic_probe", None)
def logistic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether crude features give the label away."""
    e = fx.table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(10)])
    return rp.probe(rows, "y", [f"f{i}" for i in range(10)], F.col("vec_id") % 4 == 0)


@register(
    "not_yet_cached",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)",
)
def not_yet_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that neither of two caches holds with a usable verdict."""
    labels = fx.table(spark, sf_dir, "labels")
    cache = lambda c: labels.select(F.col("doc_id").alias("sid"), F.when(F.col(c) == 1, "complete").otherwise("error").alias("verdict"))
    done = sinks.usable_keys(cache("quality"), cache("toxic")).select(F.col("sid").alias("doc_id"))
    return sinks.not_yet(fx.table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@register(
    "threshold_classes",
    "SELECT vec_id, CAST(CAST(embedding[1] AS DOUBLE) * 0.5 + 0.5 > 0.5 AS INTEGER) AS pred FROM embeddings",
)
def threshold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("vec_id", (F.col("p") > 0.5).cast("int").alias("pred"))


@register("spurt_totals", fx.with_tables(fx.SPANS_SQL, SPURT_SQL) + " SELECT base, side, count(DISTINCT spurt) AS spurts, max(ahead_ms) AS longest_ms FROM sp GROUP BY 1, 2")
def spurt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floorline.operators.boundaries import spurts

    rows = spurts(fx.spans(spark, sf_dir))
    return rows.groupBy("base", "side").agg(F.count_distinct("spurt").alias("spurts"), F.max("ahead_ms").alias("longest_ms"))
