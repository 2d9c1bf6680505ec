"""Deterministic views over the driver's tables, in Spark and as SQL text for the twin.

Times are integer milliseconds of call time and words are counted in twentieths, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EPOCH_US = 1_704_067_200_000_000
#: One millisecond of call time is so many microseconds of the event table.
US_PER_MS = 7_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, k (from props) and start_ms."""
    e = table(spark, sf_dir, "events")
    # a time without zone is read in the session's zone, and so is the epoch it is measured from
    zone = "timestamp_ntz" if dict(e.dtypes)["ts"] == "timestamp_ntz" else "timestamp_ltz"
    epoch = F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)") if zone == "timestamp_ntz" else F.expr("timestamp_seconds(1704067200)")
    us = F.unix_micros(e["ts"].cast("timestamp")) - F.unix_micros(epoch)
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor(us / US_PER_MS).alias("start_ms"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-leg calls: base, side, start_ms, end_ms, k (words in twentieths), segs, text, event_id.

    Spans of one leg never overlap.
    """
    e = events(spark, sf_dir).select(
        "event_id",
        F.floor(F.col("user_id") / 2).alias("base"),
        F.when(F.col("user_id") % 2 == 0, "Left").otherwise("Right").alias("side"),
        "start_ms",
        (50 + F.floor(F.round(F.col("value") * 100).cast("long") / 2)).alias("raw_ms"),
        "k",
    )
    after = F.lead("start_ms").over(Window.partitionBy("base", "side").orderBy("start_ms", "event_id"))
    e = e.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") - F.col("start_ms") > 100))
    n = F.col("event_id")
    words = F.concat(F.lit("w"), (n % 3).cast("string"), F.lit(" x w"), ((n + 1) % 3).cast("string"))
    return e.select(
        F.col("base").cast("string").alias("base"),
        "side",
        "start_ms",
        F.least(F.col("start_ms") + F.col("raw_ms"), F.coalesce(F.col("after") - 20, F.lit(1_000_000_000))).alias("end_ms"),
        "k",
        F.array(F.concat_ws(":", "side", F.floor(F.col("start_ms") / 6000))).alias("segs"),
        F.when(F.col("k") < 5, "").otherwise(words).alias("text"),
        "event_id",
    )


SPANS_SQL = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         (epoch_us(ts) - {EPOCH_US}) // {US_PER_MS} AS start_ms
  FROM events
), led AS (
  SELECT *, CAST(user_id // 2 AS VARCHAR) AS base, CASE WHEN user_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS side,
         50 + CAST(round(value * 100) AS BIGINT) // 2 AS raw_ms,
         lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS after
  FROM ev
), span AS (
  SELECT base, side, start_ms, least(start_ms + raw_ms, coalesce(after - 20, 1000000000)) AS end_ms, k,
         side || ':' || CAST(start_ms // 6000 AS VARCHAR) AS seg,
         CASE WHEN k < 5 THEN '' ELSE 'w' || (event_id % 3) || ' x w' || ((event_id + 1) % 3) END AS text, event_id
  FROM led WHERE after IS NULL OR after - start_ms > 100
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, i (frame number), p (probability): each user's events in order."""
    e = events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("start_ms", "event_id")
    return e.select(
        F.col("user_id").cast("string").alias("leg"),
        (F.row_number().over(order) - 1).cast("long").alias("i"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
    )


FRAMES_SQL = """
frame AS (
  SELECT CAST(user_id AS VARCHAR) AS leg, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS i,
         least(value / 100, 1.0) AS p
  FROM ev
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: base, side, utt, start_ms, end_ms, text; bounds lie 100 ms outside the speech."""
    s = spans(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("words"))
    n = docs.agg(F.count("*").alias("n"))
    grouped = s.groupBy("base", "side", F.col("segs")[0].alias("utt")).agg(
        (F.min("start_ms") - 100).alias("start_ms"), (F.max("end_ms") + 100).alias("end_ms"), F.min("event_id").alias("event_id")
    )
    keyed = grouped.join(F.broadcast(n)).withColumn("doc_id", F.col("event_id") % F.col("n"))
    return keyed.join(docs, "doc_id").select("base", "side", "utt", "start_ms", "end_ms", F.col("words").alias("text"))


SEGMENTS_SQL = """
seg0 AS (
  SELECT base, side, seg AS utt, min(start_ms) - 100 AS start_ms, max(end_ms) + 100 AS end_ms, min(event_id) AS event_id
  FROM span GROUP BY base, side, seg
), segment AS (
  SELECT base, side, utt, start_ms, end_ms, text
  FROM seg0 JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)
)"""


def with_tables(*parts: str) -> str:
    """A WITH clause of the given named parts."""
    return "WITH " + ",\n".join(p.strip() for p in parts)
