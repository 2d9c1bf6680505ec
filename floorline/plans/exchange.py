"""Queries that read and write files, score signals, or replay streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from floorline import fixtures as fx
from floorline.operators import intervals, labels as lb
from floorline.plans.calls import LOG_SQL, log
from floorline.plans.timeline import HYSTERESIS_SQL
from floorline.registry import register
from floorline.sources import audio, files, sinks
from floorline.sources.scratch import scratch
from floorline.streaming import frames as st


@register("jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read with a declared schema."""
    path = scratch(spark, "jsonl")
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register(
    "kaldi_segments",
    """SELECT 'u' || doc_id AS utt, 'r' || (doc_id % 5) AS reco, CAST(doc_id AS DOUBLE) AS start, CAST(doc_id AS DOUBLE) + 1.5 AS "end",
    CASE WHEN doc_id % 4 = 0 THEN 'later ' || doc_id WHEN doc_id % 4 = 1 THEN 'first ' || doc_id ELSE '' END AS text FROM labels""",
)
def kaldi_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transcript files and two segment files: the later text and the first segment of an utterance win."""
    ids = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 4).alias("m"))
    text = lambda c: F.concat(F.lit("u"), F.col("doc_id").cast("string"), c)
    said = lambda w: F.concat(F.lit(f"\t{w} "), F.col("doc_id").cast("string"))
    paths = [scratch(spark, f"kaldi-{n}") for n in ("text0", "text1", "seg0", "seg1")]
    ids.where("m in (0, 1)").select(text(said("first"))).coalesce(1).write.text(paths[0])
    ids.where("m in (0, 2)").select(text(F.when(F.col("m") == 0, said("later")).otherwise(F.lit("")))).coalesce(1).write.text(paths[1])
    line = lambda add: text(F.format_string(f" r%d %.1f %.1f", F.col("doc_id") % 5, F.col("doc_id") + F.lit(0.0 + add), F.col("doc_id") + F.lit(1.5 + add)))  # noqa: E731, F541
    ids.select(line(0)).unionByName(ids.limit(3).select(F.lit("too few fields").alias(ids.select(line(0)).columns[0]))).coalesce(1).write.text(paths[2])
    ids.where("m = 3").select(line(9)).coalesce(1).write.text(paths[3])
    return files.read_segments(spark, paths[2:], files.read_text(spark, paths[:2]))


@register(
    "batch_output",
    """SELECT 'clip' || doc_id AS sid, CASE doc_id % 2 WHEN 0 THEN 'complete' ELSE 'incomplete' END AS verdict, CAST(0.5 AS DOUBLE) AS confidence, 'why' AS reason,
    doc_id % 100 AS audio_tokens, CAST(7 AS BIGINT) AS text_tokens, doc_id % 3 + 1 AS output_tokens FROM labels""",
)
def batch_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested replies of a batch service, as text lines."""
    i = F.col("doc_id")
    reply = F.format_string('{"verdict": "%s", "confidence": 0.5, "reason": "why"}', F.when(i % 2 == 0, "complete").otherwise("incomplete"))
    parts = F.array(F.struct(F.lit("prompt").alias("text"), F.lit(None).cast("struct<fileUri:string>").alias("fileData")), F.struct(F.lit(None).cast("string").alias("text"), F.struct(F.format_string("gs://b/x/clip%d.wav", i).alias("fileUri")).alias("fileData")))
    usage = F.struct(F.array(F.struct(F.lit("AUDIO").alias("modality"), (i % 100).alias("tokenCount")), F.struct(F.lit("TEXT").alias("modality"), F.lit(7).alias("tokenCount"))).alias("promptTokensDetails"), (i % 3).alias("candidatesTokenCount"), F.lit(1).alias("thoughtsTokenCount"))
    said = F.struct(F.array(F.struct(F.struct(F.array(F.struct(reply.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), usage.alias("usageMetadata"))
    body = F.struct(F.struct(F.array(F.struct(parts.alias("parts"))).alias("contents")).alias("request"), said.alias("response"))
    out = lb.batch_replies(fx.table(spark, sf_dir, "labels").select(F.to_json(body).alias("value")))
    return out


@register(
    "refresh_text",
    """WITH f AS (SELECT doc_id, lang || '!' AS fresh FROM documents WHERE doc_id % 3 <> 0) SELECT count(*) AS rows, count(*) FILTER (fresh IS NULL) AS missing,
    count(*) FILTER (fresh <> CASE WHEN d.doc_id % 2 = 0 THEN lang ELSE lang || '!' END) AS changed FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
)
def refresh_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("!"))).alias("text"))
    fresh = fx.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.concat("lang", F.lit("!")).alias("text"))
    return sinks.refresh(d, fresh, "doc_id", "text")[1]


@register("shard_rollover", None)
def shard_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language rolled into shards of at most 200 kB."""
    rows = fx.table(spark, sf_dir, "documents")
    found = sinks.shards(rows, "lang", "doc_id", F.octet_length("text"), 200_000)
    return found.withColumn("name", sinks.shard_name(F.col("lang"), F.col("shard"), F.col("n_shards")))


@register(
    "shards_by_sum",
    """WITH s AS (SELECT lang, doc_id, coalesce(strlen(text), 0) AS n FROM documents), c AS (SELECT lang, doc_id,
    coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(n) OVER (PARTITION BY lang) AS total FROM s),
    k AS (SELECT lang, doc_id, upto, CAST(greatest(1, ceil(total / 200000.0)) AS INTEGER) AS n_shards FROM c)
    SELECT lang, doc_id, CAST(least(floor(upto / 200000.0), n_shards - 1) AS INTEGER) AS shard, n_shards FROM k""",
)
def shards_by_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language dealt into shards of about 200 kB by running sums over ranges."""
    rows = fx.table(spark, sf_dir, "documents")
    return sinks.shards_by_sum(rows, "lang", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), 200_000)


@register(
    "request_lines",
    """SELECT '{"request":{"contents":[{"role":"user","parts":[{"text":"Is it complete?"},{"fileData":{"fileUri":"clips/' || doc_id || '.wav","mimeType":"audio/wav"}}]}]}}' AS value FROM labels""",
)
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.requests(fx.table(spark, sf_dir, "labels"), "Is it complete?", F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".wav")))


@register(
    "acoustic_features",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    z AS (SELECT *, list_transform(range(1, len(v)), lambda i: CASE WHEN sign(v[i]) <> sign(v[i + 1]) THEN 1 ELSE 0 END) AS turns FROM x)
    SELECT vec_id, len(v) / 64.0::DOUBLE AS dur, round(sqrt(list_inner_product(v, v) / len(v)), 6) AS rms_all, round(sqrt(list_inner_product(v[-8:], v[-8:]) / 8), 6) AS rms_last_short,
    round(sqrt(list_inner_product(v[-16:], v[-16:]) / 16), 6) AS rms_last_long, round(sqrt(list_inner_product(v[-24:-9], v[-24:-9]) / 16), 6) AS rms_before,
    list_max(list_transform(v, lambda y: abs(y))) AS peak, CAST(list_sum(turns) AS DOUBLE) / (len(v) - 1) AS zcr FROM z""",
)
def acoustic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-domain features of vectors taken as sound."""
    found = audio.time_features(F.col("embedding"), 8, 16, 64)
    rounded = [F.round(c, 6).alias(n) if n.startswith("rms") else c.alias(n) for n, c in found.items()]
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", *rounded)


@register("spectral_features", None)
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", audio.spectral(F.col("embedding")).alias("s"))
    return rows.select("vec_id", "s.*")


def _mean_model():
    """A stand-in for a trained model: the logistic of the mean component."""
    return lambda x: 1 / (1 + np.exp(-x.astype(np.float64).mean(axis=1)))


@register("model_score", None)
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.score(fx.table(spark, sf_dir, "embeddings"), _mean_model, "embedding", "vec_id")


@register("stream_hysteresis", fx.with_tables(fx.SPANS_SQL, fx.FRAMES_SQL, HYSTERESIS_SQL) + " SELECT * FROM hyst")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online decoder over a replayed file source: the spans of the batch decoder."""
    source, out, checkpoint = scratch(spark, "frames"), scratch(spark, "spans"), scratch(spark, "checkpoint")
    rows = fx.frames(spark, sf_dir)
    last = F.lead("i").over(Window.partitionBy("leg").orderBy("i")).isNull()
    rows.withColumn("last", last).write.json(source)
    st.replay(st.decode_stream(spark.readStream.schema(st.FRAMES).json(source)), out, checkpoint)
    return spark.read.schema("leg string, start_ms long, end_ms long").parquet(out)


@register(
    "stream_arrivals",
    fx.with_tables(fx.SPANS_SQL, LOG_SQL)
    + """ , w AS (SELECT call, kind, t_ms // 20000 * 20000 AS from_ms FROM log)
    SELECT call, kind, from_ms, count(*) AS n FROM w WHERE from_ms + 20000 <= (SELECT max(t_ms) FROM log) - 30000 GROUP BY 1, 2, 3""",
)
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per call, kind and twenty seconds of a streamed log, of the windows that the watermark has closed."""
    source, out, checkpoint = scratch(spark, "log"), scratch(spark, "arrivals"), scratch(spark, "checkpoint")
    log(spark, sf_dir).where("kind not in ('meta', 'end')").write.json(source)
    st.replay(st.arrivals(st.read_log_stream(spark, source)), out, checkpoint)
    return spark.read.schema("call string, kind string, from_ms long, n long").parquet(out)


@register("stream_finals", fx.with_tables(fx.SPANS_SQL, LOG_SQL) + " SELECT call, t_ms, text FROM log WHERE kind = 'transcript' AND source = 'item' AND role = 'user'")
def stream_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed user turns of a streamed log."""
    source, out, checkpoint = scratch(spark, "log"), scratch(spark, "finals"), scratch(spark, "checkpoint")
    log(spark, sf_dir).write.json(source)
    rows = st.read_log_stream(spark, source).where("kind = 'transcript' and source = 'item' and role = 'user'").select("call", "t_ms", "text")
    st.replay(rows, out, checkpoint)
    return spark.read.schema("call string, t_ms long, text string").parquet(out)


@register("batch_decoder", fx.with_tables(fx.SPANS_SQL, fx.FRAMES_SQL, HYSTERESIS_SQL) + " SELECT leg, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms FROM hyst GROUP BY leg")
def batch_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals.hysteresis(fx.frames(spark, sf_dir))
    return spans.groupBy("leg").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
