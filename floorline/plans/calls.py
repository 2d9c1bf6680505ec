"""Queries over a call log that is derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floorline import fixtures as fx
from floorline.operators import calllog as cl
from floorline.registry import register
from floorline.sources.scratch import stored

_T0 = 1_000_000

LOG_SQL = f"""
log AS (
  SELECT CAST(user_id AS VARCHAR) AS call,
    CASE event_type WHEN 'click' THEN 'transcript' WHEN 'view' THEN 'metric' WHEN 'purchase' THEN 'prediction' WHEN 'signup' THEN 'session'
      ELSE CASE WHEN k < 50 THEN 'error' WHEN k < 80 THEN 'interruption' ELSE 'overlap' END END AS kind,
    start_ms AS t_ms, event_id AS seq, k, value, event_type,
    CASE event_type WHEN 'click' THEN CASE WHEN k < 85 THEN 'user' ELSE 'assistant' END WHEN 'view' THEN 'assistant' END AS role,
    CASE event_type WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'stt' ELSE 'item' END END AS source,
    CASE event_type WHEN 'click' THEN 'a|b ' || k END AS text,
    CASE event_type WHEN 'purchase' THEN k / 100.0::DOUBLE WHEN 'signup' THEN CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END END AS probability,
    CASE event_type WHEN 'purchase' THEN 4000 + k * 80 END AS audio_ms,
    CASE event_type WHEN 'signup' THEN CASE WHEN k < 50 THEN 300 ELSE 2500 END END AS endpointing_ms,
    CASE event_type WHEN 'signup' THEN CASE WHEN k % 3 <> 0 THEN 't' || (k % 3) END END AS trigger,
    CASE event_type WHEN 'signup' THEN k % 2 = 0 END AS from_cache,
    CASE event_type WHEN 'view' THEN k * 11 END AS end_of_turn_ms, CASE event_type WHEN 'view' THEN k * 2 END AS transcription_ms,
    CASE event_type WHEN 'view' THEN CASE WHEN k % 4 <> 0 THEN k * 7 END END AS ttft_ms, CASE event_type WHEN 'view' THEN k * 13 END AS e2e_ms,
    CASE event_type WHEN 'view' THEN {_T0} + start_ms END AS started_at_ms, k % 2 = 0 AS flag
  FROM ev
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows of one call per user, with a meta row, and an end row on every second call."""
    e, k, t = fx.events(spark, sf_dir), F.col("k"), F.col("event_type")
    is_ = lambda name, x: F.when(t == name, x)
    kind = (
        F.when(t == "click", "transcript").when(t == "view", "metric").when(t == "purchase", "prediction").when(t == "signup", "session")
        .when(k < 50, "error").when(k < 80, "interruption").otherwise("overlap")
    )
    flag = k % 2 == 0
    given = {
        "call": F.col("user_id").cast("string"),
        "kind": kind,
        "t_ms": F.col("start_ms"),
        "seq": F.col("event_id"),
        "role": is_("click", F.when(k < 85, "user").otherwise("assistant")).when(t == "view", "assistant"),
        "source": is_("click", F.when(k % 10 == 0, "stt").otherwise("item")),
        "text": is_("click", F.concat(F.lit("a|b "), k.cast("string"))),
        "probability": is_("purchase", k / F.lit(100.0)).when((t == "signup") & (k % 5 != 0), k / F.lit(100.0)),
        "threshold": is_("purchase", F.lit(0.5)),
        "audio_ms": is_("purchase", 4000 + k * 80),
        "endpointing_ms": is_("signup", F.when(k < 50, 300).otherwise(2500)),
        "trigger": F.when((t == "signup") & (k % 3 != 0), F.concat(F.lit("t"), (k % 3).cast("string"))),
        "from_cache": is_("signup", flag),
        "end_of_turn_ms": is_("view", k * 11),
        "transcription_ms": is_("view", k * 2),
        "ttft_ms": F.when((t == "view") & (k % 4 != 0), k * 7),
        "e2e_ms": is_("view", k * 13),
        "started_at_ms": is_("view", F.col("start_ms") + _T0),
        "resumed": F.when(kind == "interruption", flag),
        "is_interruption": F.when(kind == "overlap", flag),
        "error": F.when(kind == "error", "timeout"),
    }
    columns = [c.strip().split(" ") for c in cl.SCHEMA.split(",")]
    shaped = lambda df, values: df.select(*[(values.get(n, F.lit(None)) if not isinstance(values.get(n), str) else F.lit(values[n])).cast(ty).alias(n) for n, ty in columns])
    users = e.groupBy("user_id").agg(F.max("start_ms").alias("last"))
    u = F.col("user_id")
    meta = {"call": u.cast("string"), "kind": "meta", "t_ms": F.lit(0), "seq": F.lit(-1), "t0_ms": F.lit(_T0), "min_delay_ms": F.lit(300), "max_delay_ms": F.lit(2500), "arm": F.when(u % 3 == 0, "baseline").when(u % 3 == 1, "detector")}
    end = {"call": u.cast("string"), "kind": "end", "t_ms": F.col("last") + 1000, "seq": F.lit(1 << 60)}
    return shaped(e, given).unionByName(shaped(users, meta)).unionByName(shaped(users.where(u % 2 == 0), end))


_L = (fx.SPANS_SQL, LOG_SQL)
_USERS = "log WHERE kind = 'transcript' AND role = 'user' AND source = 'item'"
_STARTS = f"(SELECT call, started_at_ms - {_T0} AS t_ms FROM log WHERE kind = 'metric')"


@register(
    "call_arms",
    fx.with_tables(*_L)
    + """ SELECT call, CASE CAST(call AS BIGINT) % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'detector' ELSE CASE WHEN count(*) FILTER (kind = 'prediction') > 0 THEN 'detector' ELSE 'baseline' END END AS arm,
    CASE WHEN CAST(call AS BIGINT) % 2 = 0 THEN max(t_ms) + 1000 ELSE coalesce(max(t_ms) FILTER (kind IN ('prediction', 'session', 'transcript', 'metric')), 0) END AS duration_ms FROM log GROUP BY call""",
)
def call_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.calls(log(spark, sf_dir))


_WAITS = f"""w0 AS (SELECT u.call, u.t_ms, (SELECT min(a.t_ms) FROM {_STARTS} a WHERE a.call = u.call AND a.t_ms >= u.t_ms - 500) - u.t_ms AS wait_ms FROM (SELECT * FROM {_USERS}) u)"""
_DEAD_AIR = f"""air AS (SELECT c.call, (SELECT count(*) FROM {_USERS} AND call = c.call) AS committed, (SELECT count(*) FROM {_STARTS} a WHERE a.call = c.call) AS replies,
    (SELECT count(wait_ms) FROM w0 WHERE w0.call = c.call) AS answered, (SELECT max(wait_ms) FROM w0 WHERE w0.call = c.call) AS longest_ms,
    (SELECT count(*) FROM w0 WHERE w0.call = c.call AND wait_ms > 10000) AS long_waits, (SELECT count(*) FROM log l WHERE l.call = c.call AND kind = 'error') AS errors
    FROM (SELECT DISTINCT call FROM log) c)"""


@register("dead_air", fx.with_tables(*_L, _WAITS, _DEAD_AIR) + " SELECT * FROM air")
def dead_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.dead_air(log(spark, sf_dir))


_FRAGMENTS = f"""fe AS (SELECT call, t_ms, 1 AS u FROM {_USERS} UNION ALL SELECT call, t_ms, 0 FROM {_STARTS} a
    ), fs AS (SELECT *, sum(1 - u) OVER (PARTITION BY call ORDER BY t_ms, u ROWS UNBOUNDED PRECEDING) AS s FROM fe
    ), frag AS (SELECT call, count(*) AS turns, count(DISTINCT s) AS blocks, CAST(count(*) AS DOUBLE) / count(DISTINCT s) AS per_block FROM fs WHERE u = 1 GROUP BY call)"""


@register("fragmentation", fx.with_tables(*_L, _FRAGMENTS) + " SELECT * FROM frag")
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.fragmentation(log(spark, sf_dir))


def _latency_sql(by: str) -> str:
    stages = {"endpointing": "end_of_turn_ms", "transcription": "transcription_ms", "first_token": "ttft_ms", "total": "e2e_ms"}
    union = " UNION ALL ".join(f"SELECT {by} '{s}' AS stage, {c} AS ms FROM log WHERE kind = 'metric' AND {c} IS NOT NULL" for s, c in stages.items())
    rank = lambda p: f"v[least(CAST(round_even({p} * (n - 1), 0) AS BIGINT), n - 1) + 1]"
    return f"SELECT {by} stage, n, {rank(0.5)} AS p50_ms, {rank(0.95)} AS p95_ms FROM (SELECT {by} stage, list_sort(list(ms)) AS v, count(*) AS n FROM ({union}) GROUP BY {by} stage)"


@register("latency_quantiles", fx.with_tables(*_L) + " " + _latency_sql(""))
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.latency(log(spark, sf_dir))


@register(
    "interruptions",
    fx.with_tables(*_L)
    + """ SELECT call, count(*) FILTER (kind = 'interruption') AS false_replies, count(*) FILTER (kind = 'interruption' AND flag) AS recovered,
    count(*) FILTER (kind = 'overlap') AS overlaps, count(*) FILTER (kind = 'overlap' AND flag) AS cut_offs,
    CASE WHEN count(*) FILTER (kind = 'transcript' AND role = 'user' AND source = 'item') > 0 THEN count(*) FILTER (kind = 'transcript' AND role = 'user' AND source = 'item') ELSE count(*) FILTER (kind = 'session') END AS turns,
    CASE WHEN count(*) FILTER (kind = 'interruption') > 0 THEN CAST(count(*) FILTER (kind = 'interruption' AND flag) AS DOUBLE) / count(*) FILTER (kind = 'interruption') ELSE 0.0 END AS recovered_share
    FROM log GROUP BY call""",
)
def interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.interruptions(log(spark, sf_dir))


@register(
    "short_buffers",
    fx.with_tables(*_L)
    + """ SELECT CASE WHEN audio_ms >= 7900 THEN 'full' ELSE 'padded' END AS "window", count(*) AS n, count(*) FILTER (probability > 0.5) AS complete,
    CAST(count(*) FILTER (probability > 0.5) AS DOUBLE) / count(*) AS share, round(median(probability), 9) AS median_p FROM log WHERE kind = 'prediction' GROUP BY 1""",
)
def short_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.short_buffers(log(spark, sf_dir)).withColumn("median_p", F.round("median_p", 9))


@register(
    "session_summary",
    fx.with_tables(*_L)
    + """ SELECT call, count(*) AS sessions, count(endpointing_ms) AS delays, count(*) FILTER (endpointing_ms >= 2500) AS held, count(*) FILTER (endpointing_ms < 2500) AS fast,
    count(*) FILTER (probability IS NULL) AS blind, count(*) FILTER (from_cache) AS cached FROM log WHERE kind = 'session' GROUP BY call""",
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.session_summary(log(spark, sf_dir))


@register("session_triggers", fx.with_tables(*_L) + " SELECT coalesce(trigger, 'None') AS trigger, count(*) AS n FROM log WHERE kind = 'session' GROUP BY 1")
def session_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.triggers(log(spark, sf_dir))


@register(
    "counterfactual",
    fx.with_tables(*_L)
    + """ SELECT call, CAST(sum(endpointing_ms) AS BIGINT) AS ours_ms, CAST(sum(2500 - endpointing_ms) AS BIGINT) AS safe_adds_ms, 300 * count(*) AS fast_ms,
    count(*) FILTER (endpointing_ms >= 2500) AS cut FROM log WHERE kind = 'session' GROUP BY call""",
)
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.counterfactual(log(spark, sf_dir))


@register(
    "probability_bands",
    fx.with_tables(*_L) + " SELECT CAST(least(k // 20, 4) AS INTEGER) AS band, count(*) AS n FROM log WHERE kind = 'prediction' GROUP BY 1",
)
def probability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.probability_bands(log(spark, sf_dir))


@register(
    "transcript_rows",
    fx.with_tables(*_L)
    + """ SELECT call, CAST(place AS INTEGER) AS place, t_ms, role, 'a/b ' || k AS text,
    CASE WHEN role = 'user' THEN (SELECT arg_max(p.probability, p.t_ms * 10000000 + p.seq) FROM log p WHERE p.kind = 'prediction' AND p.call = r.call AND p.t_ms <= r.t_ms) END AS probability
    FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY t_ms, seq) AS place FROM log WHERE kind = 'transcript') r WHERE place <= 40""",
)
def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.transcript(log(spark, sf_dir))


_COMPARE = f"""lat AS ({_latency_sql('call,')}
), cmp AS (
  SELECT c.call, CASE CAST(c.call AS BIGINT) % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'detector' ELSE CASE WHEN count(*) FILTER (kind = 'prediction') > 0 THEN 'detector' ELSE 'baseline' END END AS arm,
    CASE WHEN CAST(c.call AS BIGINT) % 2 = 0 THEN max(t_ms) + 1000 ELSE coalesce(max(t_ms) FILTER (kind IN ('prediction', 'session', 'transcript', 'metric')), 0) END AS duration_ms,
    (SELECT blocks FROM frag WHERE frag.call = c.call) AS blocks, (SELECT per_block FROM frag WHERE frag.call = c.call) AS per_block,
    (SELECT committed FROM air WHERE air.call = c.call) AS committed, (SELECT replies FROM air WHERE air.call = c.call) AS replies, (SELECT longest_ms FROM air WHERE air.call = c.call) AS longest_ms,
    (SELECT p50_ms FROM lat WHERE lat.call = c.call AND stage = 'endpointing') AS endpointing_p50, (SELECT p50_ms FROM lat WHERE lat.call = c.call AND stage = 'first_token') AS first_token_p50,
    (SELECT p50_ms FROM lat WHERE lat.call = c.call AND stage = 'total') AS total_p50, (SELECT p50_ms FROM lat WHERE lat.call = c.call AND stage = 'transcription') AS transcription_p50,
    count(*) FILTER (kind = 'interruption') AS false_replies
  FROM log c GROUP BY c.call
)"""


@register("arm_compare", fx.with_tables(*_L, _WAITS, _DEAD_AIR, _FRAGMENTS, _COMPARE) + " SELECT * FROM cmp")
def arm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.compare(log(spark, sf_dir))


@register(
    "arm_warnings",
    fx.with_tables(*_L, _WAITS, _DEAD_AIR, _FRAGMENTS, _COMPARE)
    + """ SELECT 'model_speed' AS warning, coalesce(max(first_token_p50) > 2 * min(first_token_p50), false) AS raised FROM cmp
    UNION ALL SELECT 'conversation_length', max(committed) > 1.5 * greatest(1, min(committed)) FROM cmp
    UNION ALL SELECT 'commit_path', count(*) FILTER (transcription_p50 > 100) > 0 AND count(*) FILTER (transcription_p50 > 100) < count(transcription_p50) FROM cmp
    UNION ALL SELECT 'unanswered', coalesce(max(longest_ms) > 10000, false) FROM cmp""",
)
def arm_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.warnings(cl.compare(stored(log(spark, sf_dir), "warning-log")))


@register(
    "run_lengths",
    """WITH r0 AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) THEN 0 ELSE 1 END AS opens FROM conversations),
    r1 AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn, role) AS run FROM r0), r2 AS (SELECT conv_id, run, role, count(*) AS n FROM r1 GROUP BY 1, 2, 3)
    SELECT role, count(*) AS runs, CAST(sum(n) AS BIGINT) AS turns, max(n) AS longest FROM r2 GROUP BY role""",
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of messages of one role."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    opens = F.coalesce(F.col("role") != F.lag("role").over(order), F.lit(True)).cast("long")
    rows = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"))
    return runs.groupBy("role").agg(F.count("*").alias("runs"), F.sum("n").alias("turns"), F.max("n").alias("longest"))
