"""Analysis of live-call event logs: one wide row per event, told apart by `kind`.

Times are milliseconds; t_ms runs from the start of the log, speech starts may be on the wall clock and are
rebased by the log's t0. Everything is per call, so a log of any number of calls is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import band, ratio
from floorline.operators import ranking
from floorline.operators.asof import asof

#: Columns of a log row and their types; what a kind lacks is null.
SCHEMA = (
    "call string, kind string, t_ms long, seq long, role string, source string, text string, arm string, t0_ms long, min_delay_ms long, max_delay_ms long, "
    "probability double, threshold double, complete boolean, audio_ms long, inference_ms long, endpointing_ms long, trigger string, from_cache boolean, "
    "end_of_turn_ms long, transcription_ms long, ttft_ms long, ttfb_ms long, e2e_ms long, started_at_ms long, resumed boolean, is_interruption boolean, error string"
)
STAGES = {"endpointing": "end_of_turn_ms", "transcription": "transcription_ms", "first_token": "ttft_ms", "first_byte": "ttfb_ms", "total": "e2e_ms"}
EARLY_MS, LONG_WAIT_MS, FULL_WINDOW_MS = 500, 10_000, 7_900
BANDS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def of(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("kind") == kind)


def user_turns(log: DataFrame) -> DataFrame:
    """Committed user turns; the same turn's transcription row is not one."""
    return log.where("kind = 'transcript' and role = 'user' and source = 'item'")


def agent_starts(log: DataFrame) -> DataFrame:
    """call, t_ms of every time the agent began to speak, on the log's clock."""
    t0 = of(log, "meta").groupBy("call").agg(F.max("t0_ms").alias("t0"))
    starts = log.where("kind = 'metric' and role = 'assistant' and started_at_ms is not null").select("call", "started_at_ms")
    return starts.join(t0, "call", "left").select("call", (F.col("started_at_ms") - F.coalesce("t0", F.lit(0))).alias("t_ms"))


def calls(log: DataFrame) -> DataFrame:
    """call, arm, duration_ms: the arm named by the log, else detector where it predicted, else baseline."""
    timed = F.col("kind").isin("prediction", "session", "transcript", "metric")
    out = log.groupBy("call").agg(
        F.max(F.when(F.col("kind") == "meta", F.col("arm"))).alias("named"),
        F.count_if(F.col("kind") == "prediction").alias("predictions"),
        F.max(F.when(F.col("kind") == "end", F.col("t_ms"))).alias("end"),
        F.max(F.when(timed, F.col("t_ms"))).alias("last"),
    )
    named = F.when(F.col("named") != "", F.col("named"))
    arm = F.coalesce(named, F.when(F.col("predictions") > 0, "detector").otherwise("baseline"))
    return out.select("call", arm.alias("arm"), F.coalesce(F.when(F.col("end") != 0, F.col("end")), "last", F.lit(0)).alias("duration_ms"))


def waits(log: DataFrame) -> DataFrame:
    """call, t_ms, wait_ms: from each user turn to the first agent start from half a second before it on; unanswered turns drop out."""
    users = user_turns(log).select("call", "t_ms", (F.col("t_ms") - EARLY_MS).alias("from_ms"))
    starts = agent_starts(log).withColumn("start", F.struct("t_ms"))
    found = asof(users, starts, ["call"], "from_ms", "t_ms", "start", forward=True)
    return found.where("start is not null").select("call", "t_ms", (F.col("start.t_ms") - F.col("t_ms")).alias("wait_ms"))


def dead_air(log: DataFrame) -> DataFrame:
    """Per call: turns committed, agent starts, waits, the longest, those over ten seconds, errors."""
    n = lambda rows, name: rows.groupBy("call").agg(F.count("*").alias(name))
    w = waits(log).groupBy("call").agg(F.count("*").alias("answered"), F.max("wait_ms").alias("longest_ms"), F.count_if(F.col("wait_ms") > LONG_WAIT_MS).alias("long_waits"))
    out = log.select("call").distinct()
    for part in (n(user_turns(log), "committed"), n(agent_starts(log), "replies"), w, n(of(log, "error"), "errors")):
        out = out.join(part, "call", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("call", zero("committed"), zero("replies"), zero("answered"), "longest_ms", zero("long_waits"), zero("errors"))


def fragmentation(log: DataFrame) -> DataFrame:
    """Per call: user turns, stretches of them without an agent start between, and turns a stretch. At equal times the agent comes first."""
    ev = user_turns(log).select("call", "t_ms", F.lit(1).alias("user")).unionByName(agent_starts(log).select("call", "t_ms", F.lit(0).alias("user")))
    order = Window.partitionBy("call").orderBy("t_ms", "user").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretch = F.sum(1 - F.col("user")).over(order)
    blocks = ev.withColumn("stretch", stretch).where("user = 1").groupBy("call", "stretch").agg(F.count("*").alias("n"))
    out = blocks.groupBy("call").agg(F.sum("n").alias("turns"), F.count("*").alias("blocks"))
    return out.withColumn("per_block", ratio(F.col("turns"), F.col("blocks")))


def latency(log: DataFrame, *by: str) -> DataFrame:
    """Per group and stage: n and the nearest-rank median and 95th percentile; nulls are not counted."""
    rows = of(log, "metric").select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(c).alias("ms")) for k, c in STAGES.items()])).alias("s"))
    rows = rows.select(*by, "s.stage", "s.ms")
    return ranking.at_ranks(rows, [*by, "stage"], "ms", {"p50_ms": ranking.rank_nearest(50), "p95_ms": ranking.rank_nearest(95)})


def interruptions(log: DataFrame) -> DataFrame:
    """Per call: replies over an unfinished user, how many recovered, overlaps, user cut-offs, and turns (else sessions)."""
    k = F.col("kind")
    out = log.groupBy("call").agg(
        F.count_if(k == "interruption").alias("false_replies"),
        F.count_if((k == "interruption") & F.coalesce("resumed", F.lit(False))).alias("recovered"),
        F.count_if(k == "overlap").alias("overlaps"),
        F.count_if((k == "overlap") & F.coalesce("is_interruption", F.lit(False))).alias("cut_offs"),
        F.count_if((k == "transcript") & (F.col("role") == "user") & (F.col("source") == "item")).alias("u"),
        F.count_if(k == "session").alias("s"),
    )
    turns = F.when(F.col("u") > 0, F.col("u")).otherwise(F.col("s"))
    return out.select("call", "false_replies", "recovered", "overlaps", "cut_offs", turns.alias("turns"), ratio(F.col("recovered"), F.col("false_replies")).alias("recovered_share"))


def short_buffers(log: DataFrame) -> DataFrame:
    """Full against padded windows: predictions, share said complete, median probability (mean of the middle two)."""
    rows = of(log, "prediction").withColumn("window", F.when(F.coalesce("audio_ms", F.lit(8000)) >= FULL_WINDOW_MS, "full").otherwise("padded"))
    said = rows.groupBy("window").agg(F.count("*").alias("n"), F.count_if(F.col("probability") > F.col("threshold")).alias("complete"))
    said = said.withColumn("share", ratio(F.col("complete"), F.col("n")))
    return said.join(ranking.linear(rows, ["window"], "probability", 0.5, "median_p").drop("n"), "window")


def session_summary(log: DataFrame) -> DataFrame:
    """Per call: decisions with a delay, floors held, fast replies, decisions without prediction, from cache, and per trigger."""
    meta = of(log, "meta").groupBy("call").agg(F.max("max_delay_ms").alias("top"))
    rows = of(log, "session").drop("max_delay_ms").join(meta, "call", "left")
    d = F.col("endpointing_ms")
    held = F.coalesce(d >= F.col("top"), F.lit(False))
    return rows.groupBy("call").agg(
        F.count("*").alias("sessions"),
        F.count(d).alias("delays"),
        F.count_if(held).alias("held"),
        F.count_if(d.isNotNull() & ~held).alias("fast"),
        F.count_if(F.col("probability").isNull()).alias("blind"),
        F.count_if(F.coalesce("from_cache", F.lit(False))).alias("cached"),
    )


def triggers(log: DataFrame) -> DataFrame:
    return of(log, "session").groupBy(F.coalesce("trigger", F.lit("None")).alias("trigger")).agg(F.count("*").alias("n"))


def counterfactual(log: DataFrame) -> DataFrame:
    """Per call: waiting as it was, what a fixed long delay adds, what a fixed short one waits, and turns that one would cut."""
    meta = of(log, "meta").groupBy("call").agg(F.max("min_delay_ms").alias("low"), F.max("max_delay_ms").alias("high")).where("high > low")
    rows = of(log, "session").where("endpointing_ms is not null").select("call", "endpointing_ms").join(meta, "call")
    return rows.groupBy("call").agg(
        F.sum("endpointing_ms").alias("ours_ms"),
        (F.sum("high") - F.sum("endpointing_ms")).alias("safe_adds_ms"),
        F.sum("low").alias("fast_ms"),
        F.count_if(F.col("endpointing_ms") >= F.col("high")).alias("cut"),
    )


def probability_bands(log: DataFrame) -> DataFrame:
    return of(log, "prediction").select(band(F.col("probability"), BANDS).alias("band")).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))


def transcript(log: DataFrame, most: int = 40, width: int = 90) -> DataFrame:
    """The first rows of each call's transcript, the user's with the latest prediction made by then; bars and long texts are cut."""
    guess = of(log, "prediction").select("call", "t_ms", F.struct("seq", "probability").alias("prediction"))
    rows = of(log, "transcript").select("call", "t_ms", "seq", "role", "text")
    said = asof(rows, guess, ["call"], "t_ms", "t_ms", "prediction")
    place = F.row_number().over(Window.partitionBy("call").orderBy("t_ms", "seq"))
    clean = F.substring(F.trim(F.translate(F.coalesce("text", F.lit("")), "|", "/")), 1, width)
    return said.withColumn("place", place).where(F.col("place") <= most).select("call", "place", "t_ms", "role", clean.alias("text"), F.when(F.col("role") == "user", F.col("prediction.probability")).alias("probability"))


def compare(log: DataFrame) -> DataFrame:
    """One row per call with what an arm comparison shows."""
    p50 = latency(log, "call").groupBy("call").pivot("stage", ["endpointing", "first_token", "total", "transcription"]).agg(F.max("p50_ms"))
    parts = [
        fragmentation(log).select("call", "blocks", "per_block"),
        dead_air(log).select("call", "committed", "replies", "longest_ms"),
        p50.select("call", F.col("endpointing").alias("endpointing_p50"), F.col("first_token").alias("first_token_p50"), F.col("total").alias("total_p50"), F.col("transcription").alias("transcription_p50")),
        log.groupBy("call").agg(F.count_if(F.col("kind") == "interruption").alias("false_replies")),
    ]
    out = calls(log)
    for p in parts:
        out = out.join(p, "call", "left")
    return out


def warnings(compared: DataFrame) -> DataFrame:
    """warning, raised: whether the compared calls differ in model speed, length or commit path, or left turns unanswered."""
    one = compared.agg(
        F.coalesce(F.max("first_token_p50") > 2 * F.min("first_token_p50"), F.lit(False)).alias("model_speed"),
        (F.max(F.coalesce("committed", F.lit(0))) > 1.5 * F.greatest(F.lit(1), F.min(F.coalesce("committed", F.lit(0))))).alias("conversation_length"),
        ((F.count_if(F.col("transcription_p50") > 100) > 0) & (F.count_if(F.col("transcription_p50") > 100) < F.count("transcription_p50"))).alias("commit_path"),
        F.coalesce(F.max("longest_ms") > LONG_WAIT_MS, F.lit(False)).alias("unanswered"),
    )
    names = ["model_speed", "conversation_length", "commit_path", "unanswered"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("warning"), F.col(n).alias("raised")) for n in names])).alias("w")).select("w.*")


#: What a session row keeps of a framework's debug record (fixed values).
SESSION_FIELDS = ("probability", "unlikely_threshold", "endpointing_delay", "language", "trigger", "from_cache")
SESSION_MESSAGE = "eot prediction"


def session_rows(records: DataFrame, start_ms: Column) -> DataFrame:
    """call, kind, t_ms and the listed fields of the debug records (call, message, created_ms, extra map) that predict a turn's end.

    A field that a record lacks is null.
    """
    kept = records.where(F.col("message") == SESSION_MESSAGE)
    return kept.select("call", F.lit("session").alias("kind"), (F.col("created_ms") - start_ms).alias("t_ms"), *[F.get(F.array(F.col("extra")[f]), F.lit(0)).alias(f) for f in SESSION_FIELDS])


def final_only(rows: DataFrame, is_final: Column) -> DataFrame:
    return rows.where(F.coalesce(is_final, F.lit(False)))


def endpointing_delay(probability: Column, threshold: Column, low_ms: Column, high_ms: Column) -> Column:
    """Short delay for a probable end, long otherwise and without a prediction."""
    return F.when(probability > threshold, low_ms).otherwise(high_ms)
