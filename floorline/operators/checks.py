"""Invariant checks: each row of a table votes on named rules; a report counts votes and keeps a few failures.

The rules about turns derive every fact anew from the spans, by other means than the builder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import other_side, sample_id
from floorline.operators.intervals import overlap_join
from floorline.operators.turns import BACKCHANNEL_K, BACKCHANNEL_MS, CLEAN_MS, CLEAN_RATE_100, CROSSTALK_MS, LAPSE_MS

DETAILS = 5


def votes(rows: DataFrame, detail: Column, rules: dict[str, Column]) -> DataFrame:
    """check, ok, detail: one row per rule and table row; a null rule does not apply."""
    all_ = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("ok")) for name, ok in rules.items()])
    return rows.select(detail.alias("detail"), F.explode(all_).alias("v")).select("v.check", "v.ok", "detail").where("ok is not null")


def report(all_votes: DataFrame) -> DataFrame:
    """check, n, failed, sample (first failures in order of their text)."""
    bad = all_votes.where("not ok").select("check", "detail").distinct()
    few = bad.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("detail"))).where(F.col("r") <= DETAILS)
    few = few.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("sample"))
    counts = all_votes.groupBy("check").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))
    return counts.join(few, "check", "left").select("check", "n", "failed", F.coalesce("sample", F.lit("")).alias("sample"))


def turn_votes(turns: DataFrame, pauses: DataFrame, spans: DataFrame) -> DataFrame:
    """Votes on the turn table's invariants."""
    c = F.col
    span_key = ["base", "side", "start_ms", "end_ms"]
    # totality: a span lies in one turn of its own side, or in none if it could be a backchannel
    own = overlap_join(spans.select(*span_key, "k"), turns.select("base", "side", "start_ms", "end_ms", "turn_index"), ["base", "side"])
    own = own.where("start_ms >= r_start_ms and end_ms <= r_end_ms")
    claims = own.groupBy(*span_key).agg(F.count("*").alias("n_own"), F.min("r_turn_index").alias("turn_index"))
    claimed = spans.join(claims, span_key, "left").withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    small = (c("k") < BACKCHANNEL_K) & (c("end_ms") - c("start_ms") < BACKCHANNEL_MS)
    detail = F.concat_ws(" ", "base", "side", "start_ms", "end_ms")
    out = votes(claimed, detail, {"no speech double-counted": c("n_own") <= 1, "no speech lost": (c("n_own") >= 1) | small})

    order = Window.partitionBy("base").orderBy("start_ms", "turn_index")
    held = claimed.where("n_own > 0")
    gone = claimed.where("n_own = 0").select("base", other_side(c("side")).alias("side"), c("start_ms").alias("onset"))
    absorbed = gone.join(turns.select("base", "side", "turn_index", "start_ms", "end_ms"), ["base", "side"]).where("onset >= start_ms and onset < end_ms")
    absorbed = absorbed.groupBy("base", "turn_index").agg(F.count("*").alias("again_absorbed"))

    leg = Window.partitionBy("base", "side").orderBy("start_ms")
    edges = spans.withColumn("prev_segs", F.lag("segs").over(leg)).withColumn("next_segs", F.lead("segs").over(leg)).withColumn("own_next", F.lead("start_ms").over(leg))
    apart = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)) == 0, F.lit(True))
    facts = held.join(edges.select(*span_key, "prev_segs", "next_segs", "own_next"), span_key).groupBy("base", "side", "turn_index").agg(
        F.min_by(apart("segs", "prev_segs"), "start_ms").alias("again_starts"),
        F.max_by(apart("segs", "next_segs"), "start_ms").alias("again_ends"),
        F.max_by("own_next", "start_ms").alias("own_next"),
    )
    other = lambda t: t.select("base", other_side(c("side")).alias("side"), "start_ms", "end_ms")
    across = overlap_join(turns.select("base", "side", "turn_index", "start_ms", "end_ms"), other(held), ["base", "side"])
    across = across.groupBy("base", "turn_index").agg(F.sum("overlap_ms").alias("again_across"))
    inside = overlap_join(pauses, other(spans), ["base", "side"]).groupBy("base", "turn", "start_ms").agg(F.sum("overlap_ms").alias("x"))
    inside = inside.groupBy("base", F.col("turn").alias("turn_index")).agg(F.max("x").alias("again_inside"))
    silent = pauses.groupBy("base", c("turn").alias("turn_index")).agg(F.sum(c("end_ms") - c("start_ms")).alias("silent"))
    rows = turns.withColumn("place", F.row_number().over(order) - 1).withColumn("next_start", F.lead("start_ms").over(order))
    rows = rows.withColumn("same_id", F.count("*").over(Window.partitionBy("id")))
    rows = rows.join(facts, ["base", "side", "turn_index"], "left")
    for t in (absorbed, across, inside, silent):
        rows = rows.join(t, ["base", "turn_index"], "left")
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    gates = (
        c("starts_segment") & c("ends_segment") & (c("speech_crosstalk_ms") <= CROSSTALK_MS) & c("eot_gap_ms").isNotNull()
        & F.coalesce(c("eot_gap_ms") >= 0, F.lit(False)) & (c("duration_ms") >= CLEAN_MS) & (c("word_rate_100") >= CLEAN_RATE_100)
    )
    out = out.unionByName(
        votes(
            rows,
            c("id"),
            {
                "id unique": c("same_id") == 1,
                "index contiguous": c("place") == c("turn_index"),
                "duration is end less start": c("duration_ms") == c("end_ms") - c("start_ms"),
                "absorbed count": c("n_absorbed") == zero("again_absorbed"),
                "gap is next start less end": F.when(c("next_start").isNotNull(), c("eot_gap_ms") == c("next_start") - c("end_ms")),
                "last gap is null": F.when(c("next_start").isNull(), c("eot_gap_ms").isNull()),
                "no own speech in trail": F.when(c("own_next").isNotNull(), c("own_next") >= c("end_ms") + c("trail_ms")),
                "starts segment": c("starts_segment") == c("again_starts"),
                "ends segment": c("ends_segment") == c("again_ends"),
                "speech is duration less pauses": c("speech_ms") == c("duration_ms") - zero("silent"),
                "word rate": F.when(c("speech_ms") > 0, F.abs(c("word_rate_100") - c("k") * 5000 / c("speech_ms")) <= 1).otherwise(c("word_rate_100") == 0),
                "pause crosstalk": c("pause_crosstalk_ms") == zero("again_inside"),
                "speech crosstalk": c("speech_crosstalk_ms") == zero("again_across"),
                "clean is its six gates": c("clean") == gates,
            },
        )
    )
    hidden = overlap_join(pauses, other(held), ["base", "side"]).groupBy("base", "turn", "start_ms").agg(F.sum("overlap_ms").alias("held_ms"))
    silence = pauses.join(hidden, ["base", "turn", "start_ms"], "left").join(turns.select("base", c("turn_index").alias("turn"), c("start_ms").alias("from_ms"), c("end_ms").alias("to_ms")), ["base", "turn"])
    silence = silence.withColumn("was", F.lag("end_ms").over(Window.partitionBy("base", "turn").orderBy("start_ms")))
    return out.unionByName(
        votes(
            silence,
            F.concat_ws(" ", "base", "turn", "start_ms"),
            {
                "pause inside its turn": (c("start_ms") >= c("from_ms")) & (c("end_ms") <= c("to_ms")),
                "pauses ordered and disjoint": F.when(c("was").isNotNull(), c("start_ms") >= c("was")),
                "pause not empty": c("end_ms") > c("start_ms"),
                "no pause hides a floor change": F.coalesce(c("held_ms"), F.lit(0)) <= CROSSTALK_MS,
                "no pause is a lapse": c("end_ms") - c("start_ms") <= LAPSE_MS,
            },
        )
    )


def table_votes(labelled: DataFrame, splits: DataFrame, recorded: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Votes on a turn table with splits and labels: rows agree with their call's split, recording and label, all calls are there.

    splits: base, split; recorded: base, side, wav_ms; wanted: calls that each split must have.
    """
    c = F.col
    rows = labelled.join(F.broadcast(splits.select("base", F.col("split").alias("call_split"))), "base", "left")
    rows = rows.join(F.broadcast(recorded.select("base", "side", "wav_ms")), ["base", "side"], "left")
    own = sample_id(c("base"), c("side"), c("end_ms"))
    out = votes(
        rows,
        c("id"),
        {
            "split is the call's": F.coalesce(c("split") == c("call_split"), F.lit(False)),
            "audio window inside the recording": F.coalesce((c("start_ms") >= 0) & (c("end_ms") + c("trail_ms") <= c("wav_ms")), F.lit(False)),
            "label belongs to this end": F.when(c("label").isNotNull(), F.coalesce(c("sid") == own, F.lit(False))),
        },
    )
    calls = splits.select("base").distinct().join(labelled.select("base", F.lit(True).alias("there")).distinct(), "base", "left")
    out = out.unionByName(votes(calls, c("base"), {"call present": c("there").isNotNull()}))
    counts = labelled.groupBy("split").agg(F.count_distinct("base").alias("calls"))
    want = labelled.sparkSession.createDataFrame(sorted(wanted.items()), "split string, wanted long")
    return out.unionByName(votes(want.join(counts, "split", "left"), c("split"), {"calls of the split": F.coalesce(c("calls"), F.lit(0)) == c("wanted")}))


def require(rows: DataFrame, rule: Column, message: str) -> DataFrame:
    """rows, which fail the job where the rule does not hold."""
    return rows.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
