"""Floor-holding turns: runs of one side, backchannels absorbed, lapses split, and what each turn measures.

Absorption needs no iteration: two sides alternate, so a run that passes the backchannel test is absorbed
exactly if it stands at an odd place in its streak of such runs (streaks start at the second run) and is not
the last run. A merged run only grows, so nothing new passes the test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import half_even, other_side, words_in
from floorline.operators.asof import asof, lengths_until
from floorline.operators.labels import last_wins
from floorline.sources.scratch import stored

#: Fixed values, in milliseconds and twentieths of a word.
BACKCHANNEL_K, BACKCHANNEL_MS = 60, 1000
LAPSE_MS, CROSSTALK_MS, TRAIL_MS = 2000, 50, 500
CLEAN_MS, CLEAN_RATE_100, TOUCH_MS = 1000, 100, 50


def is_backchannel(k: Column, ms: Column) -> Column:
    return (k < BACKCHANNEL_K) & (ms < BACKCHANNEL_MS)


def floor_runs(spans: DataFrame) -> DataFrame:
    """Spans with `run` (number of the maximal same-side run in the call), `absorbed` and `hold` (run after absorption)."""
    order = Window.partitionBy("base").orderBy("start_ms", "end_ms", "side")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.coalesce(F.col("side") != F.lag("side").over(order), F.lit(True))
    rows = spans.withColumn("run", F.sum(changed.cast("long")).over(upto) - 1)
    runs = rows.groupBy("base", "run").agg((F.max("end_ms") - F.min("start_ms")).alias("ms"), F.sum("k").alias("k"))
    by_run = Window.partitionBy("base").orderBy("run")
    so_far = by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = is_backchannel(F.col("k"), F.col("ms")) & (F.col("run") >= 1)
    runs = runs.withColumn("anchor", F.last(F.when(~small, F.col("run")), ignorenulls=True).over(so_far))
    place = F.col("run") - F.col("anchor")
    is_last = F.lead("run").over(by_run).isNull()
    runs = runs.withColumn("absorbed", small & (place % 2 == 1) & ~is_last)
    opens = ~F.col("absorbed") & ~F.coalesce(F.lag("absorbed").over(by_run), F.lit(False))
    runs = runs.withColumn("hold", F.sum(opens.cast("long")).over(so_far))
    return rows.join(runs.select("base", "run", "absorbed", "hold"), ["base", "run"])


def edge_text(parts: Column) -> Column:
    """Words of ordered (text, start_ms, end_ms), a repeated word dropped only where two spans all but touch."""

    def step(acc, p):
        w = words_in(p["text"])
        touching = F.coalesce(p["start_ms"] - acc["end"] < TOUCH_MS, F.lit(False))
        again = touching & (F.size(acc["words"]) > 0) & (F.size(w) > 0) & (F.element_at(acc["words"], -1) == F.get(w, F.lit(0)))
        kept = F.when(again, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w)
        return F.struct(F.concat(acc["words"], kept).alias("words"), p["end_ms"].alias("end"))

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(None).cast("long").alias("end"))
    return F.aggregate(parts, start, step, lambda acc: F.array_join(acc["words"], " "))


def held_spans(spans: DataFrame) -> DataFrame:
    return held_of(floor_runs(spans))


def held_of(runs: DataFrame) -> DataFrame:
    """Spans that turns claim, with `hold`, `turn` (number in the call) and `cut_before`, from floor_runs.

    A hold is cut where its own pause lasts over LAPSE_MS, or where the other leg, absorbed spans left out,
    speaks over CROSSTALK_MS inside the pause.
    """
    claimed = runs.where("not absorbed")
    order = Window.partitionBy("base", "hold").orderBy("start_ms", "end_ms")
    claimed = claimed.withColumn("pause_from", F.lag("end_ms").over(order)).withColumn("leg", other_side(F.col("side")))
    others = claimed.select("base", F.col("side").alias("leg"), "start_ms", "end_ms")
    claimed = lengths_until(claimed.withColumn("pause_to", F.col("start_ms")), others, ["base", "leg"], ["pause_from", "pause_to"])
    spoken = F.col("pause_to_until") - F.col("pause_from_until")
    lapse = (F.col("start_ms") - F.col("pause_from") > LAPSE_MS) | (spoken > CROSSTALK_MS)
    claimed = claimed.withColumn("cut_before", F.col("pause_from").isNull() | lapse)
    by_call = Window.partitionBy("base").orderBy("hold", "start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.sum(F.col("cut_before").cast("long")).over(by_call) - 1
    return claimed.withColumn("turn", turn).drop("pause_from", "pause_to", "pause_from_until", "pause_to_until", "leg", "run", "absorbed")


def absorbed_spans(spans: DataFrame) -> DataFrame:
    return absorbed_of(floor_runs(spans))


def absorbed_of(runs: DataFrame) -> DataFrame:
    return runs.where("absorbed").select("base", "side", "start_ms", "end_ms", "k")


def pauses(held: DataFrame) -> DataFrame:
    """base, turn, side, start_ms, end_ms of every own pause inside a turn."""
    order = Window.partitionBy("base", "turn").orderBy("start_ms", "end_ms")
    rows = held.select("base", "turn", "side", F.lag("end_ms").over(order).alias("from_ms"), F.col("start_ms").alias("end_ms"))
    return rows.where("end_ms > from_ms").select("base", "turn", "side", F.col("from_ms").alias("start_ms"), "end_ms")


def word_rate_100(k: Column, speech_ms: Column) -> Column:
    """Words a second in hundredths, as it is published; 0 without speech."""
    return F.when(speech_ms > 0, half_even(k * 5000, speech_ms)).otherwise(F.lit(0).cast("long"))


def is_clean() -> Column:
    c = F.col
    return (
        c("starts_segment")
        & c("ends_segment")
        & (c("speech_crosstalk_ms") <= CROSSTALK_MS)
        & F.coalesce(c("eot_gap_ms") >= 0, F.lit(False))
        & (c("duration_ms") >= CLEAN_MS)
        & (c("word_rate_100") >= CLEAN_RATE_100)
    )


#: The six gates of a clean turn, in the order of the cumulative funnel.
CLEAN_GATES = {
    "starts_segment": "starts_segment",
    "ends_segment": "ends_segment",
    "no_speech_crosstalk": f"speech_crosstalk_ms <= {CROSSTALK_MS}",
    "gap_not_negative": "coalesce(eot_gap_ms >= 0, false)",
    "long_enough": f"duration_ms >= {CLEAN_MS}",
    "word_rate": f"word_rate_100 >= {CLEAN_RATE_100}",
}


#: Fields that a turn takes from the label of its end (fixed values).
LABEL_FIELDS = ("sid", "label", "label_pipeline", "llm_verdict", "llm_conf", "dispute", "source", "harvest")


def labelled(turns_: DataFrame, gold: DataFrame, splits: DataFrame) -> DataFrame:
    """Turns with their call's split and the fields of the usable label at their end, null without one.

    gold: base, side, t_ms, llm_ok, LABEL_FIELDS; of labels of one end the one of greatest sid counts. splits: base,
    split, a row per call; a call without a split fails the job.
    """
    usable = gold.where("llm_ok").select("base", "side", F.col("t_ms").alias("end_ms"), *LABEL_FIELDS)
    known = last_wins(usable, ["base", "side", "end_ms"], ["sid"])
    rows = turns_.join(known, ["base", "side", "end_ms"], "left").join(F.broadcast(splits.select("base", "split")), "base", "left")
    missing = F.raise_error(F.concat(F.lit("no split for call "), F.col("base"))).cast("string")
    return rows.withColumn("split", F.coalesce(F.col("split"), missing)).select(*turns_.columns, *LABEL_FIELDS, "split")


def turns(spans: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """One row per turn: bounds, text, words, pauses, gap to the next turn, edges, crosstalk, trail, absorbed, clean.

    recorded (base, side, wav_ms) also ends a turn's trail where the recording ends.
    """
    leg = Window.partitionBy("base", "side").orderBy("start_ms", "end_ms")
    shared = lambda neighbour: F.coalesce(F.arrays_overlap("segs", neighbour), F.lit(False))
    edged = spans.withColumn("fresh", ~shared(F.lag("segs").over(leg))).withColumn("final", ~shared(F.lead("segs").over(leg)))
    edged = edged.withColumn("own_next", F.lead("start_ms").over(leg))
    # read by one and four branches: written once, not worked out anew in each
    runs = stored(floor_runs(edged), "floor-runs")
    held = stored(held_of(runs), "held-spans")
    first, last = F.struct("start_ms", "end_ms", "fresh"), F.struct("start_ms", "end_ms", "final", "own_next")
    rows = held.groupBy("base", "turn", "side").agg(
        F.min(first).alias("first"),
        F.max(last).alias("last"),
        F.sum("k").alias("k"),
        F.count("*").alias("n_spans"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"),
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("parts"),
    )
    order = Window.partitionBy("base").orderBy("turn")
    start, end = F.col("first.start_ms"), F.col("last.end_ms")
    rows = rows.select(
        "base",
        "side",
        F.col("turn").alias("turn_index"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        (end - start).alias("duration_ms"),
        "k",
        "n_spans",
        "speech_ms",
        word_rate_100(F.col("k"), F.col("speech_ms")).alias("word_rate_100"),
        edge_text(F.col("parts")).alias("transcript"),
        (F.lead(start).over(order) - end).alias("eot_gap_ms"),
        F.col("first.fresh").alias("starts_segment"),
        F.col("last.final").alias("ends_segment"),
        F.greatest(F.lit(0).cast("long"), F.least(F.lit(TRAIL_MS).cast("long"), F.col("last.own_next") - end)).alias("trail_ms"),
    )
    # the other leg's speech: all of it inside pauses, without absorbed spans across the turn
    other = lambda t: t.select("base", F.col("side").alias("leg"), "start_ms", "end_ms")
    to_other = lambda t: t.withColumn("leg", other_side(F.col("side")))
    quiet = lengths_until(to_other(pauses(held)), other(runs), ["base", "leg"], ["start_ms", "end_ms"])
    quiet = quiet.groupBy("base", F.col("turn").alias("turn_index")).agg(
        F.max(F.col("end_ms_until") - F.col("start_ms_until")).alias("pause_crosstalk_ms"),
        F.count("*").alias("n_pauses"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))), lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ",").alias("silence"),
    )
    rows = stored(rows, "turn-rows")
    # bounds alone go through the sorts
    across = lengths_until(to_other(rows.select("base", "side", "turn_index", "start_ms", "end_ms")), other(held), ["base", "leg"], ["start_ms", "end_ms"])
    across = across.select("base", "turn_index", (F.col("end_ms_until") - F.col("start_ms_until")).alias("speech_crosstalk_ms"))
    # an absorbed span counts for the other side's turn in which it begins
    owner = rows.select("base", "side", "start_ms", F.struct("end_ms", "turn_index").alias("owner"))
    gone = asof(absorbed_of(runs).select("base", other_side(F.col("side")).alias("side"), F.col("start_ms").alias("onset")), owner, ["base", "side"], "onset", "start_ms", "owner")
    gone = gone.where("onset < owner.end_ms").groupBy("base", F.col("owner.turn_index").alias("turn_index")).agg(F.count("*").alias("n_absorbed"))
    rows = rows.join(across, ["base", "turn_index"]).join(quiet, ["base", "turn_index"], "left").join(gone, ["base", "turn_index"], "left")
    for name in ("pause_crosstalk_ms", "n_pauses", "n_absorbed"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
    rows = rows.withColumn("silence", F.coalesce("silence", F.lit("")))
    rows = rows.withColumn("id", F.format_string("%s_%s_%04d", "base", F.substring("side", 1, 1), "turn_index"))
    if recorded is not None:
        rows = rows.join(F.broadcast(recorded.select("base", "side", "wav_ms")), ["base", "side"], "left")
        left = F.greatest(F.lit(0).cast("long"), F.col("wav_ms") - F.col("end_ms"))
        rows = rows.withColumn("trail_ms", F.least("trail_ms", left)).drop("wav_ms")
    return rows.withColumn("clean", is_clean())


def clean_funnel(rows: DataFrame) -> DataFrame:
    """stage, n: turns that pass the first gate, the first two, and so on, in one pass."""
    passed, columns = F.lit(True), [F.count("*").alias("all")]
    for name, rule in CLEAN_GATES.items():
        passed = passed & F.expr(rule)
        columns.append(F.count_if(passed).alias(name))
    one = rows.agg(*columns)
    names = ["all", *CLEAN_GATES]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(names)])).alias("r")).select("r.*")


def eligible(eot_gap_ms: Column, longest_pause_ms: Column) -> Column:
    """For a benchmark: a gap of 0.2 to 5 s and no pause over 5 s."""
    return F.coalesce(eot_gap_ms.between(200, 5000), F.lit(False)) & (F.coalesce(longest_pause_ms, F.lit(0)) <= 5000)


def clip_spans(silence: Column, start_ms: Column, duration_ms: Column, eot_gap_ms: Column) -> Column:
    """Pauses in clip time, and the end-of-turn silence of at most 5 s behind them."""
    shifted = F.transform(silence, lambda s: F.struct((s["start_ms"] - start_ms).alias("start_ms"), (s["end_ms"] - start_ms).alias("end_ms")))
    trail = F.least(eot_gap_ms, F.lit(5000))
    return F.concat(shifted, F.array(F.struct(duration_ms.alias("start_ms"), (duration_ms + trail).alias("end_ms"))))


def previous_other_message(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with `reply_to`: the latest earlier non-blank text of the other role.

    Two windows for the two roles; a role that is neither sees nothing.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda role: F.last(F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("text")), ignorenulls=True).over(w)
    rows = messages.withColumn("__user", said("user")).withColumn("__assistant", said("assistant"))
    return rows.withColumn("reply_to", F.when(F.col("role") == "assistant", F.col("__user")).when(F.col("role") == "user", F.col("__assistant"))).drop("__user", "__assistant")
