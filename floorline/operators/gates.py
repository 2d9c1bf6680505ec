"""Ordered gates over boundaries: one outcome per boundary, so the funnel always adds up."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from floorline.functions.exprs import sample_id

CLIP_MS, TRAIL_MS = 8000, 200
CORE = ("change", "hold_intra")
HELD_BACK = ("change_midseg", "hold_inter")


@dataclass(frozen=True)
class Gates:
    """Thresholds in milliseconds and twentieths of a word (fixed values)."""

    min_prev: int = 1000
    max_other_before: int = 800
    max_crosstalk: int = 50
    pos_min_gap: int = 0
    pos_max_gap: int = 1500
    pos_min_next: int = 1000
    pos_min_next_k: int = 60
    neg_min_pause: int = 200
    neg_max_pause: int = 2000
    neg_min_next: int = 300


STRICT = Gates()
RELAXED = replace(STRICT, min_prev=500, neg_max_pause=5000)


def outcome(g: Gates = STRICT, said: Column | None = None) -> Column:
    """First rule that applies, in order; the last of each kind are the kept classes. said: whether the ended spurt has words."""
    c = F.col
    said = F.coalesce(c("prev_text"), F.lit("")) != "" if said is None else said
    return (
        F.when(c("prev_ms") < g.min_prev, "short_prev")
        .when(~said, "no_text")
        .when(c("active"), "straddle")
        .when(c("other_before_ms") > g.max_other_before, "bargein")
        .when(
            c("kind") == "change",
            F.when(c("gap_ms") < g.pos_min_gap, "pos_gap_short")
            .when(c("gap_ms") > g.pos_max_gap, "pos_gap_long")
            .when((c("next_k") < g.pos_min_next_k) | (c("next_ms") < g.pos_min_next), "backchannel")
            .when(~c("ends_segment"), "change_midseg")
            .otherwise("change"),
        )
        .otherwise(
            F.when(c("gap_ms") < g.neg_min_pause, "pause_short")
            .when(c("gap_ms") > g.neg_max_pause, "pause_long")
            .when(c("other_gap_ms") > g.max_crosstalk, "other_spoke")
            .when(c("next_ms") < g.neg_min_next, "resume_tiny")
            .when(c("ends_segment"), "hold_inter")
            .otherwise("hold_intra")
        )
    )


def judged(boundaries: DataFrame, g: Gates = STRICT) -> DataFrame:
    said = F.col("prev_said") if "prev_said" in boundaries.columns else None
    return boundaries.withColumn("outcome", outcome(g, said))


def funnel(judged_rows: DataFrame) -> DataFrame:
    """stage, n: terminal outcomes, candidates of either kind, and the total."""
    past = ~F.col("outcome").isin("short_prev", "no_text", "straddle", "bargein")
    stages = F.array(
        F.col("outcome"), F.lit("total"), F.when(past, F.concat(F.lit("cand_"), F.col("kind")))
    )
    return judged_rows.select(F.explode(stages).alias("stage")).where("stage is not null").groupBy("stage").agg(F.count("*").alias("n"))


def is_core(source: Column) -> Column:
    return source.isin(*CORE)


def is_held_back(source: Column) -> Column:
    return source.isin(*HELD_BACK)


def class_counts(samples: DataFrame, *by: str) -> DataFrame:
    """Per class (and split): rows, calls that contribute, and whether the class is of the core set or held back."""
    counts = samples.groupBy("source", *by).agg(F.count("*").alias("n"), F.count_distinct("base").alias("calls"), F.count_if(F.col("label_rule") == 1).alias("positive"))
    kind = F.when(is_core(F.col("source")), "core").when(is_held_back(F.col("source")), "held back")
    return counts.withColumn("kind", kind)


def samples(judged_rows: DataFrame, harvest: str = "core") -> DataFrame:
    """Kept boundaries as labelled samples with the geometry of their clips."""
    kept = judged_rows.where(F.col("outcome").isin(*CORE, *HELD_BACK))
    end = F.col("t_ms") + TRAIL_MS
    return kept.select(
        sample_id(F.col("base"), F.col("side"), F.col("t_ms")).alias("sid"),
        "base",
        "side",
        F.when(F.col("kind") == "change", 1).otherwise(0).alias("label_rule"),
        "t_ms",
        F.greatest(F.lit(0).cast("long"), end - CLIP_MS).alias("clip_start_ms"),
        end.alias("clip_end_ms"),
        "gap_ms",
        "prev_ms",
        F.col("prev_text").alias("text"),
        F.col("outcome").alias("source"),
        "next_text",
        F.lit(harvest).alias("harvest"),
    )
