"""Confirmation of speech by transcript segments, and the words each span gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from floorline.functions.exprs import word_count, words_in
from floorline.operators.intervals import overlap_join
from floorline.operators.asof import lengths_until

MIN_OVERLAP_MS = 100


def confirm(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans with `confirmed` (their largest single overlap reaches MIN_OVERLAP_MS), best_ms, utts, n_segs, inside_one.

    Utterances come in order of their start. Every overlapping segment counts, however early it began.
    """
    keys = ["base", "side"]
    pairs = overlap_join(spans.select(*keys, "start_ms", "end_ms"), segments.select(*keys, "start_ms", "end_ms", "utt"), keys)
    hits = pairs.groupBy(*keys, "start_ms", "end_ms").agg(
        F.max("overlap_ms").alias("best_ms"),
        F.array_sort(F.collect_list(F.struct("r_start_ms", "r_utt"))).alias("hits"),
        ((F.count("*") == 1) & (F.min("r_start_ms") <= F.col("start_ms")) & (F.max("r_end_ms") >= F.col("end_ms"))).alias("inside_one"),
    )
    rows = spans.join(hits, [*keys, "start_ms", "end_ms"], "left")
    rows = rows.withColumn("best_ms", F.coalesce("best_ms", F.lit(0).cast("long"))).withColumn("inside_one", F.coalesce("inside_one", F.lit(False)))
    rows = rows.withColumn("utts", F.transform("hits", lambda h: h["r_utt"])).withColumn("n_segs", F.coalesce(F.size("utts"), F.lit(0)))
    return rows.withColumn("n_segs", F.greatest("n_segs", F.lit(0))).withColumn("confirmed", F.col("best_ms") >= MIN_OVERLAP_MS).drop("hits")


def bleed(confirmed: DataFrame) -> DataFrame:
    """What was dropped as the other leg's bleed: spans and milliseconds, beside the totals."""
    length = F.col("end_ms") - F.col("start_ms")
    return confirmed.agg(
        F.count("*").alias("spans"),
        F.count_if(~F.col("confirmed")).alias("dropped"),
        F.sum(length).alias("speech_ms"),
        F.coalesce(F.sum(F.when(~F.col("confirmed"), length)), F.lit(0)).alias("dropped_ms"),
    )


def apportion(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """For each overlapping (span, segment): which of the segment's words the span gets, and their fractional count.

    Words are spread over the segment's speech; where it has none, over its elapsed time. Speech before and up to
    the span's ends comes from as-of lookups. first_word counts from 0, the slice ends before end_word.
    """
    keys = ["base", "side"]
    speech = spans.select(*keys, "start_ms", "end_ms")
    counted = segments.select(*keys, "start_ms", "end_ms", "utt", word_count(F.col("text")).alias("n"))
    rows = overlap_join(speech, counted, keys).withColumnRenamed("r_n", "n").where("n > 0 and r_end_ms > r_start_ms")
    rows = rows.withColumn("from_ms", F.greatest("start_ms", "r_start_ms")).withColumn("to_ms", F.least("end_ms", "r_end_ms"))
    rows = lengths_until(rows, speech, keys, ["r_start_ms", "r_end_ms", "from_ms", "to_ms"])
    total = F.col("r_end_ms_until") - F.col("r_start_ms_until")
    elapsed = F.col("r_end_ms") - F.col("r_start_ms")
    # shares as integer numerators over one denominator, so that cuts are exact
    den = F.when(total > 0, total).otherwise(elapsed)
    num = lambda at: F.when(total > 0, F.col(f"{at}_until") - F.col("r_start_ms_until")).otherwise(F.col(at) - F.col("r_start_ms"))
    rows = rows.withColumn("den", den).withColumn("num0", num("from_ms")).withColumn("num1", num("to_ms"))
    n = F.col("n")
    first = F.least(n, F.floor(F.col("num0") * n / F.col("den")))
    end = F.least(n, F.floor((F.col("num1") * n * 1000 + 999 * F.col("den")) / (F.col("den") * 1000)))
    rows = rows.withColumn("first_word", F.greatest(F.lit(0).cast("long"), first)).withColumn("end_word", F.greatest(F.col("first_word"), end))
    # texts join the slices at the end and pass through no sort
    texts = segments.select(*keys, F.col("utt").alias("r_utt"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"), words_in(F.col("text")).alias("words"))
    rows = rows.join(texts, [*keys, "r_utt", "r_start_ms", "r_end_ms"])
    text = F.array_join(F.slice("words", (F.col("first_word") + 1).cast("int"), (F.col("end_word") - F.col("first_word")).cast("int")), " ")
    count_ = F.round(n * F.greatest(F.lit(0).cast("long"), F.col("num1") - F.col("num0")) / F.col("den"), 6)
    return rows.select(*keys, "start_ms", "end_ms", F.col("r_utt").alias("utt"), "first_word", "end_word", text.alias("text"), count_.alias("n_words"))
