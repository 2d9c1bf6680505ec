"""Talk-spurts and turn boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from floorline.functions.exprs import other_side, words_in
from floorline.operators.asof import asof, cumulative, length_until

SPURT_GAP_MS = 400
LOOKBACK_MS = 1000


def joined_text(parts):
    """Words of ordered texts, a text's first word dropped where it repeats the last word so far."""

    def step(acc, p):
        w = words_in(p)
        again = (F.size(acc) > 0) & (F.size(w) > 0) & (F.element_at(acc, -1) == F.get(w, F.lit(0)))
        return F.concat(acc, F.when(again, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), " ")


def spurts(spans: DataFrame, texts: bool = True) -> DataFrame:
    """Spans with their spurt (spans of one leg less than 400 ms apart) seen from each span.

    back_ms, back_k: length and words from the spurt's start to this span's end; ahead_ms, ahead_k, ahead_text:
    from this span's start to the spurt's end; back_text likewise. A spurt is bounded by its pauses, so the texts gathered are few.
    Without texts only `back_said`, whether back_text would hold a word, is worked out.
    """
    leg = Window.partitionBy("base", "side").orderBy("start_ms", "end_ms")
    upto = leg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.col("start_ms") - F.lag("end_ms").over(leg) >= SPURT_GAP_MS
    rows = spans.withColumn("spurt", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(upto))
    part = Window.partitionBy("base", "side", "spurt")
    inner = part.orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = part.orderBy(F.desc("start_ms"), F.desc("end_ms")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("back_k", F.sum("k").over(inner)).withColumn("ahead_k", F.sum("k").over(rest))
    rows = rows.withColumn("back_ms", F.col("end_ms") - F.min("start_ms").over(part)).withColumn("ahead_ms", F.max("end_ms").over(part) - F.col("start_ms"))
    if not texts:
        return rows.withColumn("back_said", F.max(F.size(words_in(F.col("text"))) > 0).over(inner))
    rows = rows.withColumn("__back", F.collect_list("text").over(inner)).withColumn("__ahead", F.reverse(F.collect_list("text").over(rest)))
    return rows.withColumn("back_text", joined_text(F.col("__back"))).withColumn("ahead_text", joined_text(F.col("__ahead"))).drop("__back", "__ahead")


def boundaries(spans: DataFrame, texts: bool = True) -> DataFrame:
    """One row per span that its leg continues: what happened when it ended at t_ms.

    kind is `change` if the other leg's next span (strictly after t) starts before this leg's next one, else
    `hold`; gap, next_*: whoever spoke next; prev_*: the spurt that ended. The other leg is `active` at t if
    its latest span by t has not ended; its speech is summed over the second before t and over the gap.
    Without texts, `prev_said` stands in for prev_text and next_text is left out.
    """
    leg = Window.partitionBy("base", "side").orderBy("start_ms", "end_ms")
    rows = spurts(spans, texts)
    seen = ["ahead_ms", "ahead_k"] + ["ahead_text"] * texts
    view = F.struct("start_ms", "end_ms", *seen)
    rows = rows.withColumn("own", F.lead(view).over(leg)).withColumn("own_segs", F.lead("segs").over(leg))
    probes = rows.where("own is not null").select(
        "base",
        "side",
        other_side(F.col("side")).alias("leg"),
        F.col("end_ms").alias("t_ms"),
        (F.col("end_ms") - LOOKBACK_MS).alias("from_ms"),
        F.col("back_ms").alias("prev_ms"),
        F.col("back_text").alias("prev_text") if texts else F.col("back_said").alias("prev_said"),
        (~F.arrays_overlap("segs", "own_segs")).alias("ends_segment"),
        "own",
    )
    others = cumulative(rows.select("base", F.col("side").alias("leg"), "start_ms", "end_ms", *seen), ["base", "leg"])
    keys = ["base", "leg"]
    others = others.withColumn("after", view).withColumn("last", F.struct("start_ms", "end_ms", "before_ms")).withColumn("earlier", F.col("last"))
    found = asof(probes, others, keys, "t_ms", "start_ms", "after", forward=True, strict=True)
    found = asof(found, others, keys, "t_ms", "start_ms", "last")
    found = asof(found, others, keys, "from_ms", "start_ms", "earlier")
    change = F.coalesce(F.col("after.start_ms") < F.col("own.start_ms"), F.lit(False))
    nxt = F.when(change, F.col("after")).otherwise(F.col("own"))
    t = F.col("t_ms")
    return found.withColumn("next", nxt).select(
        "base",
        "side",
        "t_ms",
        F.when(change, "change").otherwise("hold").alias("kind"),
        (F.col("next.start_ms") - t).alias("gap_ms"),
        "prev_ms",
        "prev_text" if texts else "prev_said",
        F.col("next.ahead_ms").alias("next_ms"),
        F.col("next.ahead_k").alias("next_k"),
        *([F.col("next.ahead_text").alias("next_text")] if texts else []),
        (length_until(t, F.col("last")) - length_until(F.col("from_ms"), F.col("earlier"))).alias("other_before_ms"),
        # no other span starts inside the gap, so only one that is running at t can reach into it
        F.when(F.col("last.end_ms") > t, F.least(F.col("last.end_ms"), F.col("next.start_ms")) - t).otherwise(F.lit(0).cast("long")).alias("other_gap_ms"),
        F.coalesce(F.col("last.end_ms") > t, F.lit(False)).alias("active"),
        "ends_segment",
    )
