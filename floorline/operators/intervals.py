"""Interval algebra on rows of start_ms, end_ms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import overlap
from floorline.operators.asof import lengths_until

#: A minute: longer than most spans, so few rows fall into several buckets.
BUCKET_MS = 60_000


@dataclass(frozen=True)
class Decoder:
    """Thresholds of the hysteresis decoder (fixed values); one frame lasts hop_ms."""

    on: float = 0.50
    off: float = 0.35
    silence_frames: int = 3
    speech_frames: int = 3
    hop_ms: int = 32

    def __post_init__(self):
        if self.on < self.off:
            raise ValueError("the onset threshold must not be under the offset threshold")


def hysteresis(frames: DataFrame, d: Decoder = Decoder()) -> DataFrame:
    """leg, start_ms, end_ms of decoded speech from rows (leg, i, p).

    Speech opens at p >= on and closes at the first of silence_frames frames under off; frames between
    the thresholds keep the state and break the silence. Short spans are dropped, an open one ends with the leg.
    The state is the last event that was seen: onset, or the frame at which the silence is long enough.
    """
    order = Window.partitionBy("leg").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.col("i") - F.coalesce(F.last(F.when(F.col("p") >= d.off, F.col("i")), ignorenulls=True).over(upto), F.lit(-1))
    rows = frames.withColumn("low", low)
    event = F.when(F.col("p") >= d.on, 1).when(F.col("low") >= d.silence_frames, 0)
    rows = rows.withColumn("state", F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit(0)))
    rows = rows.withColumn("was", F.coalesce(F.lag("state").over(order), F.lit(0)))
    rows = rows.withColumn("island", F.sum(F.when((F.col("state") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(upto))
    ends = F.min(F.when((F.col("state") == 0) & (F.col("was") == 1), F.col("i") - d.silence_frames + 1))
    spans = (
        rows.where("island > 0")
        .groupBy("leg", "island")
        .agg(F.min(F.when(F.col("state") == 1, F.col("i"))).alias("first"), F.coalesce(ends, F.max("i") + 1).alias("end"))
        .where(F.col("end") - F.col("first") >= d.speech_frames)
    )
    return spans.select("leg", (F.col("first") * d.hop_ms).alias("start_ms"), (F.col("end") * d.hop_ms).alias("end_ms"))


def clip(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    """Spans cut to [low, high]; what is empty then is dropped."""
    cut = spans.withColumn("start_ms", F.greatest("start_ms", low)).withColumn("end_ms", F.least("end_ms", high))
    return cut.where("end_ms > start_ms")


def length_inside(windows: DataFrame, spans: DataFrame, keys: list[str], low: str, high: str, name: str) -> DataFrame:
    """windows with `name`: length of the key's disjoint spans inside [low, high]."""
    at = lengths_until(windows, spans, keys, [low, high])
    return at.withColumn(name, F.col(f"{high}_until") - F.col(f"{low}_until")).drop(f"{low}_until", f"{high}_until")


def simultaneous(spans: DataFrame) -> DataFrame:
    """base, overlap_ms: time in which both legs speak."""
    left = spans.where("side = 'Left'").select("base", "start_ms", "end_ms")
    right = spans.where("side = 'Right'").select("base", "start_ms", "end_ms")
    inside = length_inside(left, right, ["base"], "start_ms", "end_ms", "shared")
    return inside.groupBy("base").agg(F.sum("shared").alias("overlap_ms"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap, with `overlap_ms`; right columns get the prefix r_.

    Both sides are also dealt by time bucket (not where bucket_ms is None), so rows meet only those of their time and
    a key that holds very many rows is spread; a pair is kept in the bucket where its overlap starts, so none comes
    twice.
    """
    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    on = list(keys)
    if bucket_ms:
        deal = lambda s, e: F.explode(F.sequence(F.floor(s / bucket_ms), F.floor(e / bucket_ms)))
        left = left.withColumn("__bucket", deal(F.col("start_ms"), F.col("end_ms")))
        r = r.withColumn("__bucket", deal(F.col("r_start_ms"), F.col("r_end_ms")))
        on.append("__bucket")
    pairs = left.join(r, on).where((F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms")))
    if bucket_ms:
        pairs = pairs.where(F.col("__bucket") == F.floor(F.greatest("start_ms", "r_start_ms") / bucket_ms)).drop("__bucket")
    return pairs.withColumn("overlap_ms", overlap(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms")))


def timeline(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both legs as one table with `side` and `ordinal` per call in order (start, end, side)."""
    both = left.withColumn("side", F.lit("Left")).unionByName(right.withColumn("side", F.lit("Right")))
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("base").orderBy("start_ms", "end_ms", "side")))


def totals(spans: DataFrame) -> DataFrame:
    """Per call: spans and speech per leg, and the end of the last span."""
    length = F.col("end_ms") - F.col("start_ms")
    side = lambda s, x: F.coalesce(F.sum(F.when(F.col("side") == s, x)), F.lit(0))
    return spans.groupBy("base").agg(
        side("Left", F.lit(1)).alias("left_spans"),
        side("Right", F.lit(1)).alias("right_spans"),
        side("Left", length).alias("left_ms"),
        side("Right", length).alias("right_ms"),
        F.max("end_ms").alias("span_ms"),
    )
