"""As-of joins as windows over the union of both sides: one shuffle and sort a direction, no range join.

Frames run from the first row to the current one (the forward direction sorts in falling time), so each is
computed in one pass over a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof(probes: DataFrame, table: DataFrame, keys: list[str], at: str, on: str, take: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """probes with column `take`: the row of table (its column `take`, a struct) next to time `at` under equal keys.

    Backward: the latest with `on` <= at (< if strict). Forward: the earliest with `on` >= at (> if strict).
    Null where there is none. Rows of table with equal keys and time: the greatest struct backward, the least forward.
    """
    out = [c for c in probes.columns if c != take]
    left = probes.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(table.schema[take].dataType).alias("__take"), F.struct(*out).alias("__row"))
    right = table.select(*keys, F.col(on).alias("__t"), F.lit(0).alias("__probe"), F.col(take).alias("__take"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    # at equal times the table's rows come first unless they must not be seen
    tie = F.col("__probe").desc() if strict else F.col("__probe").asc()
    time = F.col("__t").desc() if forward else F.col("__t").asc()
    row = F.col("__take").desc() if forward else F.col("__take").asc()
    w = Window.partitionBy(*keys).orderBy(time, tie, row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).withColumn("__seen", F.last("__take", ignorenulls=True).over(w))
    return seen.where("__probe = 1").select("__row.*", F.col("__seen").alias(take))


def cumulative(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint spans with `before_ms`: the length of all earlier spans of the key."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w), F.lit(0)))


def length_until(t: Column, latest: Column) -> Column:
    """Length of a key's spans up to t, given the latest span (start_ms, end_ms, before_ms) that starts by t."""
    inside = F.greatest(F.lit(0), F.least(t, latest["end_ms"]) - latest["start_ms"])
    return F.coalesce(latest["before_ms"] + inside, F.lit(0))


def lengths_until(probes: DataFrame, spans: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """probes with `<name>_until` for every time column: the length of the key's disjoint spans up to it.

    The difference of two such columns is the length inside the interval between them.
    """
    known = cumulative(spans.select(*keys, "start_ms", "end_ms"), keys).withColumn("__span", F.struct("start_ms", "end_ms", "before_ms"))
    for name in at:
        probes = asof(probes, known, keys, name, "start_ms", "__span").withColumn(f"{name}_until", length_until(F.col(name), F.col("__span"))).drop("__span")
    return probes
