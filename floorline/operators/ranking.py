"""Ranks, running sums and exact quantiles over whole tables without gathering them in one task.

Values are dealt into ranges by approximate quantiles; exact counts per range (a few rows) give each range its
offset, and windows run inside ranges. Equal values share a range, and repeated ones are counted, not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.sources.scratch import stored

RANGES = 64


def bounds(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Distinct approximate quantiles of a numeric column, at most ranges - 1."""
    found = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.005)
    return sorted(set(found))


def range_of(value: Column, cuts: list[float]) -> Column:
    """Number of cuts that a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: value.cast("double") >= c)) if cuts else F.lit(0)


def running(df: DataFrame, value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """df (one row per value) with `<name>_before`: the sum over all rows of smaller (greater) value."""
    rows = df.withColumn("__range", range_of(F.col(value), bounds(df, value)))
    parts = rows.groupBy("__range").agg(*[F.sum(s).alias(s) for s in sums])
    way = F.desc if descending else F.asc
    earlier = Window.partitionBy(F.lit(0)).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = parts.select("__range", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy("__range").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(offsets), "__range")
    for s in sums:
        rows = rows.withColumn(f"{s}_before", F.col(f"__{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return rows.drop("__range", *[f"__{s}" for s in sums])


def ordinal(df: DataFrame, key: str, name: str = "ordinal", sample: int = 4096) -> DataFrame:
    """df with its rows' places from 0 in the order of a unique key as text.

    Ranges are cut at keys of a hash sample of about `sample` keys; counts per range give the offsets.
    """
    text = F.col(key).cast("string")
    thin = max(1, df.count() // sample)
    drawn = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(text), F.lit(thin)) == 0).select(text.alias("k")).where("k is not null").limit(4 * sample).collect())
    cuts = sorted({drawn[i * len(drawn) // RANGES] for i in range(1, RANGES)}) if drawn else []
    in_range = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: text >= c)) if cuts else F.lit(0)
    rows = df.withColumn("__range", in_range)
    parts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = parts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(text)
    rows = rows.join(F.broadcast(offsets), "__range")
    return rows.withColumn(name, (F.col("__before") + F.row_number().over(inside) - 1).cast("long")).drop("__range", "__before")


def at_ranks(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group: n, and for each name the value at that rank (from 0; an expression of n) in rising order.

    Nulls of the value take no part. Groups may be none: then one row.
    """
    rows = df.where(F.col(value).isNotNull())
    if not groups:
        rows = rows.withColumn("__all", F.lit(0))
    by = groups or ["__all"]
    # read three times below: written once, so the source is worked out once
    counted = stored(rows.groupBy(*by, value).agg(F.count("*").alias("__c")), "value-counts")
    counted = counted.withColumn("__range", range_of(F.col(value), bounds(counted, value)))
    parts = counted.groupBy(*by, "__range").agg(F.sum("__c").alias("__c"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group at most
    parts = parts.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).withColumn("n", F.sum("__c").over(Window.partitionBy(*by)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])
    parts = parts.select(*by, "__range", "__before", "n", F.filter(wanted, lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__c"))).alias("__wanted"))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = counted.join(parts.where(F.size("__wanted") > 0), [*by, "__range"])
    low = F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    found = found.withColumn("__low", low).select(*by, "n", F.col(value).alias("__v"), F.explode("__wanted").alias("__w"), "__low", "__c")
    hit = found.where("__w.rank >= __low and __w.rank < __low + __c")
    out = hit.groupBy(*by, "n").agg(*[F.max(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in ranks])
    return out if groups else out.drop("__all")


def rank_floor(f: float) -> Column:
    """sorted[int(f * n)], held within the list."""
    return F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1)


def rank_nth(part: int) -> Column:
    """sorted[n // part]."""
    return F.floor(F.col("n") / part)


def rank_nearest(percent: float) -> Column:
    """Nearest rank round(percent / 100 * (n - 1)), ties to even."""
    return F.least(F.rint(F.lit(percent / 100) * (F.col("n") - 1)), F.col("n") - 1)


def linear(df: DataFrame, groups: list[str], value: str, f: float, name: str) -> DataFrame:
    """Per group: n and the linear quantile, between the two nearest ranks."""
    place = F.lit(f) * (F.col("n") - 1)
    rows = at_ranks(df, groups, value, {"__low": F.floor(place), "__high": F.ceil(place)})
    part = place - F.floor(place)
    return rows.withColumn(name, F.col("__low") + (F.col("__high") - F.col("__low")) * part).drop("__low", "__high")
