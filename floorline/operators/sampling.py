"""Splits and samples: stratified, disjoint by group, and the same on every run (order by md5, never by chance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.operators.ranking import ordinal
from floorline.sources.scratch import stored

BLOCK, TEST_OF_BLOCK, DEV_PLACE = 8, 2, 2


def seeded(key: Column, seed: int) -> Column:
    """A text whose order shuffles keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def group_split(groups: DataFrame, group: str, size: str, n_test: int, n_dev: int, seed: int) -> DataFrame:
    """group, split: groups in falling size are cut into blocks of eight, shuffled in the block, and dealt 2 : 1 : 5.

    What exceeds the wanted numbers goes to train; the numbers are never reached by taking more. Groups are few
    (one row per call), and their order is one over all of them.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(size), group)
    rows = groups.select(group, size).withColumn("__block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    flat = Window.partitionBy(F.lit(0)).orderBy("__block", seeded(F.col(group), seed))
    rows = rows.withColumn("__i", F.row_number().over(flat) - 1).withColumn("__m", F.col("__i") % BLOCK)
    split = F.when(F.col("__m") < TEST_OF_BLOCK, "test").when(F.col("__m") == DEV_PLACE, "dev").otherwise("train")
    rows = rows.withColumn("__s", split)
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__i"))
    rows = rows.withColumn("__place", place)
    keep = F.when(F.col("__s") == "test", F.col("__place") <= n_test).when(F.col("__s") == "dev", F.col("__place") <= n_dev).otherwise(True)
    return rows.select(group, F.when(keep, F.col("__s")).otherwise("train").alias("split"))


def _first_of_stratum(rows: DataFrame, strata: list[str], key: str, seed: int, n: Column) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy("__h", key)
    return rows.withColumn("__h", seeded(F.col(key), seed)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r", "__h")


def stratified_draw(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """About n rows: n // (number of strata) of each, at least one, at most n in all."""
    kinds = max(1, rows.select(*strata).distinct().count())
    picked = _first_of_stratum(rows, strata, key, seed, F.lit(max(1, n // kinds)))
    return picked.orderBy(seeded(F.col(key), seed + 1), key).limit(n)


def fraction_sample(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: int) -> DataFrame:
    """From every stratum max(1, round(fraction * size)) rows, halves to even."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__c"))
    wanted = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("__c")).cast("int"))
    joined = rows.join(sizes.withColumn("__want", wanted).drop("__c"), strata)
    return _first_of_stratum(joined, strata, key, seed, F.col("__want")).drop("__want")


def stride_sample(rows: DataFrame, key: str, step: int) -> DataFrame:
    """Every step-th row in the order of a unique key."""
    return ordinal(rows, key, "__o").where(F.col("__o") % step == 0).drop("__o")


def evenly_spaced(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows spread evenly over the order of a unique key, its first and last included."""
    total = rows.count()
    places = sorted({int(i * (total - 1) / (n - 1)) for i in range(n)}) if total > n > 1 else list(range(min(total, n)))
    return ordinal(rows, key, "__o").where(F.col("__o").isin(places)).drop("__o") if total else rows


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by seeded order."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def pack_ordinals(rows: DataFrame, split: str, key: str, stride: int) -> DataFrame:
    """rows with `ordinal` and `offset` in their split's packed stream of fixed-stride records, in order of key.

    Rows are dealt by ranges of split and key; counts per range (a row each) give the offsets, so no split meets in
    one task.
    """
    ranged = stored(rows.repartitionByRange(split, key).withColumn("__part", F.spark_partition_id()), "pack-ordinals")
    earlier = Window.partitionBy(split).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(split, "__part").agg(F.count("*").alias("__n"))
    parts = parts.select(F.col(split).alias("__split"), "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(split, "__part").orderBy(key)) - 1
    numbered = ranged.withColumn("__in", inside).join(F.broadcast(parts.withColumnRenamed("__part", "__p")), (F.col("__part") == F.col("__p")) & F.col(split).eqNullSafe(F.col("__split")))
    ordinal_ = (F.col("__before") + F.col("__in")).cast("long")
    return numbered.withColumn("ordinal", ordinal_).withColumn("offset", ordinal_ * stride).select(*rows.columns, "ordinal", "offset")


def splice(base: DataFrame, harvest: DataFrame, frozen: DataFrame, key: str, group: str) -> DataFrame:
    """base and those harvested rows that are new and whose group is not frozen."""
    new = harvest.join(base.select(key), key, "left_anti").join(frozen.select(group).distinct(), group, "left_anti")
    return base.unionByName(new.select(base.columns))


def collisions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur in both."""
    return a.select(key).intersect(b.select(key))
