"""Writers and table maintenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.sources.scratch import stored

TEXT_COLUMNS = ("text", "next_text", "llm_reason")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines; Spark writes other than ASCII as it is."""
    rows.write.json(path)


def refresh(rows: DataFrame, fresh: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with column taken from fresh where it has the key, one row of counters).

    The caller writes the result beside the old table and swaps; counting alone is the dry run.
    """
    found = rows.join(fresh.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit")), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    counters = found.agg(
        F.count("*").alias("rows"), F.count_if(~hit).alias("missing"), F.count_if(hit & ~F.col("__new").eqNullSafe(F.col(column))).alias("changed")
    )
    return found.withColumn(column, F.when(hit, F.col("__new")).otherwise(F.col(column))).select(rows.columns), counters


def not_yet(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not written yet."""
    return rows.join(existing.select(key), key, "left_anti")


def usable_keys(*caches: DataFrame) -> DataFrame:
    """sid of usable verdicts over several caches."""
    out = None
    for c in caches:
        part = c.where(F.col("verdict").isin("complete", "incomplete")).select("sid")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def refuse_collisions(fresh: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """fresh, or an error if a key exists already."""
    hit = fresh.select(key).intersect(existing.select(key)).limit(5).collect()
    if hit:
        raise ValueError(f"{key} exists already: {[r[0] for r in hit]}")
    return fresh


def without_text(rows: DataFrame) -> DataFrame:
    """The projection that may be handed on: no transcripts, no model's reasons."""
    return rows.drop(*TEXT_COLUMNS)


def write_split_parquet(rows: DataFrame, path: str, split: str = "split", most_rows: int | None = None) -> None:
    writer = rows.write.partitionBy(split).option("compression", "zstd")
    (writer.option("maxRecordsPerFile", most_rows) if most_rows else writer).parquet(path)


def shards(rows: DataFrame, split: str, key: str, size: Column, most_bytes: int) -> DataFrame:
    """split, key, shard, n_shards: rows in key order roll to a new shard when one would pass most_bytes.

    The rollover depends on every row before, so a split's sizes (not its payload) go through one task; shards_by_sum
    has no such task.
    """

    def roll(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__key", kind="stable")
        shard, held, out = 0, 0, []
        for n in part["__size"]:
            if held and held + n > most_bytes:
                shard, held = shard + 1, 0
            held += n
            out.append(shard)
        return pd.DataFrame({"__split": part["__split"], "__key": part["__key"], "shard": out, "n_shards": shard + 1})

    types = dict(rows.dtypes)
    light = rows.select(F.col(split).alias("__split"), F.col(key).alias("__key"), size.cast("long").alias("__size"))
    rolled = light.groupBy("__split").applyInPandas(roll, f"__split {types[split]}, __key {types[key]}, shard int, n_shards int")
    return rolled.withColumnRenamed("__split", split).withColumnRenamed("__key", key)


def shards_by_sum(rows: DataFrame, split: str, key: str, size: Column, most_bytes: int) -> DataFrame:
    """split, key, shard, n_shards: a row goes to the shard in which its first byte falls when rows are laid end to end.

    Shards differ from most_bytes by less than a row. Sums run over ranges of keys, so no split meets in one task.
    """
    light = rows.select(F.col(split).alias("__split"), F.col(key).alias("__key"), size.cast("long").alias("__size"))
    ranged = light.repartitionByRange("__split", "__key").withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "shard-sizes")
    parts = ranged.groupBy("__split", "__part").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__split").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumn("__all", F.sum("__sum").over(Window.partitionBy("__split")))
    inside = Window.partitionBy("__split", "__part").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("__size").over(inside), F.lit(0))
    found = ranged.withColumn("__at", at).join(F.broadcast(parts), ["__split", "__part"])
    shard = F.floor((F.col("__before") + F.col("__at")) / most_bytes).cast("int")
    count = F.greatest(F.lit(1), F.ceil(F.col("__all") / most_bytes)).cast("int")
    return found.select(F.col("__split").alias(split), F.col("__key").alias(key), F.least(shard, count - 1).alias("shard"), count.alias("n_shards"))


def shard_name(split: Column, shard: Column, n_shards: Column) -> Column:
    return F.format_string("%s-%05d-of-%05d", split, shard, n_shards)


def requests(rows: DataFrame, prompt: str, uri: Column) -> DataFrame:
    """One JSON request per row, for a batch service."""
    part = lambda t, u: F.struct(t.alias("text"), u.alias("fileData"))
    none_file = F.lit(None).cast("struct<fileUri:string,mimeType:string>")
    file = F.struct(uri.alias("fileUri"), F.lit("audio/wav").alias("mimeType"))
    body = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(part(F.lit(prompt), none_file), part(F.lit(None).cast("string"), file)).alias("parts"))).alias("contents"))
    return rows.select(F.to_json(F.struct(body.alias("request"))).alias("value"))


def sheet_lines(rows: DataFrame, order: list[Column]) -> DataFrame:
    """value: the lines of a CSV sheet, all fields quoted, behind a byte-order mark and a header, in the given order."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(c)) for c in rows.columns])
    places = [f"__{i}" for i in range(len(order))]
    body = rows.select(F.lit(1).alias("__head"), *[o.alias(n) for o, n in zip(order, places)], line.alias("value"))
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    first = rows.sparkSession.range(1).select(F.lit(0).alias("__head"), *[F.lit(None).cast(body.schema[n].dataType).alias(n) for n in places], F.lit(head).alias("value"))
    return body.unionByName(first).orderBy("__head", *places).select("value")


def review_sheet(rows: DataFrame, path: str, order: list[Column]) -> None:
    """The sheet as one text file; sheets are read by people, so one file holds them."""
    sheet_lines(rows, order).coalesce(1).write.text(path, lineSep="\r\n")


def only_keys(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The cached rows whose key is wanted."""
    return cache.join(keys.select(key).distinct(), key, "left_semi")


def summary_lines(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """line, value: a text table of aggregates, a row of bars per group, for cards and reports."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.col(label).cast("string").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in (label, *columns)]), F.lit(" |")).alias("value"))


def job_progress(jobs: DataFrame) -> DataFrame:
    """model, state: jobs, requests done and failed, percent."""
    return jobs.groupBy("model", "state").agg(F.count("*").alias("jobs"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.sum("total").alias("total")).withColumn(
        "percent", F.when(F.col("total") > 0, 100.0 * (F.col("ok") + F.col("failed")) / F.col("total")).otherwise(0.0)
    )
