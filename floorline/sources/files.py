"""Readers. Schemas are declared, never inferred: an absent key must stay null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from floorline.operators.labels import first_by, last_wins

SEGMENT = "utt string, reco string, start double, end double"


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """place, value of the lines of text files; places sort by file and then as the lines stand in it.

    A block of a file is read in order by one task, whose row numbers rise, so (file, block, number) is the order
    of lines however large the file is.
    """
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(place.alias("place"), "value").where("value <> ''")


def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """utt, text of `utt<TAB>words` files; a later path wins, and a row with a TAB beats a bare id."""
    rows = None
    for rank, path in enumerate(paths):
        part = placed_lines(spark, path).select(F.lit(rank).alias("rank"), "place", "value")
        rows = part if rows is None else rows.unionByName(part)
    cut = F.split("value", "\t", 2)
    rows = rows.select(F.trim(F.get(cut, F.lit(0))).alias("utt"), (F.size(cut) == 2).alias("has_tab"), "rank", "place", F.trim(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).alias("text"))
    return last_wins(rows, ["utt"], ["has_tab", "rank", "place"]).select("utt", "text")


def read_segments(spark: SparkSession, paths: list[str], texts: DataFrame) -> DataFrame:
    """Segments of `utt reco start end` files: lines of other widths are skipped, the first line of an utt wins, no text is ''."""
    rows = None
    for rank, path in enumerate(paths):
        part = placed_lines(spark, path).select(F.lit(rank).alias("rank"), "place", F.split(F.trim("value"), r"\s+").alias("f"))
        rows = part if rows is None else rows.unionByName(part)
    at = lambda i: F.get("f", F.lit(i))
    rows = rows.where(F.size("f") == 4).select(at(0).alias("utt"), at(1).alias("reco"), at(2).cast("double").alias("start"), at(3).cast("double").alias("end"), "rank", "place")
    first = first_by(rows, ["utt"], ["rank", "place"]).drop("rank", "place")
    return first.join(texts, "utt", "left").withColumn("text", F.coalesce("text", F.lit("")))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_rows(spark: SparkSession, live: str, copy: str, schema: str | T.StructType) -> DataFrame:
    """JSON rows from the live file, else its gzip copy, else its plain copy; an error names what was tried."""
    for path in (live, copy + ".gz", copy):
        if exists(spark, path):
            return spark.read.schema(schema).json(path)
    raise FileNotFoundError(f"neither {live} nor {copy}.gz nor {copy} exists")


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, all strings; a byte-order mark is taken off the first name."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value rows of one JSON object per file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a packed stream: split, key, ordinal, offset of its records."""
    return spark.read.schema("split string, sid string, ordinal long, offset long").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Call-log rows of JSON lines; the file is the call."""
    from floorline.operators.calllog import SCHEMA

    rows = spark.read.schema(", ".join(c for c in SCHEMA.split(", ") if not c.startswith("call "))).json(path)
    return rows.withColumn("call", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[A-Za-z0-9.]+$", 1))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, length of the files under a folder, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def newest(files: DataFrame, but: str = "selftest") -> DataFrame:
    """The latest file whose name does not hold `but`."""
    return files.where(~F.col("path").contains(but)).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def only_existing(rows: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Rows whose key is the name, without extension, of a listed file."""
    names = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias(key)).distinct()
    return rows.join(names, key, "left_semi")


def checked_digest(files: DataFrame, expected: str) -> DataFrame:
    """path, ok: whether a binary file's SHA-256 is the pinned one (files from a binaryFile read)."""
    return files.select("path", (F.sha2("content", 256) == expected).alias("ok"))


def complete_calls(segments: DataFrame) -> DataFrame:
    """Segments (with base, side) of the calls that have both legs."""
    both = segments.where(F.col("side").isNotNull()).groupBy("base").agg(F.count_distinct("side").alias("n")).where("n = 2")
    return segments.join(both.select("base"), "base", "left_semi")
