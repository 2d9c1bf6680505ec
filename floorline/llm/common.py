"""Shared helpers of the subpackage: shared-folder tables, code shipping, folds and label sampling."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floorline.sources.scratch import stored  # noqa: F401

#: Rows and bytes of one Arrow batch; long texts make row counts alone a poor bound.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and give the executors this package, whatever their import path is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="floorline-"), "floorline_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("floorline", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever the case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def labelled(labels: DataFrame, column: str, keep: Column) -> DataFrame:
    """(doc_id, y): one row per labelled id that passes keep.

    Null ids and labels are left out; of conflicting labels the larger wins.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep)
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def labelled_sample(labels: DataFrame, column: str, keep: Column, most: int) -> DataFrame:
    """The rows of labelled, thinned by id hash to about `most` rows.

    The thinning takes ids whose hash falls under most / count, so its expected size is `most` at any
    input size.
    """
    rows = labelled(labels, column, keep)
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def text_map(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with the driver's package shipped; work takes and yields record batches."""
    prepare(df.sparkSession)
    return df.mapInArrow(work, schema)


