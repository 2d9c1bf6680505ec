"""A place for intermediate files that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_parts: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="floorline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which goes when the application ends."""
    part = f"{shared_dir(spark)}/floorline-{spark.sparkContext.applicationId}"
    if part not in _parts:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _parts.add(part)
    return f"{part}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
