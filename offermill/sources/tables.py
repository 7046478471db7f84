"""Versioned Parquet tables and append-only logs.

A table version is a folder that is written once under the number of the batch that made
it; running a batch again overwrites the same folder, so retries change nothing.
"""

from __future__ import annotations

import dataclasses
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version_path(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/version={version}"


def write_version(df: DataFrame, root: str, name: str, version: int) -> str:
    path = version_path(root, name, version)
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(version_path(root, name, version))


def write_state(state, root: str, version: int):
    """Write every table of a state dataclass as one version and give it back as read.

    Reading the written version also cuts the lineage between batches.
    """
    for f in dataclasses.fields(state):
        write_version(getattr(state, f.name), root, f.name, version)
    spark = getattr(state, dataclasses.fields(state)[0].name).sparkSession
    return dataclasses.replace(state, **{f.name: read_version(spark, root, f.name, version) for f in dataclasses.fields(state)})


def append_batch(df: DataFrame, root: str, name: str, batch: int) -> None:
    """One batch of an append-only log."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch={batch}")


def read_log(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches of a log, or those before one; the batch number prunes folders."""
    base = f"{root.rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], f"{schema}, batch int")
    log = spark.read.schema(f"{schema}, batch int").option("basePath", base).parquet(base)
    return log if before is None else log.filter(F.col("batch") < before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors reach: under spark.checkpoint.dir, or local in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        name = spark._jvm.java.util.UUID.randomUUID().toString()
        return f"{shared.rstrip('/')}/offermill-{name}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
