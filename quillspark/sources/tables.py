"""The tables of a folder of Parquet files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table. Long texts that come in fewer pieces than there are cores (a file with one row group) are dealt out."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < cores else found


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own where the driver and all executors write: in spark.checkpoint.dir, or a local one in a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="quillspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in such a folder, for what is read several times; a lost executor loses nothing of it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
