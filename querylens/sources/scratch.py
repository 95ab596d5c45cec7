"""Intermediate tables in the folder that driver and executors share, and inputs spread over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this machine only where a local session has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_querylens_scratch", None)
    if own is None:
        own = spark.sparkContext._querylens_scratch = "file://" + tempfile.mkdtemp(prefix="querylens-")
    return own


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage is cut, and later plans scan it."""
    path = f"{shared_dir(df.sparkSession)}/querylens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_alone(df: DataFrame, label: str) -> DataFrame:
    """``saved``, and the write's own shuffle files are removed when it ends: nothing reads them again.

    They would stay until the driver collects its garbage, so those of all steps would lie on the disks together.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return saved(df, label)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file is one partition otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
