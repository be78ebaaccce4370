"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_dir: str | None = None


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder that spark.checkpoint.dir names and read it back; this cuts its lineage.

    Only a session that names no folder (tests in local mode) gets a temporary one.
    """
    global _own_dir
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="textindex-")
        root = _own_dir
    path = f"{root.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file is one partition, and folds follow partitions.

    Inputs that already have as many, so all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
