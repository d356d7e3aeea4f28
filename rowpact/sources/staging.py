"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: The session's own name for the folder, where spark.checkpoint.dir is not set (a running session cannot set that).
STAGING_SETTING = "rowpact.staging.dir"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by `spark.checkpoint.dir`, or else by `rowpact.staging.dir`.

    Without either there is no place that driver and executors are known to share, so this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGING_SETTING, None)
    if not base:
        raise RuntimeError(f"set spark.checkpoint.dir or {STAGING_SETTING} to a folder that all executors can reach")
    return f"{base.rstrip('/')}/rowpact-{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession, path: str) -> None:
    """Removes a staged table when what reads it is done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for an input that arrives in fewer partitions than there are cores.

    One row group, a compressed file or a multi-line CSV is read by one task, and checks cost
    more than moving the rows. Inputs with enough partitions are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
