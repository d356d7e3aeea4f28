"""Session settings that suit contract workloads. All can be changed on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Check chains compile into long methods. The JVM does not optimise methods above 8,000
    # bytes of bytecode, so Spark should fall back to split projections there.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort where every build partition turned out small at run time.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # State of streams on disk, and commits that go with what a batch changed.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Long texts: what a Python task gets at once is bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16MB",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
