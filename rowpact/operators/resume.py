"""Resume: which requests are already done, by idempotency hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowpact.operators.lookup import counted_join, lookup_join


def flag_processed(requests: DataFrame, checkpoint: DataFrame, row: str = "row") -> DataFrame:
    """Add `processed`: the hash is in the checkpoint table."""
    done = checkpoint.select("request_hash").distinct().withColumn("_done", F.lit(True))
    flagged = lookup_join(requests, done, "request_hash", ["_done"], row)
    return flagged.withColumn("processed", F.coalesce("_done", F.lit(False))).drop("_done")


def hash_facts(rows: DataFrame, success: str, checkpoint: DataFrame | None = None, row: str = "row") -> DataFrame:
    """(request_hash, _first_success, _done, _rows): all that is known about each hash that has succeeded or is done, and how
    many rows have it. One aggregate, combined before the shuffle; `rows` has the hash, the row and whether it succeeded."""
    facts = rows.filter(F.col("request_hash").isNotNull()).select(
        "request_hash", F.when(F.col(success), F.col(row)).alias("_first_success"), F.lit(False).alias("_done"),
        F.lit(1).alias("_rows"))
    if checkpoint is not None:
        done = checkpoint.filter(F.col("request_hash").isNotNull()).select(
            "request_hash", F.lit(None).cast(facts.schema["_first_success"].dataType).alias("_first_success"),
            F.lit(True).alias("_done"), F.lit(0).alias("_rows"))
        facts = facts.unionByName(done)
    return (
        facts.groupBy("request_hash")
        .agg(F.min("_first_success").alias("_first_success"), F.bool_or("_done").alias("_done"), F.sum("_rows").alias("_rows"))
        .filter((F.col("_rows") > 0) & (F.col("_done") | F.col("_first_success").isNotNull()))
    )


def pending_requests(requests: DataFrame, checkpoint: DataFrame, row: str = "row") -> DataFrame:
    """Requests still to be sent (anti join on the hash)."""
    return flag_processed(requests, checkpoint, row).filter("NOT processed").drop("processed")


def skipped_requests(requests: DataFrame, checkpoint: DataFrame, row: str = "row") -> DataFrame:
    """Requests already done (semi join on the hash)."""
    return flag_processed(requests, checkpoint, row).filter("processed").drop("processed")


def flag_repeated(outcomes: DataFrame, success: str = "success", row: str = "row") -> DataFrame:
    """Add `repeated`: an earlier row with the same hash has succeeded in this run."""
    flagged = counted_join(outcomes, hash_facts(outcomes, success, row=row), "request_hash", ["_first_success"], "_rows", row)
    later = F.coalesce(F.col("_first_success") < F.col(row), F.lit(False))
    return flagged.withColumn("repeated", later).drop("_first_success")


def checkpoint_set(outcomes: DataFrame) -> DataFrame:
    """Hashes to remember: those of successful rows."""
    return outcomes.filter("success").select("request_hash").distinct()


def append_checkpoint(outcomes: DataFrame, path: str) -> None:
    """Add this run's successful hashes to the checkpoint table."""
    checkpoint_set(outcomes).write.mode("append").parquet(path)
