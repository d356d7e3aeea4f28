"""The batch operators on streams.

Column checks and row rules keep no state and run inside the stream. What must be remembered across batches, claimed values and
successful hashes, is keyed state: a running count for each value or hash, in the stream's own state store (RocksDB with the
settings of `session.tune`). Each batch gets, beside its rows, the running totals of the values that it holds, and of no other;
so what a batch costs goes with the batch and not with the history. A value is new in a batch if its total equals its count in the
batch. A replayed batch starts from the state of the batch before it, so a restart neither loses nor doubles anything.

The tables of claims and of hashes are records, one Parquet partition per batch, overwritten on replay; no batch reads them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from rowpact.contract import Contract
from rowpact.operators.lookup import counted_join
from rowpact.operators.summary import validation_summary
from rowpact.operators.uniqueness import candidates, flag_duplicates, owned_bits
from rowpact.operators.validate import (
    append_duplicates,
    apply_row_rules,
    check_columns,
    pinned,
    validate,
)

CLAIMS_SCHEMA = "_key int, _value string, _owner_row bigint"


def validate_stream(
    stream: DataFrame, contract: Contract, as_of: Column | dt.date | str | None = None,
    row: str = "row",
) -> DataFrame:
    """Checks and row rules on a stream; uniqueness needs `unique_stream`."""
    return validate(stream, replace(contract, uniqueness=()), as_of, row)


def summarize_stream(validated: DataFrame) -> DataFrame:
    """Running counters (output mode `complete`)."""
    return validation_summary(validated)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available into a Parquet table, exactly once, then stop."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def write_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the latest complete result of a streaming aggregate in a table."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    _run(stream, on_batch, checkpoint, "complete")


def unique_stream(
    stream: DataFrame,
    contract: Contract,
    out: str,
    claims: str,
    checkpoint: str,
    as_of: Column | dt.date | str | None = None,
    row: str = "row",
) -> None:
    """Full validation of a stream into the table `out`; the first batch to show a value keeps it, within a batch the least row.

    Which values are new is told by their running counts, summed map-side before they are shuffled. Owners of new values go
    back to the rows by row number, so a value of a third of all rows spreads evenly.
    """
    keys = contract.unique_keys
    flags = [f"_dup_{i}" for i in range(len(keys))]
    clean = F.size("errors") == 0
    rows = check_columns(stream, contract, as_of, row)

    def prints(frame: DataFrame) -> DataFrame:
        claimed = candidates(frame, keys, clean, row)
        return claimed.withColumn("_print", F.unhex(F.sha2("_value", 256)))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            checked, totals = _parted(batch, ["_key", "_print"]) if keys else (batch, None)
            if keys:
                owners = prints(checked).groupBy("_key", "_value", "_print").agg(
                    F.min("_row").alias("_owner_row"), F.count(F.lit(1)).alias("_claims"))
                new = owners.join(totals, ["_key", "_print"]).filter(F.col("_claims") == F.col("_total"))
                mine = f"{claims}/batch={batch_id}"
                new.select("_key", "_value", F.col("_owner_row").cast("bigint")).write.mode("overwrite").parquet(mine)
                owned = owned_bits(spark.read.schema(CLAIMS_SCHEMA).parquet(mine))
                flagged = flag_duplicates(checked, keys, clean, row, flags, owned)
                checked = append_duplicates(flagged, keys, flags, row)
            if contract.row_rules:
                checked = apply_row_rules(checked, contract.row_rules, as_of, row)
            result = checked.withColumn("valid", pinned(F.size("errors") == 0))
            result.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    if keys:
        rows = _with_totals(rows, prints(rows).groupBy("_key", "_print").agg(F.count(F.lit(1)).alias("_total")))
    _run(rows, on_batch, checkpoint, "update" if keys else "append")


def resume_stream(
    stream: DataFrame, out: str, hashes: str, checkpoint: str, row: str = "row"
) -> None:
    """Skip requests whose hash has already succeeded, in an earlier batch or an earlier row.

    `stream` has the row, `request_hash` and `success`. Only successes are counted, so a failed request may be tried
    again. A hash was done before a batch if it has more successes than those of the batch.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows, totals = _parted(batch, ["request_hash"])
            here = rows.filter("request_hash IS NOT NULL").groupBy("request_hash").agg(
                F.count(F.lit(1)).alias("_n"), F.count_if("success").alias("_successes"),
                F.min(F.when(F.col("success"), F.col(row))).alias("_first"))
            facts = here.join(totals, "request_hash").filter("_total > 0").withColumn("_done", F.col("_total") > F.col("_successes"))
            seen = counted_join(rows, facts, "request_hash", ["_done", "_first"], "_n", row)
            skipped = F.coalesce(F.col("_done") | (F.col("_first") < F.col(row)), F.col("_done"), F.lit(False))
            result = seen.withColumn("skipped", skipped).drop("_done", "_first")
            result.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            # The first success of a hash that was not done before is never skipped.
            facts.filter("NOT _done").select("request_hash").write.mode("overwrite").parquet(f"{hashes}/batch={batch_id}")
        finally:
            batch.unpersist()

    totals = stream.filter("request_hash IS NOT NULL").groupBy("request_hash").agg(F.count_if("success").alias("_total"))
    _run(_with_totals(stream, totals), on_batch, checkpoint, "update")


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """The rows of a stream and, in the same batch, the running totals (`_total`) of the keys that the batch holds."""
    return rows.unionByName(totals, allowMissingColumns=True)


def _parted(batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch, without the columns that only totals have, and its totals."""
    added = ["_total", *[k for k in keys if k.startswith("_")]]
    rows = batch.filter("_total IS NULL").drop(*added)
    return rows, batch.filter("_total IS NOT NULL").select(*keys, "_total")


def _run(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> None:
    (
        stream.writeStream.foreachBatch(on_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
