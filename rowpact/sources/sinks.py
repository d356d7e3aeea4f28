"""Logs, reports and exports. Each table is a DataFrame first; writing it is one more call."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from rowpact.contract import Contract
from rowpact.fixed_values import (
    FAILED_REASON_COLUMN,
    REASON_VALIDATION,
    REQUEST_ERROR_COLUMNS,
    SENT_COLUMNS,
    VALIDATION_LOG_COLUMNS,
    VALIDATION_REPORT_COLUMNS,
)
from rowpact.operators.masking import mask_column_value, mask_named
from rowpact.operators.outcome import failure_reason
from rowpact.operators.request import request_json
from rowpact.operators.summary import ContractViolation, summary_counters
from rowpact.operators.validate import RAW, error_rows
from rowpact.sources.staging import release, staging_path

_LOGGED = ("success", "failed", "validation_error", "template_error")


def validation_report(
    validated: DataFrame, contract: Contract, at: Column, mask_secrets: bool = True
) -> DataFrame:
    """One line per error. `at` is the time of the report."""
    value = F.col("value")
    if mask_secrets:
        value = mask_column_value(F.col("column"), value, contract)
    return error_rows(validated).select(
        at.alias("timestamp"), "row", "column", value.alias("value"), "message"
    ).select(*VALIDATION_REPORT_COLUMNS)


def validation_log(validated: DataFrame, contract: Contract, at: Column) -> DataFrame:
    """The run's log of validation errors, values masked."""
    value = mask_column_value(F.col("column"), F.col("value"), contract)
    return error_rows(validated).select(
        at.alias("ts"), "row", "column", value.alias("value"), "message"
    ).select(*VALIDATION_LOG_COLUMNS)


def sent_log(outcomes: DataFrame, contract: Contract, at: Column) -> DataFrame:
    """One line per row that was sent or failed before sending; skipped rows leave no trace."""
    secrets = contract.secret_names
    return outcomes.filter(F.col("outcome").isin(*_LOGGED)).select(
        F.coalesce(F.col("ts").cast("string"), at).alias("ts"),
        "row",
        "request_id",
        "status_code",
        "success",
        "latency_ms",
        "retries",
        "error_category",
        mask_named(F.col("error_detail"), secrets).alias("error_detail"),
        mask_named(F.col("response_preview"), secrets).alias("response_preview"),
        F.coalesce("request_hash", F.lit("")).alias("request_hash"),
    ).select(*SENT_COLUMNS)


def request_error_log(outcomes: DataFrame, contract: Contract, at: Column) -> DataFrame:
    return sent_log(outcomes, contract, at).filter("NOT success").select(*REQUEST_ERROR_COLUMNS)


def failed_rows(outcomes: DataFrame, contract: Contract, legacy: bool = False) -> DataFrame:
    """Rows to process again, in their original form, with the reason.

    `legacy` writes processed values (failed columns blank) and lists an invalid row twice,
    as validation_failed and as validation_error.
    """
    reason = failure_reason()
    failed = outcomes.withColumn("_reason", reason).filter(F.col("_reason").isNotNull())
    if not legacy:
        return failed.select(
            *[F.col(f"`{RAW}{n}`").alias(n) for n in contract.names],
            F.col("_reason").alias(FAILED_REASON_COLUMN))
    reasons = F.when(
        F.col("_reason") == REASON_VALIDATION,
        F.array(F.lit(REASON_VALIDATION), F.lit("validation_error"))
    ).otherwise(F.array("_reason"))
    return failed.select(
        *[F.col(f"`_data_{n}`").alias(n) for n in contract.names],
        F.explode(reasons).alias(FAILED_REASON_COLUMN))


def preview_jsonl(rendered: DataFrame, escape_html: bool = True) -> DataFrame:
    return rendered.select(request_json(escape_html).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, blanks survive, an empty field stays empty."""
    (
        df.write.mode("overwrite")
        .options(header=True, quote='"', escape='"', emptyValue="", nullValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def write_report(
    validated: DataFrame, contract: Contract, path: str, at: Column, mask_secrets: bool = True, strict: bool = False
) -> dict[str, int]:
    """Writes the validation report; the summary's counters, taken in the same pass over the rows.

    The rows are counted where they are written from, in the job's last stage, whose tasks Spark counts once each, whatever was run again.
    With `strict` a table with invalid rows raises when its report has been written.
    """
    seen = Observation()
    report = validation_report(validated.observe(seen, *summary_counters()), contract, at, mask_secrets)
    write_csv(report, path)
    counters = dict(seen.get)
    if strict and counters["invalid"]:
        raise ContractViolation(f"{counters['invalid']} of {counters['total']} rows violate the contract, see {path}")
    return counters


def write_csv_if_any(df: DataFrame, path: str) -> bool:
    """Write only when there is something to write."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def write_jsonl(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


LOGS = ("sent", "request_errors", "validate_errors", "failed_rows")
#: The file that names the attempt which readers see.
COMMITTED = "_committed"


def _write_all(validated: DataFrame, outcomes: DataFrame, contract: Contract, directory: str, at: Column) -> list[str]:
    """Writes each log below the directory and returns the names of those written.

    Both inputs feed several logs. They are written once to the shared folder and read from there, so an executor that is lost
    takes nothing with it that must be computed again.
    """
    spark = validated.sparkSession
    staged = staging_path(spark, "run")

    def once(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{staged}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{staged}/{name}")

    try:
        validated, outcomes = once(validated, "validated"), once(outcomes, "outcomes")
        write_csv(sent_log(outcomes, contract, at), f"{directory}/sent")
        write_csv(request_error_log(outcomes, contract, at), f"{directory}/request_errors")
        write_csv(validation_log(validated, contract, at), f"{directory}/validate_errors")
        any_failed = write_csv_if_any(failed_rows(outcomes, contract), f"{directory}/failed_rows")
    finally:
        release(spark, staged.rpartition("/")[0])
    return [name for name in LOGS if any_failed or name != "failed_rows"]


def write_logs(
    validated: DataFrame, outcomes: DataFrame, contract: Contract, directory: str, at: Column
) -> None:
    """All tables of a run, one after the other, each in a folder of its own. See `commit_logs` for all or none."""
    _write_all(validated, outcomes, contract, directory, at)


def commit_logs(
    validated: DataFrame, outcomes: DataFrame, contract: Contract, directory: str, at: Column
) -> dict[str, str]:
    """All tables of a run as one commit: `committed` shows every one of them, or the run before.

    The tables go to a folder of this attempt. A file that names the attempt and its tables replaces the last such file by one rename
    when all are written. What fails before that leaves nothing that readers see. Returns what `committed` does.
    """
    spark = validated.sparkSession
    attempt = f"attempt-{uuid.uuid4().hex}"
    done = False
    try:
        tables = _write_all(validated, outcomes, contract, f"{directory}/{attempt}", at)
        _replace(spark, f"{directory}/{COMMITTED}", json.dumps({"attempt": attempt, "tables": tables}))
        done = True
    finally:
        if not done:
            release(spark, f"{directory}/{attempt}")
    return committed(spark, directory)


def committed(spark: SparkSession, directory: str) -> dict[str, str]:
    """Name and path of each table of the last committed run; empty before the first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{directory}/{COMMITTED}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    stream = files.open(path)
    try:
        said = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return {name: f"{directory}/{said['attempt']}/{name}" for name in said["tables"]}


def read_log(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the last committed run, as text columns."""
    if name not in LOGS:
        raise ValueError(f"no such log: {name}")
    path = committed(spark, directory).get(name)
    if path is None:
        raise FileNotFoundError(f"no committed run in {directory} has a table {name}")
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)


def expire_attempts(spark: SparkSession, directory: str) -> int:
    """Removes the folders of attempts that are not the committed one; not while another attempt is being written."""
    current = {path.split("/")[-2] for path in committed(spark, directory).values()}
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in files.listStatus(path) if x.getPath().getName().startswith("attempt-") and x.getPath().getName() not in current]
    for x in old:
        files.delete(x, True)
    return len(old)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it over the one that is there."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    target, other = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = other.getFileSystem(settings).create(other, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(settings).getUri(), settings)
    files.rename(other, target, how)
