"""Summaries of validations and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowpact.fixed_values import FIRST_ERRORS
from rowpact.operators.validate import error_rows


class ContractViolation(RuntimeError):
    """The strict gate found errors."""


def summary_counters() -> list[Column]:
    """What a validation's summary counts, over validated rows."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("error_count"),
    ]


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(*summary_counters())


def first_errors(validated: DataFrame, n: int = FIRST_ERRORS) -> DataFrame:
    """The first errors in row order, then in the order within the row (a bounded top-n)."""
    return error_rows(validated).orderBy("row", "pos").limit(n)


def strict_gate(validated: DataFrame) -> DataFrame:
    """Raise if any row is invalid, else hand the rows on. Stops at the first invalid row."""
    if not validated.filter("NOT valid").isEmpty():
        raise ContractViolation("the table violates its contract")
    return validated


def gate_status(validated: DataFrame) -> DataFrame:
    """The gate's verdict as a row, for jobs that record it rather than stop."""
    bad = F.count_if(~F.col("valid"))
    return validated.agg((bad == 0).alias("passed"), bad.alias("invalid"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of a run, from `row_states` or `row_outcomes`. Template errors are neither successes nor failures."""
    state = F.col("outcome")
    first, last = F.min("started_at"), F.max("ts")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "success").alias("success"),
        F.count_if(state.isin("failed", "validation_error")).alias("failed"),
        F.count_if(state == "skipped").alias("skipped"),
        F.count_if(state == "template_error").alias("template_errors"),
        F.count_if(state == "pending").alias("pending"),
        first.alias("start"),
        last.alias("end"),
        F.floor((last - first).cast("interval second").cast("decimal(20,6)") * 1000)
        .cast("bigint").alias("duration_ms"),
    )


def progress(outcomes: DataFrame) -> DataFrame:
    """Share of rows that have been dealt with, from `row_states` or `row_outcomes`."""
    done = F.count_if(F.col("outcome") != "pending")
    total = F.count(F.lit(1))
    share = F.when(total == 0, F.lit(0.0)).otherwise(done / total)
    return outcomes.agg(done.alias("processed"), total.alias("total"), share.alias("fraction"))
