"""Responses folded back onto requests: success, error classes, retries, row outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowpact.contract import Contract
from rowpact.fixed_values import (
    CATEGORY_TEMPLATE,
    CATEGORY_UNKNOWN,
    CATEGORY_VALIDATION,
    DEFAULT_SUCCESS_STATUS,
    DETAIL_VALIDATION,
    ERROR_CATEGORIES,
    MAX_RETRIES,
    PREVIEW_CHARS,
    REASON_REQUEST,
    REASON_VALIDATION,
    TOO_MANY_REQUESTS,
)
from rowpact.functions.scalars import json_valid
from rowpact.operators.lookup import counted_join
from rowpact.operators.request import RequestSpec, request_id
from rowpact.operators.resume import hash_facts
from rowpact.operators.validate import RAW


def status_success(status: Column, status_in: Sequence[int] = DEFAULT_SUCCESS_STATUS) -> Column:
    return status.isin(*(status_in or DEFAULT_SUCCESS_STATUS))


def response_keys_match(body: Column, expected: Mapping[str, str]) -> Column:
    """The body is one strict JSON object and each key prints as expected; of a key that repeats the last counts."""
    fields = F.map_entries(F.from_json(body, "map<string,string>"))

    def last(key: str) -> Column:
        return F.get(F.reverse(F.filter(fields, lambda x: x["key"] == key)), 0)["value"]

    match = json_valid(body)
    for key, value in expected.items():
        match &= F.coalesce(last(key) == value, F.lit(False))
    return match


def response_success(status: Column, body: Column, spec: RequestSpec) -> Column:
    ok = status_success(status, spec.status_in)
    if spec.response_keys:
        ok &= response_keys_match(body, spec.response_keys)
    return ok


def error_category(error: Column) -> Column:
    """Class of an error text, first match in order; '' without an error."""
    category = F.when(F.coalesce(error, F.lit("")) == "", F.lit(""))
    for needle, name in ERROR_CATEGORIES:
        category = category.when(error.contains(needle), F.lit(name))
    return category.otherwise(F.lit(CATEGORY_UNKNOWN))


def response_preview(body: Column) -> Column:
    return F.when(F.length(body) <= PREVIEW_CHARS, body).otherwise(
        F.concat(F.substring(body, 1, PREVIEW_CHARS), F.lit("...")))


def retryable(status: Column) -> Column:
    return (status == 0) | status.between(500, 599) | (status == TOO_MANY_REQUESTS)


def first_header(headers: Column) -> Column:
    """First value per header; headers without values are left out."""
    filled = F.map_filter(headers, lambda _, values: F.size(values) > 0)
    return F.transform_values(filled, lambda _, values: values[0])


def collapse_attempts(
    attempts: DataFrame,
    spec: RequestSpec,
    key: str = "row",
    order: Sequence[str] = ("ts",),
    max_retries: int = MAX_RETRIES,
    retry_http_status: bool = False,
    started: str | None = None,
) -> DataFrame:
    """One row per request: its final attempt.

    `attempts` has the key, `ts` (when the attempt ended), `status_code`, `error`, `body` and
    `headers`. `started` names the column that says when an attempt began; latency counts from the first
    attempt's. Without it latency counts from the first attempt's end, so a single attempt takes 0 ms. The sequence ends with the first attempt that had no transport error, or one
    that is not worth repeating, or with the last retry. The latest error class sticks.

    Only the first `max_retries + 1` attempts can matter. The filter on the row number makes
    Spark keep just those per key and map task (WindowGroupLimit) before the shuffle, so a
    key with a third of all attempts sends a handful of rows.
    """
    in_order = Window.partitionBy(key).orderBy(*order)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    error = F.coalesce("error", F.lit(""))
    again = retryable(F.col("status_code"))
    repeats = again if retry_http_status else (error != "") & again
    tried = (
        attempts.withColumn("_n", F.row_number().over(in_order))
        .filter(F.col("_n") <= max_retries + 1)
    )
    last_attempt = F.coalesce(
        F.min(F.when(~repeats, F.col("_n"))).over(whole), F.max("_n").over(whole))
    sticky = F.when(error != "", F.struct(error.alias("error")))
    windowed = tried.select(
        "*",
        last_attempt.alias("_final"),
        F.first(started or "ts").over(so_far).alias("_started"),
        F.last(sticky, ignorenulls=True).over(so_far).alias("_sticky"),
    )
    final = windowed.filter(F.col("_n") == F.col("_final"))
    detail = F.coalesce(F.col("_sticky.error"), F.lit(""))
    body = F.coalesce("body", F.lit(""))
    elapsed = (F.col("ts") - F.col("_started")).cast("interval second").cast("decimal(20,6)")
    return final.select(
        key,
        F.col("_started").alias("started_at"),
        "ts",
        "status_code",
        ((error == "") & response_success(F.col("status_code"), body, spec)).alias("success"),
        F.floor(elapsed * 1000).cast("bigint").alias("latency_ms"),
        (F.col("_n") - 1).cast("int").alias("retries"),
        error_category(detail).alias("error_category"),
        detail.alias("error_detail"),
        F.when(error == "", response_preview(body)).otherwise(F.lit("")).alias("response_preview"),
        first_header("headers").alias("headers"),
    )


def row_states(
    requests: DataFrame,
    responses: DataFrame,
    checkpoint: DataFrame | None = None,
    row: str = "row",
) -> DataFrame:
    """What became of each input row, without the row's own columns: all that summaries and progress need.

    `requests` is `render(validate(...))`, best read back from a written table; only its row, hash and verdicts are read, twice.
    `responses` has one row per request (see `collapse_attempts`). Rows whose hash is in
    `checkpoint`, or equals that of an earlier successful row, count as skipped. A valid row
    without a response is `pending`.

    Verdicts meet responses by row. What is known of each hash is one aggregate of them, which also says how many rows have it,
    so that frequent hashes are spread without a job of their own.
    """
    base = requests.select(row, F.when(F.col("valid"), F.col("request.request_hash")).alias("request_hash"), "valid", "rendered")
    answered = base.join(responses, row, "left")
    succeeded = F.col("valid") & F.col("rendered") & F.coalesce("success", F.lit(False))
    facts = hash_facts(answered.select(row, "request_hash", succeeded.alias("_ok")), "_ok", checkpoint, row)
    flagged = counted_join(answered, facts, "request_hash", ["_first_success", "_done"], "_rows", row)
    repeated = F.coalesce(F.col("_first_success") < F.col(row), F.lit(False))
    processed = F.coalesce("_done", F.lit(False))
    outcome = (
        F.when(~F.col("valid"), F.lit(CATEGORY_VALIDATION))
        .when(processed | repeated, F.lit("skipped"))
        .when(~F.col("rendered"), F.lit(CATEGORY_TEMPLATE))
        .when(F.col("success").isNull(), F.lit("pending"))
        .when(F.col("success"), F.lit("success"))
        .otherwise(F.lit("failed"))
    )
    sent = F.col("outcome").isin("success", "failed")
    named = flagged.withColumn("outcome", outcome)
    category = (
        F.when(F.col("outcome").isin(CATEGORY_VALIDATION, CATEGORY_TEMPLATE), F.col("outcome"))
        .when(sent, F.col("error_category")).otherwise(F.lit("")))
    detail = (
        F.when(F.col("outcome") == CATEGORY_VALIDATION, F.lit(DETAIL_VALIDATION))
        .when(sent, F.col("error_detail")).otherwise(F.lit("")))
    return named.select(
        row,
        "request_hash",
        "outcome",
        F.when(sent, F.col("status_code")).otherwise(F.lit(0)).cast("int").alias("status_code"),
        (F.col("outcome") == "success").alias("success"),
        F.when(sent, F.col("latency_ms")).otherwise(F.lit(0)).cast("bigint").alias("latency_ms"),
        F.when(sent, F.col("retries")).otherwise(F.lit(0)).cast("int").alias("retries"),
        category.alias("error_category"),
        detail.alias("error_detail"),
        F.when(sent, F.col("response_preview")).otherwise(F.lit("")).alias("response_preview"),
        F.when(sent, F.col("headers")).alias("headers"),
        F.when(sent, F.col("started_at")).alias("started_at"),
        F.when(sent, F.col("ts")).alias("ts"),
    )


def row_outcomes(
    requests: DataFrame,
    responses: DataFrame,
    contract: Contract,
    checkpoint: DataFrame | None = None,
    row: str = "row",
) -> DataFrame:
    """One line per input row with what became of it (see `row_states`), its raw and its processed values.

    The wide columns take no part in finding that out: they are joined once, at the end, by row number, which is unique.
    """
    states = row_states(requests, responses, checkpoint, row)
    wide = requests.select(
        F.col(row).alias("_own_row"),
        request_id(contract.names, row).alias("request_id"),
        *[F.col(f"`{RAW}{n}`") for n in contract.names],
        *[F.col(f"`{n}`").alias(f"_data_{n}") for n in contract.names],
    )
    joined = wide.join(states, F.col("_own_row") == F.col(row))
    return joined.select(
        row, "request_id", *[c for c in states.columns if c != row],
        *[F.col(f"`{RAW}{n}`") for n in contract.names],
        *[F.col(f"`_data_{n}`") for n in contract.names],
    )


def failure_reason() -> Column:
    """Why a row failed; NULL for rows that did not fail."""
    state = F.col("outcome")
    return (
        F.when(state == CATEGORY_VALIDATION, F.lit(REASON_VALIDATION))
        .when(state == CATEGORY_TEMPLATE, F.lit(CATEGORY_TEMPLATE))
        .when(state == "failed",
              F.coalesce(F.nullif("error_category", F.lit("")), F.lit(REASON_REQUEST)))
    )
