"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowpact.contract import Bounds, CleanseRule, ColumnSpec, Contract
from rowpact.functions import scalars
from rowpact.functions.layouts import format_date, parse_date
from rowpact.operators import checks, cleanse, outcome, request, resume, summary
from rowpact.operators.masking import mask_column_value, mask_named
from rowpact.operators.uniqueness import flag_duplicates, flag_in_place
from rowpact.operators.validate import (
    RAW,
    check_columns,
    error_rows,
    invalid_rows,
    rule_condition,
    typed,
    valid_rows,
    validate,
)
from rowpact.plans.frames import (
    AS_OF,
    CUSTOMERS,
    ORDERS,
    SIGNUP,
    attempts,
    customer_raw,
    date_texts,
    docs_raw,
    number_texts,
    orders_raw,
    stamp_texts,
    table,
)
from rowpact.sources import csv as csv_source, sinks
from rowpact.sources.staging import staging_path
from rowpact.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REPORT_TIME = "2000-06-30T00:00:00Z"
DOC_PATTERN = r"(?i)\b(?:licen[sc]e|copyright|email)\b|[.!?]\s+the\b|[a-zäöü]+\.$"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def named(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


def orders_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(orders_raw(spark, sf_dir), ORDERS, AS_OF)


def customers_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(customer_raw(spark, sf_dir), CUSTOMERS, AS_OF)


def signup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request.render(customers_validated(spark, sf_dir), SIGNUP, CUSTOMERS)


def flat_requests(rendered: DataFrame) -> DataFrame:
    return rendered.select(
        "row", "request.method", "request.url",
        F.to_json("request.headers").alias("headers"), "request.body", "request.proxy",
        "request.request_hash")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.collapse_attempts(attempts(spark, sf_dir), SIGNUP, order=("ts", "event_id"))


def staged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered requests as a written table, the way a sender would get them."""
    path = staging_path(spark, "requests")
    signup_requests(spark, sf_dir).drop("errors").write.parquet(path)
    return spark.read.parquet(path)


def earlier_hashes(requests: DataFrame, sf_dir: str) -> DataFrame:
    """A checkpoint: the requests of customers from the first region's nations."""
    spark = requests.sparkSession
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(
        F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left_semi").select(
        (F.col("c_custkey") + 1).alias("row"))
    return requests.filter("valid").join(rows, "row", "left_semi").select("request.request_hash")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = staged_requests(spark, sf_dir)
    return outcome.row_outcomes(
        requests, responses(spark, sf_dir), CUSTOMERS, earlier_hashes(requests, sf_dir))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the rows' own columns."""
    requests = staged_requests(spark, sf_dir)
    return outcome.row_states(requests, responses(spark, sf_dir), earlier_hashes(requests, sf_dir))


def one_check(df: DataFrame, spec: ColumnSpec, column: str) -> DataFrame:
    """row and message of one column's checks; '' where it passes."""
    value = F.col(column)
    return df.select(
        "row", F.coalesce(checks.first_error(value, value, spec, AS_OF), F.lit("")).alias("message"))


# --- scans and sources -----------------------------------------------------------------

def _orders_csv(spark: SparkSession, sf_dir: str) -> str:
    """The order rows as a CSV table, sorted by row across files."""
    path = staging_path(spark, "orders_csv")
    ordered = orders_raw(spark, sf_dir).repartitionByRange("row").sortWithinPartitions("row")
    sinks.write_csv(ordered.select(*ORDERS.names), path)
    return path


@query
def csv_scan(spark, sf_dir):
    return csv_source.read_csv(spark, _orders_csv(spark, sf_dir), ORDERS)


@query
def header_check(spark, sf_dir):
    return csv_source.header_report(spark, _orders_csv(spark, sf_dir), ORDERS)


@query
def row_number(spark, sf_dir):
    numbered = csv_source.read_numbered_csv(spark, _orders_csv(spark, sf_dir), ORDERS)
    return numbered.select("row", "orderkey")


@query
def row_count(spark, sf_dir):
    return csv_source.count_rows(spark, _orders_csv(spark, sf_dir), ORDERS)


@query
def preview_head(spark, sf_dir):
    return csv_source.head_rows(orders_raw(spark, sf_dir), 10)


@query
def request_id(spark, sf_dir):
    return orders_raw(spark, sf_dir).select(
        "row", request.request_id(ORDERS.names, prefix="").alias("request_id"))


@query
def validate_fold(spark, sf_dir):
    return summary.validation_summary(customers_validated(spark, sf_dir)).select(
        "total", "valid", "error_count")


@query
def validation_report(spark, sf_dir):
    return sinks.validation_report(orders_validated(spark, sf_dir), ORDERS, F.lit(REPORT_TIME))


@query
def preview_jsonl(spark, sf_dir):
    return sinks.preview_jsonl(valid_rows(signup_requests(spark, sf_dir))).select(
        F.sha2("value", 256).alias("line_hash"), F.length("value").alias("line_length"))


@query
def sent_log(spark, sf_dir):
    return sinks.sent_log(run_outcomes(spark, sf_dir), CUSTOMERS, F.lit("")).drop("ts")


@query
def request_error_log(spark, sf_dir):
    return sinks.request_error_log(run_outcomes(spark, sf_dir), CUSTOMERS, F.lit("")).drop("ts")


@query
def validation_log(spark, sf_dir):
    return sinks.validation_log(customers_validated(spark, sf_dir), CUSTOMERS, F.lit(REPORT_TIME))


@query
def failed_rows(spark, sf_dir):
    return sinks.failed_rows(run_outcomes(spark, sf_dir), CUSTOMERS)


@query
def failed_rows_legacy(spark, sf_dir):
    return sinks.failed_rows(run_outcomes(spark, sf_dir), CUSTOMERS, legacy=True)


# --- cleansing and checks --------------------------------------------------------------

@query
def null_policy(spark, sf_dir):
    blank = F.when(F.col("priority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.col("priority"))
    return orders_raw(spark, sf_dir).select("row", cleanse.fold_empty(blank).alias("priority"))


@query
def check_required(spark, sf_dir):
    spec = ColumnSpec("token", required=True)
    return one_check(customer_raw(spark, sf_dir), spec, "token")


def _doc_hash(spark: SparkSession, sf_dir: str, change: Callable[[Column], Column]) -> DataFrame:
    text = change(F.col("text"))
    return docs_raw(spark, sf_dir).select(
        "row", F.sha2(text, 256).alias("text_hash"), F.length(text).alias("n_chars"))


@query
def prep_trim(spark, sf_dir):
    padded = F.concat(F.lit("\u3000\t  "), F.col("text"), F.lit(" \u2003\n\x0b\u0085"))
    return _doc_hash(spark, sf_dir, lambda _: scalars.trim(padded))


@query
def prep_remove(spark, sf_dir):
    return _doc_hash(spark, sf_dir, lambda text: cleanse.remove(text, [" ", "\n", "the", "é"]))


@query
def prep_replace(spark, sf_dir):
    pairs = [("the", "THE"), ("THE", "{the}"), ("é", "e"), (".", "!")]
    return _doc_hash(spark, sf_dir, lambda text: cleanse.replace(text, pairs))


@query
def prep_chain(spark, sf_dir):
    rules = [
        CleanseRule(trim=True, remove=("\n",), replace=(("a", " "),)),
        CleanseRule(trim=True, replace=((" ", "_"), ("__", "-"))),
    ]
    return _doc_hash(spark, sf_dir, lambda text: cleanse.preprocess(text, rules))


@query
def normalize_map(spark, sf_dir):
    status = cleanse.normalize(F.col("status"), {"P": "O", "F": "done"})
    return orders_raw(spark, sf_dir).select("row", status.alias("status"))


@query
def check_int(spark, sf_dir):
    return one_check(number_texts(spark, sf_dir), ColumnSpec("text", "int"), "text")


@query
def check_float(spark, sf_dir):
    return one_check(number_texts(spark, sf_dir), ColumnSpec("text", "float"), "text")


@query
def check_decimal(spark, sf_dir):
    return one_check(number_texts(spark, sf_dir), ColumnSpec("text", "decimal(12,2)"), "text")


@query
def check_date(spark, sf_dir):
    dates, text = date_texts(spark, sf_dir), F.col("text")
    return dates.select(
        "row",
        parse_date(text, "20060102").isNotNull().alias("compact"),
        parse_date(text, "2006-01-02").isNotNull().alias("iso"),
        parse_date(text, "01/02/2006").isNotNull().alias("us"),
        parse_date(text, "2/1/2006").isNotNull().alias("european"),
    )


@query
def check_date_zoned(spark, sf_dir):
    text = F.col("text")
    return stamp_texts(spark, sf_dir).select(
        "row",
        parse_date(text, "2006-01-02T15:04:05Z07:00").cast("string").alias("zoned"),
        parse_date(text, "2006-01-02T15:04:05.999-0700").cast("string").alias("compact"),
        parse_date(text, "2006-01-02 03:04 PM").cast("string").alias("half_day"),
        parse_date(text, "2006-002").cast("string").alias("ordinal"),
        parse_date(text, "2006-1-_2 Mon MST").cast("string").alias("named"),
    )


@query
def check_birth_age(spark, sf_dir):
    return one_check(orders_raw(spark, sf_dir), ColumnSpec("odate", "date"), "odate")


@query
def check_min_len(spark, sf_dir):
    return one_check(docs_raw(spark, sf_dir), ColumnSpec("text", min_len=800), "text")


@query
def check_max_len(spark, sf_dir):
    return one_check(docs_raw(spark, sf_dir), ColumnSpec("text", max_len=2000), "text")


@query
def check_regex(spark, sf_dir):
    return one_check(docs_raw(spark, sf_dir), ColumnSpec("text", regex=DOC_PATTERN), "text")


@query
def check_enum(spark, sf_dir):
    return one_check(docs_raw(spark, sf_dir), ColumnSpec("lang", enum=("en", "de", "fr")), "lang")


@query
def check_validators(spark, sf_dir):
    spec = CUSTOMERS.column("proxy")
    return one_check(customer_raw(spark, sf_dir), spec, "proxy")


@query
def check_range(spark, sf_dir):
    return one_check(orders_raw(spark, sf_dir), ORDERS.column("price"), "price")


@query
def check_range_texts(spark, sf_dir):
    """A range over numbers in every accepted writing."""
    spec = ColumnSpec("text", "string", range=Bounds(min=-500, max=200000))
    return one_check(number_texts(spark, sf_dir), spec, "text")


@query
def preset_profile(spark, sf_dir):
    customers = customer_raw(spark, sf_dir)
    values = F.stack(
        F.lit(5),
        F.lit("name"), scalars.trim(F.col("name")),
        F.lit("phone"), F.col("phone"),
        F.lit("birth"), F.col("birth"),
        F.lit("segment"), F.col("segment"),
        F.lit("proxy"), F.col("proxy"),
    ).alias("column_name", "value")
    pages = table(spark, sf_dir, "pages").select(F.lit("url").alias("column_name"),
                                                 F.col("url").alias("value"))
    hits = checks.preset_hits(F.col("value"))
    return customers.select(values).unionByName(pages).groupBy("column_name").agg(*hits.values())


@query
def e164_kr(spark, sf_dir):
    return customer_raw(spark, sf_dir).select("row", scalars.e164_kr(F.col("phone")).alias("phone"))


@query
def first_error(spark, sf_dir):
    """The first failing check of the price and priority columns."""
    checked = check_columns(orders_raw(spark, sf_dir), ORDERS, AS_OF)
    return checked.select("row", F.coalesce(
        F.get("errors", F.lit(0))["message"], F.lit("")).alias("message"))


@query
def row_errors(spark, sf_dir):
    checked = check_columns(customer_raw(spark, sf_dir), CUSTOMERS, AS_OF)
    return checked.select(
        "row",
        F.size("errors").alias("error_count"),
        F.array_join("errors.column", ",").alias("columns"),
        F.array_join("errors.message", "|").alias("messages"),
    )


@named("error_rows")
def all_errors(spark, sf_dir):
    return error_rows(orders_validated(spark, sf_dir)).drop("pos")


@named("valid_rows")
def valid_customers(spark, sf_dir):
    return valid_rows(customers_validated(spark, sf_dir)).select("row", *CUSTOMERS.names)


@named("invalid_rows")
def invalid_customers(spark, sf_dir):
    return invalid_rows(customers_validated(spark, sf_dir)).select(
        "row", *[F.col(RAW + n).alias(n) for n in CUSTOMERS.names])


@query
def typed_rows(spark, sf_dir):
    return typed(orders_validated(spark, sf_dir), ORDERS).select(
        "row", "orderkey", "custkey", "status", F.col("price").cast("string").alias("price"),
        F.col("odate").cast("string").alias("odate"))


# --- table rules -----------------------------------------------------------------------


def _duplicates(df: DataFrame, keys: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    flagged = flag_duplicates(df, keys, F.lit(True), "row", names)
    return flagged.select("row", *names)


@query
def unique_single(spark, sf_dir):
    return _duplicates(orders_raw(spark, sf_dir), [("custkey",)], ["dup_custkey"])


@query
def unique_multi(spark, sf_dir):
    return _duplicates(
        orders_raw(spark, sf_dir), [("custkey",), ("price",), ("odate",)],
        ["dup_custkey", "dup_price", "dup_odate"])


@query
def unique_in_place(spark, sf_dir):
    """The same as unique_multi; rows whose values nobody else claims are not moved."""
    keys, names = [("custkey",), ("price",), ("odate",)], ["dup_custkey", "dup_price", "dup_odate"]
    return flag_in_place(orders_raw(spark, sf_dir), keys, F.lit(True), "row", names).select("row", *names)


@query
def unique_composite(spark, sf_dir):
    return _duplicates(orders_raw(spark, sf_dir), [("custkey", "status")], ["dup_pair"])


@query
def row_rules(spark, sf_dir):
    contract = Contract(columns=ORDERS.columns, row_rules=ORDERS.row_rules)
    return error_rows(validate(orders_raw(spark, sf_dir), contract, AS_OF)).filter(
        "column = ''").select("row", "message")


@query
def row_rule_age(spark, sf_dir):
    condition, helpers = rule_condition(CUSTOMERS.row_rules[0], AS_OF)
    ages = customer_raw(spark, sf_dir).select("*", *[c.alias(n) for n, c in helpers.items()])
    return ages.select("row", condition.alias("holds"))


@query
def age_years(spark, sf_dir):
    birth = parse_date(F.col("birth"), "20060102")
    return customer_raw(spark, sf_dir).select("row", scalars.age_years(birth, AS_OF).alias("age"))


# --- scalar functions ------------------------------------------------------------------

@query
def fn_date_format(spark, sf_dir):
    text = F.col("text")
    return date_texts(spark, sf_dir).select(
        "row",
        scalars.date_format(text, "2006-01-02T15:04:05Z").alias("stamp"),
        scalars.date_format(text, "02.01.06").alias("short"))


@query
def fn_date_format_zoned(spark, sf_dir):
    day = F.col("day")
    return stamp_texts(spark, sf_dir).select(
        "row",
        format_date(day, "2006-01-02T15:04:05Z07:00").alias("zoned"),
        format_date(day, "Mon, 02 Jan 2006 15:04:05 -0700").alias("mail"),
        format_date(day, "Monday _2 January 2006 3:04PM MST").alias("long"),
        format_date(day, "2006-002 05.000").alias("ordinal"),
    )


@query
def fn_e164(spark, sf_dir):
    return customer_raw(spark, sf_dir).select(
        "row", scalars.interpolate("tel:{phone:e164};seg={segment}").alias("phone"))


@query
def fn_mask(spark, sf_dir):
    return customer_raw(spark, sf_dir).select(
        "row", scalars.mask(F.col("token")).alias("token"),
        scalars.mask(F.col("segment")).alias("segment"),
        scalars.mask(F.substring("phone", 1, 3)).alias("prefix"))


@query
def fn_hash(spark, sf_dir):
    return docs_raw(spark, sf_dir).select("row", scalars.sha256_hex(F.col("text")).alias("digest"))


@query
def fn_case(spark, sf_dir):
    return customer_raw(spark, sf_dir).select(
        "row", scalars.upper(F.col("name")).alias("upper_name"),
        scalars.lower(F.col("segment")).alias("lower_segment"))


@query
def fn_trim(spark, sf_dir):
    return customer_raw(spark, sf_dir).select("row", scalars.trim(F.col("name")).alias("name"))


@query
def fn_interpolate(spark, sf_dir):
    text = scalars.interpolate('{{"order":{orderkey},"by":"{custkey}","on":"{odate:date 2006-01-02}"}}')
    return orders_raw(spark, sf_dir).select("row", text.alias("text"))


@query
def fn_if_present(spark, sf_dir):
    header = scalars.if_present(
        F.col("token"), F.concat(F.lit("Bearer "), F.col("token")), F.lit("anonymous"))
    return customer_raw(spark, sf_dir).select("row", header.alias("authorization"))


@query
def json_valid(spark, sf_dir):
    """Event properties, whole and damaged in several ways."""
    props, key = F.col("props"), F.col("event_id")
    damaged = (
        F.when(key % 6 == 1, F.concat(props, F.lit(" x")))
        .when(key % 6 == 2, F.concat(F.lit("["), props, F.lit(",1]")))
        .when(key % 6 == 3, F.replace(props, F.lit('"'), F.lit("'")))
        .when(key % 6 == 4, F.concat(props, F.lit(","), props))
        .when(key % 6 == 5, F.replace(props, F.lit("}"), F.lit("")))
        .otherwise(props)
    )
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.json_valid(damaged).alias("well_formed"))


# --- request projection ----------------------------------------------------------------

@query
def render_requests(spark, sf_dir):
    return flat_requests(valid_rows(signup_requests(spark, sf_dir)))


@query
def render_headers(spark, sf_dir):
    headers = request.render_headers(SIGNUP.headers)
    return customer_raw(spark, sf_dir).select("row", F.to_json(headers).alias("headers"))


@query
def request_hash(spark, sf_dir):
    return orders_raw(spark, sf_dir).select(
        "row", request.request_hash(SIGNUP, ORDERS.names).alias("request_hash"))


@query
def request_hash_hdr(spark, sf_dir):
    return orders_raw(spark, sf_dir).select(
        "row", request.request_hash(SIGNUP, ORDERS.names, True).alias("request_hash"))


@query
def preview(spark, sf_dir):
    return flat_requests(
        request.preview(customer_raw(spark, sf_dir), CUSTOMERS, SIGNUP, 100, AS_OF))


def _fragile_spec() -> request.RequestSpec:
    """A request that cannot be rendered for customers without token."""
    return request.RequestSpec(
        method="PUT",
        url=F.concat(F.lit("https://api.example.com/t/"), F.nullif("token", F.lit(""))),
        sources={"url": "https://api.example.com/t/{token}"},
    )


@query
def template_errors(spark, sf_dir):
    rendered = request.render(valid_rows(customers_validated(spark, sf_dir)), _fragile_spec(), CUSTOMERS)
    return rendered.select("row", F.when(F.col("rendered"), F.lit(""))
                           .otherwise(F.lit("template_error")).alias("error_category"))


# --- outcomes --------------------------------------------------------------------------

@query
def status_success(spark, sf_dir):
    ok = outcome.status_success(F.col("status_code"), SIGNUP.status_in)
    return attempts(spark, sf_dir).select("event_id", ok.alias("success"))


@query
def status_default(spark, sf_dir):
    return attempts(spark, sf_dir).select(
        "event_id", outcome.status_success(F.col("status_code"), ()).alias("success"))


@query
def response_keys(spark, sf_dir):
    spec = request.RequestSpec("GET", "https://api.example.com", status_in=(200, 201),
                               response_keys={"k": "42"})
    ok = outcome.response_success(F.col("status_code"), F.col("body"), spec)
    return attempts(spark, sf_dir).select("event_id", ok.alias("success"))


@query
def error_category(spark, sf_dir):
    return attempts(spark, sf_dir).select(
        "event_id", outcome.error_category(F.col("error")).alias("category"))


@query
def response_preview(spark, sf_dir):
    return docs_raw(spark, sf_dir).select(
        "row", outcome.response_preview(F.col("text")).alias("preview"))


@query
def retryable(spark, sf_dir):
    return attempts(spark, sf_dir).select(
        "event_id", outcome.retryable(F.col("status_code")).alias("retryable"))


@query
def retry_collapse(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "row", "status_code", "success", "latency_ms", "retries", "error_category",
        "error_detail", "response_preview")


@query
def retry_collapse_http(spark, sf_dir):
    collapsed = outcome.collapse_attempts(
        attempts(spark, sf_dir), SIGNUP, order=("ts", "event_id"), retry_http_status=True)
    return collapsed.select("row", "status_code", "success", "retries", "error_category")


@query
def row_outcome(spark, sf_dir):
    return run_outcomes(spark, sf_dir).select(
        "row", "outcome", "status_code", "success", "latency_ms", "retries", "error_category",
        "error_detail", F.coalesce("request_hash", F.lit("")).alias("request_hash"))


@query
def failure_reason(spark, sf_dir):
    return run_outcomes(spark, sf_dir).select(
        "row", F.coalesce(outcome.failure_reason(), F.lit("")).alias("failure_reason"))


@query
def first_header(spark, sf_dir):
    headers = outcome.first_header(F.col("headers"))
    return attempts(spark, sf_dir).select(
        "event_id", headers["Content-Type"].alias("content_type"),
        headers["X-Trace"].alias("trace"), F.size(headers).alias("n_headers"))


# --- resume ----------------------------------------------------------------------------

def _resumed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = staged_requests(spark, sf_dir)
    return (requests.filter("valid").select("row", "request.request_hash"),
            earlier_hashes(requests, sf_dir))


@query
def resume_anti(spark, sf_dir):
    return resume.pending_requests(*_resumed(spark, sf_dir))


@query
def resume_skipped(spark, sf_dir):
    return resume.skipped_requests(*_resumed(spark, sf_dir))


@query
def checkpoint_set(spark, sf_dir):
    return resume.checkpoint_set(run_outcomes(spark, sf_dir))


def _repeating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; users repeat the same request again and again."""
    return attempts(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("row"),
        F.sha2(F.col("row").cast("string"), 256).alias("request_hash"),
        outcome.status_success(F.col("status_code"), SIGNUP.status_in).alias("success"))


@query
def inrun_skip(spark, sf_dir):
    return resume.flag_repeated(_repeating(spark, sf_dir)).select("row", "repeated")


@query
def dict_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("row"), F.col("c_nationkey").cast("string").alias("nation"))
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 4").select(
        F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return cleanse.normalize_with_table(customers, "nation", names, "code", "n_name")


# --- summaries -------------------------------------------------------------------------

@query
def validate_summary(spark, sf_dir):
    return summary.validation_summary(orders_validated(spark, sf_dir))


@query
def validate_staged(spark, sf_dir):
    """The same with contested values staged, so wide rows need no shuffle."""
    validated = validate(
        orders_raw(spark, sf_dir), ORDERS, AS_OF, staging=staging_path(spark, "contested"))
    return summary.validation_summary(validated)


@query
def validate_in_place(spark, sf_dir):
    """The same; only rows with contested values are moved."""
    return summary.validation_summary(validate(orders_raw(spark, sf_dir), ORDERS, AS_OF, in_place=True))


@query
def validate_observed(spark, sf_dir):
    """The same, counted in the pass that writes the report."""
    counters = sinks.write_report(
        orders_validated(spark, sf_dir), ORDERS, staging_path(spark, "report"), F.lit("now"))
    return spark.createDataFrame([counters], "total bigint, valid bigint, invalid bigint, error_count bigint")


@query
def first_errors(spark, sf_dir):
    return summary.first_errors(orders_validated(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    counters = summary.run_summary(run_states(spark, sf_dir))
    return counters.drop("start", "end")


@query
def strict_gate(spark, sf_dir):
    return summary.gate_status(orders_validated(spark, sf_dir))


@query
def mask_log(spark, sf_dir):
    logged = attempts(spark, sf_dir)
    return logged.select(
        "event_id", mask_named(F.col("error"), CUSTOMERS.secret_names).alias("error_detail"))


@query
def mask_values(spark, sf_dir):
    """Values of secret columns are masked by column, too."""
    values = F.stack(
        F.lit(2), F.lit("token"), F.col("token"), F.lit("segment"), F.col("segment")
    ).alias("column_name", "value")
    return customer_raw(spark, sf_dir).select("row", values).select(
        "row", "column_name",
        mask_column_value(F.col("column_name"), F.col("value"), CUSTOMERS).alias("value"))


@query
def progress(spark, sf_dir):
    return summary.progress(run_states(spark, sf_dir))


# --- streams ---------------------------------------------------------------------------

EVENT_CONTRACT = Contract.from_dict({
    "version": 1,
    "columns": [
        {"name": "user", "type": "int", "required": True},
        {"name": "kind", "type": "string", "required": True,
         "enum": ["view", "click", "purchase", "signup"]},
        {"name": "amount", "type": "decimal(12,2)", "range": {"max": 100}},
        {"name": "props", "type": "string", "regex": r'^\{"k": [0-9]+\}$', "max_len": 10},
    ],
    "row_rules": [{"name": "paid", "expr": "kind <> 'purchase' OR CAST(amount AS DOUBLE) >= 1"}],
    "uniqueness": [{"columns": ["user", "props"]}],
})


BATCHES = 5


def event_stream(spark: SparkSession, sf_dir: str, batches: int = 1) -> DataFrame:
    """The events as a stream; with more batches, cut by event id into files that arrive one after the other."""
    events = table(spark, sf_dir, "events")
    if batches == 1:
        rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        path, last = staging_path(spark, "events"), events.agg(F.max("event_id")).first()[0] or 0
        part = F.floor(F.col("event_id") * batches / F.lit(last + 1))
        files = spark.sparkContext.defaultParallelism
        for k in range(batches):
            events.filter(part == k).repartition(files).write.parquet(f"{path}/{k}")
        rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    return (
        rows.select(
            (F.col("event_id") + 1).alias("row"),
            F.col("user_id").cast("string").alias("user"),
            F.col("event_type").alias("kind"),
            F.col("value").cast("decimal(12,2)").cast("string").alias("amount"),
            "props",
        )
    )


@query
def stream_validate(spark, sf_dir):
    out = staging_path(spark, "validated")
    validated = stream.validate_stream(event_stream(spark, sf_dir), EVENT_CONTRACT, AS_OF)
    stream.write_stream(
        validated.select("row", "valid", "errors"), out, staging_path(spark, "checkpoint"))
    return spark.read.parquet(out).select(
        "row", "valid", F.array_join("errors.message", "|").alias("messages"))


@query
def stream_summary(spark, sf_dir):
    out = staging_path(spark, "summary")
    validated = stream.validate_stream(event_stream(spark, sf_dir), EVENT_CONTRACT, AS_OF)
    stream.write_latest(
        stream.summarize_stream(validated), out, staging_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query
def stream_unique(spark, sf_dir):
    out = staging_path(spark, "validated")
    stream.unique_stream(
        event_stream(spark, sf_dir, BATCHES), EVENT_CONTRACT, out, staging_path(spark, "claims"),
        staging_path(spark, "checkpoint"), AS_OF)
    return spark.read.parquet(out).select(
        "row", "valid", F.array_join("errors.column", ",").alias("columns"))


@query
def stream_resume(spark, sf_dir):
    out = staging_path(spark, "resumed")
    events = event_stream(spark, sf_dir, BATCHES).select(
        "row", F.sha2("user", 256).alias("request_hash"),
        F.col("kind").isin("purchase", "view").alias("success"))
    stream.resume_stream(
        events, out, staging_path(spark, "hashes"), staging_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("row", "skipped")
