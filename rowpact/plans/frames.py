"""Contract-shaped frames derived from the test tables, and the contracts they are held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowpact.contract import Contract
from rowpact.operators.request import RequestSpec
from rowpact.sources.staging import spread

AS_OF = "2000-06-30"

ORDERS = Contract.from_dict({
    "version": 1,
    "columns": [
        {"name": "orderkey", "type": "int", "required": True},
        {"name": "custkey", "type": "int", "required": True},
        {"name": "status", "type": "string", "required": True,
         "normalize": {"map": {"P": "O"}}, "enum": ["O", "F"]},
        {"name": "price", "type": "decimal(12,2)", "required": True,
         "range": {"min": 1500, "max": 480000}},
        {"name": "odate", "type": "date", "required": True, "format": "20060102"},
        {"name": "priority", "type": "string", "required": True,
         "max_len": 16, "regex": "^[1-5]-[A-Z]+$"},
    ],
    "row_rules": [
        {"name": "recent", "expr": "age(odate) >= 0 && age(odate) <= 4"},
        {"name": "big_finished",
         "expr": "NOT (status = 'F' AND CAST(price AS DECIMAL(12,2)) > 400000)"},
    ],
    "uniqueness": [{"columns": ["custkey"]}],
    "null_policy": {"treat_empty_as_null": True},
})

CUSTOMERS = Contract.from_dict({
    "version": 1,
    "columns": [
        {"name": "name", "type": "string", "required": True, "min_len": 1, "max_len": 50,
         "preprocess": [{"trim": True}],
         "validators": [{"regex": "^Customer#[0-9]+$", "message": "unexpected name"}]},
        {"name": "phone", "type": "string", "required": True,
         "preprocess": [{"remove": ["-", " ", "\t"], "trim": True}],
         "validators": [{"regex": "^[0-9]{10,11}$", "message": "10 or 11 digits expected"}],
         "transform": [{"format_korean_phone_e164": True}]},
        {"name": "birth", "type": "date", "required": True, "format": "20060102",
         "validators": [{"regex": "^[0-9]{8}$"}]},
        {"name": "acctbal", "type": "float", "required": True, "range": {"min": -500}},
        {"name": "segment", "type": "string", "required": True,
         "normalize": {"map": {"HOUSEHOLD": "HOME"}},
         "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOME"]},
        {"name": "token", "type": "string", "secret": True, "min_len": 10, "max_len": 100},
        {"name": "proxy", "type": "string",
         "validators": [{"regex": "^https?://.*$", "message": "http or https expected"}]},
    ],
    "row_rules": [{"name": "age_range", "expr": "age(birth) >= 0 && age(birth) <= 45"}],
    "uniqueness": [{"columns": ["phone"]}],
})

SIGNUP = RequestSpec.from_dict({
    "method": "POST",
    "url": "https://api.example.com/customers/{segment:lower}",
    "headers": {
        "Content-Type": "application/json",
        "Authorization": "{token:if Bearer {token}}",
        "X-Phone": "{phone}",
    },
    "proxy": "{proxy}",
    "body": '{{"name":"{name}","phone":"{phone}","born":"{birth:date 2006-01-02T15:04:05Z}",'
            '"segment":"{segment}"}}',
    "success": {"status_in": [200, 201]},
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_text(ts: Column) -> Column:
    """yyyymmdd of a timestamp without zone, free of any session time zone."""
    return F.replace(ts.cast("date").cast("string"), F.lit("-"), F.lit(""))


def money_text(amount: Column) -> Column:
    return amount.cast("decimal(12,2)").cast("string")


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contract rows. Order keys are dense from 0, so key + 1 is the row number."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("row"),
        F.col("o_orderkey").cast("string").alias("orderkey"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        money_text(F.col("o_totalprice")).alias("price"),
        day_text(F.col("o_orderdate")).alias("odate"),
        F.col("o_orderpriority").alias("priority"),
    )


def customer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contract rows with padded names, dashed phones, tokens and proxies."""
    key = F.col("c_custkey")
    text = key.cast("string")
    tail = ((key * 7919) % 10000).cast("string")
    born = F.date_add(F.lit("1950-01-01").cast("date"), ((key * 37) % 18000).cast("int"))
    token = F.concat(F.lit("token-"), F.substring(F.sha2(text, 256), 1, 12))
    proxy = F.concat(F.lit("http://proxy"), F.col("c_nationkey").cast("string"),
                     F.lit(".example.com:8080"))
    return table(spark, sf_dir, "customer").select(
        (key + 1).alias("row"),
        F.concat(F.lit("\t "), F.col("c_name"), F.lit(" \u3000")).alias("name"),
        F.concat(F.lit("010-"), F.lpad(text, 4, "0"), F.lit("-"), F.lpad(tail, 4, "0")).alias("phone"),
        F.replace(born.cast("string"), F.lit("-"), F.lit("")).alias("birth"),
        money_text(F.col("c_acctbal")).alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        F.when(key % 5 == 0, F.lit("")).otherwise(token).alias("token"),
        F.when(key % 7 == 0, proxy).when(key % 11 == 0, F.lit("ftp://old.example.com"))
        .otherwise(F.lit("")).alias("proxy"),
    )


def docs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("row"), "text", "lang", "source")
    return spread(docs)


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices written in ways that number parsers disagree about."""
    key, price = F.col("o_orderkey"), money_text(F.col("o_totalprice"))
    whole = F.col("o_totalprice").cast("bigint").cast("string")
    forms = [
        price,
        whole,
        F.concat(F.lit("+"), whole),
        F.concat(F.lit("-"), price, F.lit("e2")),
        F.concat(F.lit(" "), whole, F.lit(" ")),
        F.concat(price, F.lit("d")),
        F.concat(whole, F.lit(".")),
        F.concat(F.lit("."), whole),
        F.concat(whole, F.lit("e400")),
        F.concat(F.lit("0x"), whole, F.lit("p-2")),
        F.lit("-Infinity"),
        F.concat(whole, F.lit("0000000000000000000")),
        F.concat(F.substring(whole, 1, 1), F.lit("_"), whole),
    ]
    chosen = F.lit("")
    for i, form in enumerate(forms):
        chosen = F.when(key % len(forms) == i, form).otherwise(chosen)
    return table(spark, sf_dir, "orders").select((key + 1).alias("row"), chosen.alias("text"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in four notations, some with an impossible day or stray characters."""
    key = F.col("o_orderkey")
    iso = F.col("o_orderdate").cast("date").cast("string")
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    forms = [
        F.concat(y, m, d),
        iso,
        F.concat(m, F.lit("/"), d, F.lit("/"), y),
        F.concat(d, F.lit("/"), m, F.lit("/"), y),
        F.concat(y, m, F.lit("32")),
        F.concat(y, F.lit("0230")),
        F.concat(F.lit(" "), y, m, d),
        F.concat(y, m, d, F.lit("0")),
    ]
    chosen = F.lit("")
    for i, form in enumerate(forms):
        chosen = F.when(key % len(forms) == i, form).otherwise(chosen)
    return table(spark, sf_dir, "orders").select((key + 1).alias("row"), chosen.alias("text"))


def stamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as moments with zones, fractions, names and days of the year; some can't be."""
    key = F.col("o_orderkey")
    date = F.col("o_orderdate").cast("date")
    iso = date.cast("string")
    hour = F.lpad((key % 24).cast("string"), 2, "0")
    ordinal = F.concat(F.substring(iso, 1, 4), F.lit("-"), F.lpad(F.dayofyear(date).cast("string"), 3, "0"))
    at = F.concat(iso, F.lit("T"), hour, F.lit(":30:15"))
    forms = [
        F.concat(at, F.lit("Z")),
        F.concat(at, F.lit("+09:00")),
        F.concat(at, F.lit(".25-03:30")),
        F.concat(at, F.lit("+0900")),
        F.concat(at, F.lit("+25:00")),
        F.concat(iso, F.lit(" 03:05 PM")),
        F.concat(iso, F.lit(" 13:05 PM")),
        ordinal,
        F.concat(F.substring(iso, 1, 4), F.lit("-367")),
        F.concat(iso, F.lit(" mon KST")),
    ]
    chosen = F.lit("")
    for i, form in enumerate(forms):
        chosen = F.when(key % len(forms) == i, form).otherwise(chosen)
    return table(spark, sf_dir, "orders").select((key + 1).alias("row"), chosen.alias("text"), date.alias("day"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request attempts: the user is the request row, the type gives the status."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", 200).when(kind == "view", 201).when(kind == "click", 404)
        .when(kind == "signup", 503).otherwise(0)
    )
    texts = [
        "dial tcp: i/o timeout",
        "dial tcp 10.0.0.1:443: connect: connection refused",
        "dial tcp: lookup api.example.com: no such host",
        "context canceled",
        "context deadline exceeded",
        "write: broken pipe, token rejected",
    ]
    error = F.lit("")
    for i, text in enumerate(texts):
        failed = (kind == "error") & (F.col("event_id") % len(texts) == i)
        error = F.when(failed, F.lit(text)).otherwise(error)
    headers = F.create_map(
        F.lit("Content-Type"), F.array(F.lit("application/json"), F.lit("text/plain")),
        F.lit("X-Trace"), F.array(F.col("event_id").cast("string")),
        F.lit("X-Empty"), F.array().cast("array<string>"),
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).alias("row"),
        "event_id",
        "ts",
        status.cast("int").alias("status_code"),
        error.alias("error"),
        F.when(kind == "error", F.lit("")).otherwise(F.col("props")).alias("body"),
        headers.alias("headers"),
    )
