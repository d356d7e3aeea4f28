"""Contract validation of a whole DataFrame.

    cleanse -> check -> collect column errors      one projection, no shuffle
    uniqueness over rows without column errors     see `uniqueness`
    row rules over rows that are still valid       one projection

The result keeps each input row once, with its processed values, `valid` and `errors`.
"""

from __future__ import annotations

import datetime as dt
import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowpact.contract import ColumnSpec, Contract, ContractError, RowRule, reserved
from rowpact.fixed_values import DEFAULT_DATE_LAYOUT, MSG_DUPLICATE, MSG_ROW_RULE
from rowpact.functions.layouts import parse_date
from rowpact.functions.scalars import age_years
from rowpact.operators.checks import first_error
from rowpact.operators.cleanse import cleanse, fold_empty, transform
from rowpact.operators.uniqueness import (
    fits_broadcast,
    flag_duplicates,
    flag_in_place,
    flag_from_contested,
    key_text,
    stage_contested,
)

ERROR_TYPE = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("message", T.StringType()),
])
RAW = "_raw_"
_RULE_TOKEN = re.compile(
    r"(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<both>&&)|\bage\(\s*`?(?P<age>\w+)`?\s*\)")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def no_errors() -> Column:
    return F.array().cast(T.ArrayType(ERROR_TYPE))


def pinned(condition: Column) -> Column:
    """The same condition, but kept where it is computed.

    A filter on `valid` would otherwise be pushed below the projections that compute it, with
    the whole chain of checks copied into the filter and evaluated a second time. Catalyst
    leaves filters above a projection that reads the partition number.
    """
    return condition & (F.spark_partition_id() >= 0)


Entry = tuple[Column, Column, Column, Column]  # condition, column, value, message


def _collect(row: str, entries: list[Entry]) -> Column:
    """The errors whose condition holds, in order.

    A concat of one-element arrays, because `filter(array, lambda)` would take the whole
    projection out of code generation.
    """
    number, none = _col(row).cast("bigint").alias("row"), no_errors()
    parts = [
        F.when(holds, F.array(F.struct(
            number, column.alias("column"), value.alias("value"), message.alias("message"),
        ))).otherwise(none)
        for holds, column, value, message in entries
    ]
    return F.concat(none, *parts) if parts else none


def check_columns(
    df: DataFrame,
    contract: Contract,
    as_of: Column | dt.date | str | None = None,
    row: str = "row",
    length_unit: str = "bytes",
    enforce_range: bool = True,
) -> DataFrame:
    """Processed columns, raw columns (`_raw_*`) and the column errors of each row.

    A contract column that `df` does not have counts as empty in every row.
    """
    names = contract.names
    _check_names(df, contract, row)
    others = [f"`{c}`" for c in df.columns if c not in names]
    present = set(df.columns)
    raw = df.select(*others, *[
        (fold_empty(_col(n)) if n in present else F.lit("")).alias(RAW + n) for n in names])
    # Each layer is one select, so a long cleansing chain is computed once per column
    # and not again inside every check that reads it.
    clean = raw.select(
        "*", *[cleanse(_col(RAW + s.name), s).alias("_clean_" + s.name) for s in contract.columns])
    dates = {s.name: [_col("_date_" + s.name)] for s in contract.columns if s.is_date}
    ages = [s.name for s in contract.columns if s.is_date and s.layout == DEFAULT_DATE_LAYOUT]
    dated = clean
    if dates:
        dated = clean.select("*", *[
            parse_date(_col("_clean_" + s.name), s.layout).alias("_date_" + s.name)
            for s in contract.columns if s.is_date])
    if ages:
        dated = dated.select("*", *[
            age_years(_col("_date_" + n), as_of).alias("_age_" + n) for n in ages])
    for n in ages:
        dates[n].append(_col("_age_" + n))
    judged = dated.select(
        "*",
        *[
            first_error(_col(RAW + s.name), _col("_clean_" + s.name), s, as_of, length_unit,
                        enforce_range, dates.get(s.name)).alias("_message_" + s.name)
            for s in contract.columns
        ],
    )
    message = {n: _col("_message_" + n) for n in names}
    processed = [
        F.when(
            message[s.name].isNull() & (_col(RAW + s.name) != ""),
            transform(_col("_clean_" + s.name), s.transform),
        ).otherwise(F.lit("")).alias(s.name)
        for s in contract.columns
    ]
    errors = [(message[n].isNotNull(), F.lit(n), _col(RAW + n), message[n]) for n in names]
    any_error = F.coalesce(*message.values()).isNotNull()
    return judged.select(
        *others,
        *[f"`{RAW}{n}`" for n in names],
        *processed,
        F.when(pinned(any_error), _collect(row, errors)).otherwise(no_errors()).alias("errors"),
    )


def _check_names(df: DataFrame, contract: Contract, row: str) -> None:
    """Refuses columns that the result could not tell apart."""
    others = [c for c in df.columns if c not in contract.names]
    if taken := [c for c in others if reserved(c)]:
        raise ContractError(f"column names that validation uses itself: {taken}; rename them first")
    if row in contract.names:
        raise ContractError(f"the column of row numbers, {row!r}, can't be a contract column")
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        seen: set[str] = set()
        for name in [*contract.names, *others]:
            if name.lower() in seen:
                raise ContractError(f"column {name!r} differs from another only in case; set spark.sql.caseSensitive")
            seen.add(name.lower())


def rule_condition(rule: RowRule, as_of: Column | dt.date | str | None = None) -> tuple[Column, dict]:
    """(condition, helper columns) of a row rule.

    Rules are SQL conditions over processed columns; `&&` reads as AND. `age(column)` is the
    age on `as_of` of a yyyymmdd date, as a helper column. NULL counts as failed, and so does what can't be
    computed for a row, such as a cast that overflows (see `apply_row_rules`).
    """
    helpers: dict[str, Column] = {}

    def rewrite(token: re.Match) -> str:
        if token["both"]:
            return " AND "
        if token["age"]:
            date = parse_date(_col(token["age"]), DEFAULT_DATE_LAYOUT)
            helpers["_age_" + token["age"]] = age_years(date, as_of)
            return f"`_age_{token['age']}`"
        return token.group()

    return F.coalesce(F.expr(_RULE_TOKEN.sub(rewrite, rule.expr)), F.lit(False)), helpers


@contextmanager
def lenient(spark: SparkSession):
    """Expressions that are analysed inside give NULL where they can't be computed."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def apply_row_rules(
    df: DataFrame, rules: tuple[RowRule, ...], as_of: Column | dt.date | str | None, row: str
) -> DataFrame:
    """Append one error per failed rule to rows that have none so far.

    Rules are analysed without ANSI mode: one that can't be computed for a row is NULL there, and the job goes on.
    """
    helpers: dict[str, Column] = {}
    entries, conditions = [], []
    for rule in rules:
        condition, needed = rule_condition(rule, as_of)
        helpers.update(needed)
        conditions.append(condition)
        message = MSG_ROW_RULE.format(name=rule.name, expr=rule.expr)
        entries.append((~_col(f"_rule_{len(entries)}"), F.lit(""), F.lit(""), F.lit(message)))
    with_helpers = df
    if helpers:
        with_helpers = df.select("*", *[value.alias(name) for name, value in helpers.items()])
    names = [f"_rule_{k}" for k in range(len(rules))]
    with lenient(df.sparkSession):
        judged = with_helpers.select("*", *[c.alias(n) for n, c in zip(names, conditions)])
        judged.schema  # analysed here, in this mode
    return _add_errors(judged, row, entries, [*helpers, *names])


def _add_errors(df: DataFrame, row: str, entries: list[Entry], used: list[str]) -> DataFrame:
    """Append errors to rows that have none so far; `used` columns are no longer needed."""
    errors = F.when(F.size("errors") == 0, _collect(row, entries)).otherwise(F.col("errors"))
    return df.withColumn("errors", errors).drop(*used)


def validate(
    df: DataFrame,
    contract: Contract,
    as_of: Column | dt.date | str | None = None,
    row: str = "row",
    length_unit: str = "bytes",
    enforce_range: bool = True,
    staging: str | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Validate `df`, whose `row` column numbers the rows (unique, in reading order).

    Lazy by default: the raw rows are distributed by row number once. Both the search for
    owners and the join back read that one exchange, so the input is scanned once and
    the wider checked rows never move. With `staging` (a shared path) the contested values are
    written there first; when they are few, no row is shuffled at all. `in_place` is for input that can be read several times
    at less cost than shuffling it: only rows with contested values are moved (see `flag_in_place`).
    """
    keys = contract.unique_keys
    flags = [f"_dup_{i}" for i in range(len(keys))]
    clean = F.size("errors") == 0

    def check(rows: DataFrame) -> DataFrame:
        return check_columns(rows, contract, as_of, row, length_unit, enforce_range)

    contested = None
    if keys and staging is not None:
        contested = stage_contested(check(df), keys, clean, row, staging)
        if not fits_broadcast(contested):
            contested = None
    if not keys:
        checked = check(df)
    else:
        if contested is not None:
            flagged = flag_from_contested(check(df), keys, clean, row, flags, contested)
        elif in_place:
            flagged = flag_in_place(check(df), keys, clean, row, flags)
        else:
            by_row = check(df.repartition(_col(row)))
            flagged = flag_duplicates(by_row, keys, clean, row, flags)
        checked = append_duplicates(flagged, keys, flags, row)
    if contract.row_rules:
        checked = apply_row_rules(checked, contract.row_rules, as_of, row)
    return checked.withColumn("valid", pinned(F.size("errors") == 0))


def append_duplicates(
    flagged: DataFrame, keys: tuple[tuple[str, ...], ...], flags: list[str], row: str
) -> DataFrame:
    """Turn duplicate flags into errors; every violated key is reported."""
    entries = [
        (_col(flag), F.lit(",".join(key)), _shown(key), F.lit(MSG_DUPLICATE))
        for key, flag in zip(keys, flags)
    ]
    return _add_errors(flagged, row, entries, flags)


def _shown(key: tuple[str, ...]) -> Column:
    return key_text(key) if len(key) == 1 else F.concat_ws(",", *[_col(c) for c in key])


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("valid")


def invalid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("NOT valid")


def error_rows(validated: DataFrame) -> DataFrame:
    """One line per error; `pos` is its place within the row."""
    exploded = validated.select(F.posexplode("errors").alias("pos", "e"))
    return exploded.select("e.row", "pos", "e.column", "e.value", "e.message")


def typed(validated: DataFrame, contract: Contract) -> DataFrame:
    """Valid rows with the contract's Spark types instead of text.

    A decimal is rounded to its scale; one too large for its precision becomes NULL, because
    the checks do not enforce precision. Empty text becomes NULL in typed columns.
    """
    schema = contract.typed_struct_type()

    def cast(spec: ColumnSpec) -> Column:
        value = _col(spec.name)
        if spec.is_date:
            return parse_date(value, spec.layout)
        if spec.type == "float":
            value = F.replace(value, F.lit("_"), F.lit(""))
        return value.try_cast(schema[spec.name].dataType)

    casts = [cast(s).alias(s.name) for s in contract.columns]
    others = [_col(c) for c in validated.columns
              if c not in contract.names and not c.startswith(RAW) and c not in ("errors", "valid")]
    return valid_rows(validated).select(*others, *casts)
