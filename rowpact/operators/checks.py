"""Column checks. Each predicate is one Catalyst expression; the first failing check wins."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, functions as F

from rowpact.contract import Bounds, ColumnSpec
from rowpact.fixed_values import (
    DEFAULT_DATE_LAYOUT,
    MAX_AGE,
    MIN_AGE,
    MSG_AGE,
    MSG_DATE,
    MSG_DECIMAL,
    MSG_ENUM,
    MSG_FLOAT,
    MSG_INT,
    MSG_MAX_LEN,
    MSG_MIN_LEN,
    MSG_RANGE,
    MSG_REGEX,
    MSG_REQUIRED,
    MSG_VALIDATOR,
    PATTERN_PRESETS,
)
from rowpact.functions.layouts import parse_date
from rowpact.functions.patterns import matches
from rowpact.functions.scalars import age_years

# The texts accepted as numbers. Spark's casts take more (blanks, `1d`),
# so a pattern goes first and the cast decides the rest.
INT_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = (
    r"^[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?\z"
)
HEX_FLOAT_TEXT = (
    r"^[+-]?0[xX](?:_?[0-9a-fA-F](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?"
    r"|\.[0-9a-fA-F](?:_?[0-9a-fA-F])*)[pP][+-]?[0-9](?:_?[0-9])*\z"
)
SPECIAL_FLOAT_TEXT = r"(?i)^(?:nan|[+-]?inf(?:inity)?)\z"
DECIMAL_TEXT = r"^(?:[+-]?[0-9]+\.?[0-9]*|[+-]?\.[0-9]+|\.[+-][0-9]+)\z"
SCIENTIFIC_TEXT = r"^(?:[+-]?[0-9]+\.?[0-9]*|[+-]?\.[0-9]+|\.[+-][0-9]+)[eE][+-]?[0-9]+\z"
INFINITY = float("inf")
EXPONENT_MIN, EXPONENT_MAX = -(2**31), 2**31 - 1


def is_int(value: Column) -> Column:
    return value.rlike(INT_TEXT) & value.try_cast("bigint").isNotNull()


def is_float(value: Column) -> Column:
    """Decimal and hexadecimal literals inside the double range, `inf` and `nan`."""
    plain = F.when(value.contains("_"), F.replace(value, F.lit("_"), F.lit(""))).otherwise(value)
    finite = F.abs(plain.try_cast("double")) < INFINITY
    return (
        F.when(value.rlike(FLOAT_TEXT), finite)
        .when(value.rlike(HEX_FLOAT_TEXT), finite)
        .otherwise(value.rlike(SPECIAL_FLOAT_TEXT))
    )


def is_decimal(value: Column) -> Column:
    """A number with an optional exponent; precision and scale are not enforced."""
    power = F.regexp_extract(value, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("bigint")
    places = F.octet_length(F.regexp_extract(value, r"\.([+-]?[0-9]*)", 1))
    in_range = power.between(EXPONENT_MIN, EXPONENT_MAX) & (power - places >= EXPONENT_MIN)
    return (
        F.when(value.rlike(DECIMAL_TEXT), F.lit(True))
        .when(value.rlike(SCIENTIFIC_TEXT), F.coalesce(in_range, F.lit(False)))
        .otherwise(F.lit(False))
    )


def _compare(text: Column, number: Column, bound: object) -> Column:
    """Sign of the number text minus the bound.

    Rounding to doubles keeps order, so only equal doubles need a closer look: digits are cut off, not rounded, after as
    many places as a decimal has, and what was cut off decides if the rest is equal. (With an exponent, 38 digits count.)
    """
    exact = Decimal(str(bound))
    _, digits, exponent = exact.as_tuple()
    places = max(0, min(37 - max(0, len(digits) + exponent), 30))
    kind = f"decimal(38,{places})"
    cut = F.regexp_extract(text, r"^([+-]?[0-9]*\.?[0-9]{0,%d})" % places, 1)
    rest = text.rlike(r"^[+-]?[0-9]*\.[0-9]{%d}[0-9]*[1-9]" % places)
    near = F.when(text.rlike("[eE]"), text).otherwise(cut).try_cast(kind)
    to = F.lit(format(exact, "f")).cast(kind)
    beyond = F.when(text.startswith("-"), -1).otherwise(1)
    tie = F.when(near < to, -1).when(near > to, 1).when(rest, beyond).otherwise(0)
    return F.when(number < float(exact), -1).when(number > float(exact), 1).when(text.rlike("^[+-]?0[xX]"), 0).otherwise(tie)


#: Numbers of which most columns are made: exact as decimals that fit a long.
SHORT_NUMBER = r"^[+-]?[0-9]{1,12}(?:\.[0-9]{1,6})?\z"
SHORT_KIND, SHORT_DIGITS, SHORT_PLACES = "decimal(18,6)", 12, 6


def is_in_range(value: Column, bounds: Bounds) -> Column:
    """Numeric bounds, both inclusive. Text that is no number, and nan, is out of range.

    Every number that a type check accepts is compared, whatever its length, exponent, places, underscores or base. Short plain
    numbers take one pattern and one cast; the closer look is for the others.
    """
    limits = [Decimal(str(b)) for b in (bounds.min, bounds.max) if b is not None]
    slow = _is_in_range_of_any_form(value, bounds)
    if any(-x.as_tuple().exponent > SHORT_PLACES or abs(x) >= 10 ** SHORT_DIGITS for x in limits):
        return slow
    number, inside = value.try_cast(SHORT_KIND), F.lit(True)
    if bounds.min is not None:
        inside &= number >= F.lit(format(Decimal(str(bounds.min)), "f")).cast(SHORT_KIND)
    if bounds.max is not None:
        inside &= number <= F.lit(format(Decimal(str(bounds.max)), "f")).cast(SHORT_KIND)
    return F.when(value.rlike(SHORT_NUMBER), F.coalesce(inside, F.lit(False))).otherwise(slow)


def _is_in_range_of_any_form(value: Column, bounds: Bounds) -> Column:
    plain = F.replace(value, F.lit("_"), F.lit(""))
    plain = F.regexp_replace(plain, r"^\.([+-])", "$1.")
    number = plain.try_cast("double")
    accepted = (value.rlike(FLOAT_TEXT) | value.rlike(DECIMAL_TEXT) | value.rlike(SCIENTIFIC_TEXT) | value.rlike(HEX_FLOAT_TEXT)
                | value.rlike(SPECIAL_FLOAT_TEXT))
    inside = accepted & number.isNotNull() & ~F.isnan(number)
    if bounds.min is not None:
        inside &= _compare(plain, number, bounds.min) >= 0
    if bounds.max is not None:
        inside &= _compare(plain, number, bounds.max) <= 0
    return F.coalesce(inside, F.lit(False))


def text_length(value: Column, unit: str = "bytes") -> Column:
    if unit not in ("bytes", "chars"):
        raise ValueError(f"length unit must be 'bytes' or 'chars', not {unit!r}")
    return F.octet_length(value) if unit == "bytes" else F.char_length(value)


def date_helpers(value: Column, spec: ColumnSpec, as_of: Column | dt.date | str | None) -> list[Column]:
    """The parsed date and the age of a date column, for a layer below the checks."""
    date = parse_date(value, spec.layout)
    if spec.layout != DEFAULT_DATE_LAYOUT:
        return [date]
    return [date, age_years(date, as_of)]


def type_error(
    value: Column, spec: ColumnSpec, as_of: Column | dt.date | str | None,
    helpers: list[Column] | None,
) -> list[tuple]:
    """(failed, message) pairs of the type check."""
    if spec.type == "int":
        return [(~is_int(value), F.lit(MSG_INT))]
    if spec.type == "float":
        return [(~is_float(value), F.lit(MSG_FLOAT))]
    if spec.type.startswith("decimal"):
        return [(~is_decimal(value), F.lit(MSG_DECIMAL))]
    if spec.is_date:
        date, *ages = helpers or date_helpers(value, spec, as_of)
        failures = [(date.isNull(), F.lit(MSG_DATE))]
        for age in ages:
            before, after = MSG_AGE.split("{age}")
            message = F.concat(F.lit(before), age.cast("string"), F.lit(after))
            failures.append((~age.between(MIN_AGE, MAX_AGE), message))
        return failures
    return []


def column_failures(
    value: Column,
    spec: ColumnSpec,
    as_of: Column | dt.date | str | None = None,
    length_unit: str = "bytes",
    enforce_range: bool = True,
    helpers: list[Column] | None = None,
) -> list[tuple]:
    """(failed, message) pairs for a non-empty cleansed value, in checking order."""
    failures = type_error(value, spec, as_of, helpers)
    length = text_length(value, length_unit)
    if spec.min_len is not None:
        failures.append((length < spec.min_len, F.lit(MSG_MIN_LEN.format(n=spec.min_len))))
    if spec.max_len is not None:
        failures.append((length > spec.max_len, F.lit(MSG_MAX_LEN.format(n=spec.max_len))))
    if spec.regex:
        failures.append((~matches(value, spec.regex), F.lit(MSG_REGEX)))
    if spec.enum:
        allowed = MSG_ENUM.format(values=", ".join(spec.enum))
        failures.append((~value.isin(*spec.enum), F.lit(allowed)))
    for rule in spec.validators:
        if rule.regex:
            failures.append((~matches(value, rule.regex), F.lit(rule.message or MSG_VALIDATOR)))
    if spec.range is not None and enforce_range:
        failures.append((~is_in_range(value, spec.range), F.lit(MSG_RANGE)))
    return failures


def first_error(
    raw: Column,
    value: Column,
    spec: ColumnSpec,
    as_of: Column | dt.date | str | None = None,
    length_unit: str = "bytes",
    enforce_range: bool = True,
    helpers: list[Column] | None = None,
) -> Column:
    """The first failing check's message, NULL when the column is fine.

    `raw` decides emptiness, before any cleansing; `value` is the cleansed text. One CASE,
    so the checks after the first failure are not evaluated.
    """
    empty = F.lit(MSG_REQUIRED) if spec.required else F.lit(None).cast("string")
    chain = F.when(raw == "", empty)
    for failed, message in column_failures(
        value, spec, as_of, length_unit, enforce_range, helpers
    ):
        chain = chain.when(failed, message)
    return chain.otherwise(F.lit(None).cast("string"))


def preset_hits(value: Column) -> dict[str, Column]:
    """How many rows match each named pattern, as aggregate columns."""
    return {
        name: F.count_if(matches(value, pattern)).alias(name)
        for name, pattern in PATTERN_PRESETS.items()
        if pattern
    }
