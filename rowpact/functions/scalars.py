"""Scalar functions used by contracts and request templates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, functions as F

from rowpact.fixed_values import INPUT_DATE_LAYOUTS
from rowpact.functions.layouts import format_date, parse_date

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim(value: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.trim(value, F.lit(WHITE_SPACE))


def replace_all(value: Column, old: str, new: str) -> Column:
    """Replace every `old`; an empty `old` puts `new` around every character."""
    if old == "":
        if new == "":
            return value
        quoted = new.replace("\\", "\\\\").replace("$", "\\$")
        return F.concat(F.lit(new), F.regexp_replace(value, "(?s)(.)", "$1" + quoted))
    return F.replace(value, F.lit(old), F.lit(new))


def upper(value: Column) -> Column:
    return F.upper(value)


def lower(value: Column) -> Column:
    return F.lower(value)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def mask(value: Column) -> Column:
    """Keep two characters at each end; hide everything up to four characters."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(
            F.substring(value, 1, 2),
            F.repeat(F.lit("*"), n - F.lit(4)),
            F.substring(value, -2, 2),
        )
    )


def e164_kr(value: Column) -> Column:
    """Korean phone number in E.164 form; other numbers keep just their digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.regexp_replace(digits, r"^0(?:([0-9]{9})|(1[0-9]{9}))\z", r"+82$1$2")


def as_date(as_of: Column | dt.date | str | None) -> Column:
    """The reference day of age checks; today when not given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(as_of).cast("date")


def _day_number(date: Column) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.day(date)


def age_years(birth: Column, as_of: Column | dt.date | str | None = None) -> Column:
    """Completed years between two dates: yyyymmdd numbers differ by 10000 per year."""
    return F.floor((_day_number(as_date(as_of)) - _day_number(birth)) / 10000).cast("int")


def date_format(value: Column, layout: str) -> Column:
    """Rewrite a date found in one of the known input layouts; other text stays."""
    date = F.coalesce(*[parse_date(value, known) for known in INPUT_DATE_LAYOUTS])
    return F.coalesce(format_date(date, layout), value)


def if_present(value: Column, then: Column, otherwise: Column | None = None) -> Column:
    """`then` where `value` is not empty, else `otherwise` (empty text by default)."""
    return F.when(value != "", then).otherwise(F.lit("") if otherwise is None else otherwise)


_STRICT_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false",
                "allowNumericLeadingZeros": "false", "allowBackslashEscapingAnyCharacter": "false", "allowUnquotedControlChars": "false",
                "allowComments": "false"}


def json_valid(value: Column) -> Column:
    """Strict well-formedness, whatever the session's settings. Objects may repeat a key.

    The two wrappers expose trailing text that a bare parse skips.
    """
    in_list = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", _STRICT_JSON)
    in_object = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "map<string,string>", _STRICT_JSON)
    return in_list.isNotNull() & in_object.isNotNull()


#: Fields, conditions and ends as {{ .name }}, {{ if .name }}, {{ end }}.
_FOREIGN = re.compile(r"\{\{-?\s*(?:\.|(?:if|else|end|range|with)\b|\w+\s+\.)")

_FIELD_FUNCTIONS = {
    "upper": upper,
    "lower": lower,
    "trim": trim,
    "hash": sha256_hex,
    "mask": mask,
    "e164": e164_kr,
}


def interpolate(template: str, columns: Mapping[str, Column] | None = None) -> Column:
    """Text with `{column}` fields, as one concat.

    A field may name a function: `{phone:e164}`, `{birth:date 2006-01-02}`; or depend on the
    column being non-empty: `{token:if Bearer {token} else none}` (the part with else may be left out).
    Doubled braces are literal, except round a field of another template language (`{{ .name }}`), which is refused.
    """
    if _FOREIGN.search(template):
        raise ValueError(f"{template!r} has fields of another template language: write {{name}} for {{{{ .name }}}}")
    columns = columns or {}
    parts: list[Column] = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if conversion or not field:
            raise ValueError(f"unsupported field {{{field}!{conversion}}} in {template!r}")
        value = columns[field] if field in columns else F.col(f"`{field}`")
        name, _, argument = (spec or "").partition(" ")
        if not name:
            parts.append(value)
        elif name == "date":
            parts.append(date_format(value, argument))
        elif name == "if":
            then, _, other = argument.partition(" else ")
            parts.append(if_present(value, interpolate(then, columns), interpolate(other, columns)))
        elif name in _FIELD_FUNCTIONS and not argument:
            parts.append(_FIELD_FUNCTIONS[name](value))
        else:
            raise ValueError(f"unknown field function {spec!r} in {template!r}")
    return F.concat(*parts) if parts else F.lit("")
