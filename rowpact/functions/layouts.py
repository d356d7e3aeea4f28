"""Reference-time layouts (`20060102`, `2006-01-02T15:04:05Z`, ...) as Column expressions.

Parsing cuts the date parts out of the text and casts `y-m-d` to DATE. The cast stays in
Spark's own byte parser, needs no time zone, and gives NULL for 30 February. Formatting
glues substrings of the ISO text of a date.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The elements of a reference-time layout, and the names they stand for.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December")
_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_ELEMENT = re.compile(
    r"January|Jan(?![a-z])|Monday|Mon(?![a-z])|MST|002|0[1-6]|15|1|__2|_2(?!006)|2006|2|3|4|5|PM|pm"
    r"|[-Z]07:00:00|[-Z]070000|[-Z]07:00|[-Z]0700|[-Z]07|[.,](?:0+|9+)(?![0-9])")
_DIGIT_ELEMENTS = {"2006", "06", "01", "02", "03", "04", "05", "15", "1", "2", "3", "4", "5", "002"}
#: Which part of a date an element gives; the others must fit but give none.
_PARTS = {"2006": "y", "06": "y2", "01": "m", "1": "m", "Jan": "mon", "January": "mon", "02": "d", "2": "d", "_2": "d", "002": "yd", "__2": "yd"}
_OFFSET_HOUR, _SIXTY = "(?:[01][0-9]|2[0-4])", "[0-5][0-9]"
_ZONE_NAME = r"(?:ChST|MeST|GMT[+-](?:2[0-3]|1[0-9]|0?[0-9])(?![0-9])|[A-Z]{4}T(?![A-Z])|[A-Z]{3}T(?![A-Z])|WITA(?![A-Z])|[A-Z]{3}(?![A-Z])|[+-](?:2[0-3]|1[0-9]|0?[1-9])(?![0-9]))"


@dataclass(frozen=True)
class Piece:
    text: str
    element: bool


def split_layout(layout: str) -> list[Piece]:
    pieces: list[Piece] = []
    at = 0
    for match in _ELEMENT.finditer(layout):
        if match.start() > at:
            pieces.append(Piece(layout[at:match.start()], False))
        pieces.append(Piece(match.group(), True))
        at = match.end()
    if at < len(layout):
        pieces.append(Piece(layout[at:], False))
    return pieces


def _zone_pattern(element: str) -> str:
    body = element[1:].replace("07", _OFFSET_HOUR, 1).replace("00", _SIXTY)
    return f"(?:Z|[+-]{body})" if element[0] == "Z" else f"[+-]{body}"


def _element_pattern(piece: Piece, digit_follows: bool) -> str:
    wide = digit_follows  # an element glued to further digits always takes two
    text = piece.text
    if text[0] in "-Z":
        return _zone_pattern(text)
    if text[0] in ".,":
        return f"[.,][0-9]{{{len(text) - 1}}}" if text[1] == "0" else "(?:[.,][0-9]{1,9})?"
    return {
        "2006": "[0-9]{4}",
        "06": "[0-9]{2}",
        "01": "[0-9]{2}",
        "02": "[0-9]{2}",
        "002": "[0-9]{3}",
        "__2": "(?: {0,2})[0-9]{1,3}",
        "_2": " ?[0-9]{1,2}",
        "03": "(?:0[0-9]|1[0-2])",
        "04": _SIXTY,
        "05": _SIXTY,
        "15": "(?:[01][0-9]|2[0-3])" if wide else "(?:[01]?[0-9]|2[0-3])",
        "1": "[0-9]{2}" if wide else "[0-9]{1,2}",
        "2": "[0-9]{2}" if wide else "[0-9]{1,2}",
        "3": "(?:0[0-9]|1[0-2])" if wide else "(?:1[0-2]|0?[0-9])",
        "4": _SIXTY if wide else "[0-5]?[0-9]",
        "5": _SIXTY if wide else "[0-5]?[0-9]",
        "PM": "(?:AM|PM)",
        "pm": "(?:am|pm)",
        "MST": _ZONE_NAME,
        "Jan": "(?i:" + "|".join(m[:3] for m in _MONTHS) + ")",
        "January": "(?i:" + "|".join(_MONTHS) + ")",
        "Mon": "(?i:" + "|".join(d[:3] for d in _DAYS) + ")",
        "Monday": "(?i:" + "|".join(_DAYS) + ")",
    }[text]


def _literal_pattern(text: str) -> str:
    return re.sub(r"(?:\\ )+", " +", re.escape(text))


def parse_date(value: Column, layout: str) -> Column:
    """DATE written in `layout`, or NULL where the text does not fit exactly.

    Of a text with a time and a zone it is the date as written there. A weekday must be one, not that of the date; a day of the year must
    be that of the month and day, if they are given too.
    """
    pieces = split_layout(layout)
    fixed = all(p.text in {"2006", "06", "01", "02", "04", "05"} if p.element else " " not in p.text
                for p in pieces)
    if any(p.element and p.text == "05" for p in pieces):
        fixed = False  # seconds may carry a fraction
    pattern, places, at = "", {}, 1
    for i, piece in enumerate(pieces):
        if not piece.element:
            pattern += _literal_pattern(piece.text)
            at += len(piece.text)
            continue
        following = pieces[i + 1] if i + 1 < len(pieces) else None
        glued = following is not None and following.element and following.text in _DIGIT_ELEMENTS
        body = _element_pattern(piece, glued)
        part = _PARTS.get(piece.text)
        pattern += f"({body})" if part and not fixed else body
        if piece.text in ("05", "5") and not (following and following.element and following.text[0] in ".,"):
            pattern += "(?:[.,][0-9]+)?"
        if part:
            places[part] = (at, len(piece.text)) if fixed else sum(1 for k in places) + 1
        at += len(piece.text)
    pattern = "^" + pattern + "\\z"

    def cut(part: str) -> Column:
        where = places[part]
        if fixed:
            return F.substring(value, where[0], where[1])
        return F.regexp_extract(value, pattern, where)

    if "y2" in places:
        short = cut("y2")
        year = F.concat(F.when(short >= F.lit("69"), F.lit("19")).otherwise(F.lit("20")), short)
    else:
        year = cut("y") if "y" in places else F.lit("0000")
    if "mon" in places:
        name = F.lower(F.substring(cut("mon"), 1, 3))
        month = F.coalesce(
            *[F.when(name == m[:3].lower(), F.lit(f"{i:02d}")) for i, m in enumerate(_MONTHS, 1)])
    else:
        month = cut("m") if "m" in places else F.lit("01")
    day = F.btrim(cut("d")) if "d" in places and not fixed else cut("d") if "d" in places else F.lit("01")
    date = F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")
    if "yd" in places:
        number = F.btrim(cut("yd")).try_cast("int")
        by_number = F.date_add(F.concat(year, F.lit("-01-01")).try_cast("date"), number - 1)
        agrees = (number >= 1) & (F.year(by_number) == year.try_cast("int"))
        if {"m", "mon", "d"} & places.keys():
            agrees &= by_number == date
        date = F.when(agrees, by_number)
    return F.when(value.rlike(pattern), date)


def format_date(date: Column, layout: str) -> Column:
    """`date` (midnight, in UTC) written in `layout`."""
    iso = date.cast("string")
    month = F.month(date)

    def name(names: tuple[str, ...], number: Column, length: int | None = None) -> Column:
        return F.element_at(F.array(*[F.lit(n[:length]) for n in names]), number)

    # What midnight in UTC reads as.
    midnight = {"15": "00", "03": "12", "3": "12", "04": "00", "4": "0", "05": "00", "5": "0", "PM": "AM", "pm": "am", "MST": "UTC"}
    parts = {
        "2006": lambda: F.substring(iso, 1, 4),
        "06": lambda: F.substring(iso, 3, 2),
        "01": lambda: F.substring(iso, 6, 2),
        "1": lambda: month.cast("string"),
        "02": lambda: F.substring(iso, 9, 2),
        "2": lambda: F.day(date).cast("string"),
        "_2": lambda: F.lpad(F.day(date).cast("string"), 2, " "),
        "002": lambda: F.lpad(F.dayofyear(date).cast("string"), 3, "0"),
        "__2": lambda: F.lpad(F.dayofyear(date).cast("string"), 3, " "),
        "Jan": lambda: name(_MONTHS, month, 3),
        "January": lambda: name(_MONTHS, month),
        "Mon": lambda: name(_DAYS, F.dayofweek(date), 3),
        "Monday": lambda: name(_DAYS, F.dayofweek(date)),
    }

    def written(piece: Piece) -> Column:
        text = piece.text
        if not piece.element:
            return F.lit(text)
        if text in parts:
            return parts[text]()
        if text[0] == "Z":
            return F.lit("Z")
        if text[0] == "-":
            return F.lit("+" + text[1:].replace("07", "00"))
        if text[0] in ".,":
            return F.lit(text if text[1] == "0" else "")
        return F.lit(midnight[text])

    return F.concat(*map(written, split_layout(layout)))
