"""RE2-flavoured patterns for Spark's `rlike`, which uses java.util.regex.

Contracts are written for RE2 semantics: `$` is the end of the text, `\\s` has no
vertical tab, `.` stops only at a line feed, and look-around, back-references and
possessive quantifiers do not exist. The differences are settled once, when the
contract is built, so the plan carries one literal pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

# Named classes and their Java spelling.
_POSIX = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}", "lower": "\\p{Lower}",
    "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\p{Space}", "upper": "\\p{Upper}",
    "xdigit": "\\p{XDigit}",
}

_TOKEN = re.compile(
    r"""
    (?P<quoted>\\Q.*?(?:\\E|\Z))
  | (?P<property>\\[pP](?:\{\^?\w+\}|[A-Z]))
  | (?P<code>\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|\\[0-7]{3}|\\0)
  | (?P<escape>\\.)
  | (?P<posix>\[:\^?\w+:\])
  | (?P<group>\(\?(?:P?<\w+>|[imsU]*(?:-[imsU]+)?[:)]|.))
  | (?P<repeat>[*+?]|\{\d+(?:,\d*)?\})
  | (?P<open>\[\^?\]?)
  | (?P<char>.)
    """,
    re.VERBOSE | re.DOTALL,
)


#: Begin and end of a line (after each line feed, also the last), and of the text.
_LINE = {"^": "(?:\\A|(?<=\\n))", "$": "(?=\\n|\\z)"}
_TEXT = {"^": "\\A", "$": "\\z"}


class PatternError(ValueError):
    """The pattern is not valid in RE2."""


def java_pattern(pattern: str) -> str:
    """The java.util.regex pattern that finds what `pattern` finds under RE2."""
    java: list[str] = []
    shape: list[str] = []  # the same structure in Python syntax, to check that it compiles
    in_class = multiline = False
    outer: list[bool] = []  # whether lines counted before each open group: flags end with their group
    repeats = 0
    for token in _TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group()
        if kind == "repeat" and not in_class:
            repeats = _next_repeat(repeats, text, pattern)
            java.append(text)
            shape.append(text)
            continue
        repeats = 0
        if kind == "quoted":
            literal = text[2:-2] if text.endswith("\\E") else text[2:]
            java.append("\\Q" + literal + "\\E")
            shape.append(re.escape(literal))
        elif kind == "property":
            name = text[2:].strip("{}")
            negated = (text[1] == "P") != name.startswith("^")
            java.append(("\\P{Is" if negated else "\\p{Is") + name.lstrip("^") + "}")
            shape.append("\\w")
        elif kind == "code":
            digits = text[2:].strip("{}") if text[1] == "x" else format(int(text[1:], 8), "x")
            java.append("\\x{" + digits + "}")
            shape.append(re.escape(chr(int(digits, 16))))
        elif kind == "escape":
            java.append(_escape(text, in_class, pattern))
            shape.append("$" if text[1] == "z" else text)
        elif kind == "posix" and in_class:
            name = text[2:-2]
            negated = name.startswith("^")
            try:
                java.append(_POSIX[name.lstrip("^")].replace("\\p", "\\P" if negated else "\\p"))
            except KeyError:
                raise PatternError(f"unknown class {text}: {pattern!r}") from None
            shape.append("\\w")
        elif kind == "group" and not in_class:
            head, simple, flags = _group(text, pattern)
            if not text.endswith(")"):
                outer.append(multiline)
            multiline = ("m" in flags[0] or multiline) and "m" not in flags[1]
            java.append(head)
            shape.append(simple)
        elif kind in ("open", "posix") and not in_class:
            in_class = True
            first = text[1:] if kind == "open" else ":"
            if kind == "posix":
                raise PatternError(f"character class name outside a class: {pattern!r}")
            java.append("[" + first.replace("]", "\\]"))
            shape.append("[" + first.replace("]", "\\]"))
        elif in_class:
            for char in text:
                if char == "]":
                    in_class = False
                    java.append(char)
                    shape.append(char)
                else:
                    java.append("\\" + char if char in "[&" else char)
                    shape.append("\\" + char if char in "[&|~" else char)
        elif text in ("^", "$"):
            java.append(_LINE[text] if multiline else _TEXT[text])
            shape.append(text)
        else:
            if text == "(":
                outer.append(multiline)
            elif text == ")" and outer:
                multiline = outer.pop()
            java.append("\\{" if text == "{" else text)
            shape.append("\\{" if text == "{" else text)
    if in_class:
        raise PatternError(f"missing closing ]: {pattern!r}")
    try:
        re.compile("".join(shape))
    except re.error as error:
        raise PatternError(f"{error}: {pattern!r}") from error
    return "(?d)" + "".join(java)


def _next_repeat(repeats: int, text: str, pattern: str) -> int:
    if repeats == 0:
        if text[0] == "{" and any(int(n) > 1000 for n in re.findall(r"\d+", text)):
            raise PatternError(f"repeat count above 1000: {pattern!r}")
        return 1
    if repeats == 1 and text == "?":
        return 2
    raise PatternError(f"nested repetition operator: {pattern!r}")


def _escape(text: str, in_class: bool, pattern: str) -> str:
    char = text[1]
    if char == "s":
        return "\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]"
    if char == "S":
        return "[^\\t\\n\\f\\r ]"
    if char == "v":
        return "\\x0B"
    if char in "bB" and not in_class:
        return _BOUNDARY if char == "b" else _NO_BOUNDARY
    if char in "dDwWaftnr" or (char in "Az" and not in_class):
        return text
    if char.isalnum():
        raise PatternError(f"unsupported escape {text}: {pattern!r}")
    return text


def _group(text: str, pattern: str) -> tuple[str, str, tuple[str, str]]:
    named = re.fullmatch(r"\(\?P?<(\w+)>", text)
    if named:
        return "(", "(", ("", "")
    flags = re.fullmatch(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", text)
    if not flags:
        raise PatternError(f"look-around and atomic groups do not exist in RE2: {pattern!r}")
    on, off, end = flags.group(1), flags.group(2) or "", flags.group(3)
    # Lines are written out where they count, so their flag isn't handed on.
    java_on = on.replace("U", "").replace("m", "").replace("i", "iu")
    java_off = off.replace("U", "").replace("m", "").replace("i", "iu")
    head = "(?" + java_on + ("-" + java_off if java_off else "") + end
    if head == "(?)":
        head = ""
    return head, "(?:" if end == ":" else "", (on, off)


def matches(value: Column, pattern: str) -> Column:
    """Unanchored RE2-style search."""
    return value.rlike(java_pattern(pattern))
