import datetime as dt
import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from rowpact.functions import scalars
from rowpact.functions.layouts import format_date, parse_date
from rowpact.functions.patterns import PatternError, java_pattern, matches

TEXTS = ["", "abc", "ABC", "a\n", "a\nb", "a\r\nb", "foo bar", "foo\x0bbar", "é", "été", "[x]", "x]",
         "a&&b", "{", "a{2}", "aa", "한글", "한글이름", "tab\there", "x-y_z", "a.b", "$5", "^", "\\", "12",
         "٣", "ſ", "K", "a b", "word-end", "wordend", "ab\\E", "naïve café"]
PATTERNS = [
    "^a$", "a$", "(?m)^b$", "^.+$", "a.b", r"\s", r"\S\s\S", r"^[^\s]+$", r"[\s]", r"\bbar\b", r"\Bar",
    r"\d+", r"\w+\W", "[a-c]+", "(?i)abc", "(?i)é", "(?i:B)c", "[]x]", "[^]x]+", r"[\]x]", "[[]", "[a&&b]",
    "a{2}", "a{", "x{,2}|{", r"\Qa.b\E", r"\x41", r"\x{D55C}", r"\pL+", r"\p{Hangul}{2,}", r"\P{Greek}",
    r"[\pN]", "[[:alpha:]]+", "[[:^alpha:]]", "(?P<n>b)", r"\$", r"\z", r"\A\w", "[가-힣]{2,10}", "(?s)a.b",
    "a+?b*?", r"\Qab\E\\", "[-a]", r"[\w-]+$", "x|", r"\t", r"[^[:space:]]", "(?U)a+",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_search_like_re2(mapped, pattern):
    ours = mapped(TEXTS, lambda v: matches(v, pattern))
    theirs = [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in TEXTS]
    assert ours == theirs


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?>a)", r"(a)\1", "a++", "a*+", "(", ")",
                                     "[a", r"\Z", r"\h", "a{1001}", "*a", "[[:nope:]]"])
def test_patterns_outside_re2(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_dates_parse_strictly(mapped):
    texts = ["20000229", "20010229", "20001301", "2000022", "200002290", " 20000229", "2000-2-29", "00010101"]
    assert mapped(texts, lambda v: parse_date(v, "20060102")) == [
        dt.date(2000, 2, 29), None, None, None, None, None, None, dt.date(1, 1, 1)]


@pytest.mark.parametrize("layout,good,bad", [
    ("2006-01-02", "2024-02-29", ["2024-2-29", "2023-02-29", "20240229"]),
    ("01/02/2006", "02/29/2024", ["29/02/2024", "2/29/2024"]),
    ("2.1.2006", "29.2.2024", ["29.13.2024", "29-2-2024"]),
    ("2006-01-02 15:04:05", "2024-02-29 23:59:59", ["2024-02-29 24:00:00", "2024-02-29 23:60:00"]),
    ("2006-01-02T15:04:05Z", "2024-02-29T7:00:00.123Z", ["2024-02-29T07:00:00"]),
    ("2 January 2006", "29 february 2024", ["29 Febr 2024", "30 February 2024"]),
    ("Jan 2, 06", "Feb 29, 24", ["Feb 29 24"]),
    ("20060102150405", "20240229070809", ["2024022978899", "2024022970809"]),
])
def test_layouts(mapped, layout, good, bad):
    parsed = mapped([good, *bad], lambda v: parse_date(v, layout))
    assert parsed == [dt.date(2024, 2, 29)] + [None] * len(bad)


def test_layouts_format(mapped):
    for layout, expected in [("2006-01-02T15:04:05Z", "1990-03-05T00:00:00Z"), ("2/1/06", "5/3/90"),
                             ("Jan 2, 2006", "Mar 5, 1990"), ("January", "March"), ("02.01.06", "05.03.90")]:
        assert mapped(["19900305"], lambda v: format_date(parse_date(v, "20060102"), layout)) == [expected]


@pytest.mark.parametrize("layout,good,bad", [
    ("2006-01-02T15:04:05Z07:00", ["2024-02-29T23:59:59Z", "2024-02-29T0:59:59+09:00", "2024-02-29T10:59:59.123456789-03:30"],
     ["2024-02-29T23:59:59", "2023-02-29T23:59:59Z", "2024-02-29T24:00:00Z", "2024-02-29T23:59:59+0900", "2024-02-29T23:59:59+25:00", "2024-02-29T23:59:59z", "2024-02-29T23:59:59+09:60"]),
    ("2006-01-02T15:04:05-0700", ["2024-02-29T23:59:59+0000"], ["2024-02-29T23:59:59Z", "2024-02-29T23:59:59+00:00"]),
    ("2006-01-02 -07:00:00", ["2024-02-29 +01:02:03"], ["2024-02-29 +01:02", "2024-02-29 Z"]),
    ("2006-01-02 Z07", ["2024-02-29 Z", "2024-02-29 -11"], ["2024-02-29 -1", "2024-02-29 -11:00"]),
    ("20060102 3:04PM", ["20240229 12:00AM", "20240229 1:59PM", "20240229 01:59PM"], ["20240229 13:00PM", "20240229 1:00pm", "20240229 1:60AM"]),
    ("20060102 03:4:5 pm", ["20240229 12:0:7 am", "20240229 01:59:59.5 pm"], ["20240229 1:00:00 am", "20240229 01:00:00 AM"]),
    ("2006-002", ["2024-060"], ["2023-366", "2024-000", "2024-60", "2024-367"]),
    ("2006-__2", ["2024- 60", "2024-060", "2024-60"], ["2024-   60", "2024-x"]),
    ("2006-002 01-02", ["2024-060 02-29"], ["2024-061 02-29", "2024-060 03-01"]),
    ("Monday, 2 January 2006", ["friday, 29 february 2024", "Thursday, 29 February 2024"], ["Fri, 29 February 2024", "Noday, 29 February 2024"]),
    ("Mon Jan _2 15:04:05 MST 2006", ["Thu Feb 29 10:00:00 KST 2024", "Thu Feb 29 10:00:00 GMT+3 2024", "Thu Feb 29 10:00:00.9 CEST 2024", "Thu Feb 29 10:00:00 WITA 2024"],
     ["Thu Feb 29 10:00:00 kst 2024", "Thu Feb 29 10:00:00 KSTX 2024", "Thu Feb 29 10:00:00 K 2024", "Thu Feb 29 10:00:00 GMT+24 2024"]),
    ("2006-01-02 15:04:05.000", ["2024-02-29 10:00:00.123", "2024-02-29 10:00:00,123"], ["2024-02-29 10:00:00.12", "2024-02-29 10:00:00", "2024-02-29 10:00:00.1234"]),
    ("2006-01-02 15:04:05.999Z07:00", ["2024-02-29 10:00:00.1234567Z", "2024-02-29 10:00:00Z"], ["2024-02-29 10:00:00.Z", "2024-02-29 10:00:00.1234567890Z"]),
])
def test_layouts_with_zones_and_names(mapped, layout, good, bad):
    parsed = mapped([*good, *bad], lambda v: parse_date(v, layout).cast("string"))
    assert parsed == ["2024-02-29"] * len(good) + [None] * len(bad)


def test_single_digit_days_may_be_padded(mapped):
    assert mapped(["Mar  5", "Mar 5", "Mar 15", "Mar   5"], lambda v: parse_date(v, "Jan _2").isNotNull()) == [True, True, True, True]


def test_midnight_in_every_layout(mapped):
    for layout, expected in [
        ("Mon, 02 Jan 2006 15:04:05 -0700", "Mon, 05 Mar 1990 00:00:00 +0000"), ("Monday _2 3:4:5pm MST", "Monday  5 12:0:0am UTC"),
        ("2006-002|__2|Z07:00|-07:00:00|-07", "1990-064| 64|Z|+00:00:00|+00"), ("05.000 05.999 ,00x", "00.000 00 ,00x"), ("_2006 Month", "_1990 Month")]:
        assert mapped(["19900305"], lambda v: format_date(parse_date(v, "20060102"), layout)) == [expected]


def test_date_format_tries_layouts_in_order(mapped):
    texts = ["19900315", "1990-03-15", "03/15/1990", "15/03/1990", "03/04/1990", "19901315", "soon"]
    assert mapped(texts, lambda v: scalars.date_format(v, "2006.01.02")) == [
        "1990.03.15"] * 4 + ["1990.03.04", "19901315", "soon"]


def test_trim_is_unicode(mapped):
    space = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1c <= c <= 0x1f)
    assert mapped([space + "a b" + space, "​a", "\x1ca", ""], scalars.trim) == ["a b", "​a", "\x1ca", ""]


def test_replace_all(mapped):
    assert mapped(["aab"], lambda v: scalars.replace_all(v, "a", "$1")) == ["$1$1b"]
    assert mapped(["ab", "한"], lambda v: scalars.replace_all(v, "", "$")) == ["$a$b$", "$한$"]
    assert mapped(["ab"], lambda v: scalars.replace_all(v, "", "")) == ["ab"]


def test_mask(mapped):
    assert mapped(["", "abc", "abcd", "abcde", "비밀번호입니다"], scalars.mask) == [
        "", "***", "****", "ab*de", "비밀***니다"]


def test_e164(mapped):
    texts = ["010-1234-5678", "0212345678", "02-123-4567", "01012345678", "1234567890", "12345678901",
             "+82 10", "031-1234-5678", "٠١٠"]
    assert mapped(texts, scalars.e164_kr) == [
        "+821012345678", "+82212345678", "021234567", "+821012345678", "1234567890", "12345678901",
        "8210", "03112345678", ""]


def test_hash_is_hashlib(mapped):
    assert mapped(["", "한글"], scalars.sha256_hex) == [hashlib.sha256(t.encode()).hexdigest() for t in ("", "한글")]


@pytest.mark.parametrize("as_of", ["2000-06-30", "2000-02-28", "2001-03-01", "1995-01-01"])
def test_age_counts_completed_years(mapped, as_of):
    today = dt.date.fromisoformat(as_of)
    births = [dt.date(1990, 6, 30), dt.date(1990, 7, 1), dt.date(2000, 6, 30), dt.date(2001, 3, 15),
              dt.date(2001, 8, 1), dt.date(1880, 1, 1), dt.date(2000, 2, 29), dt.date(1996, 2, 29)]
    expected = [today.year - b.year - ((today.month, today.day) < (b.month, b.day)) for b in births]
    texts = [b.isoformat() for b in births]
    assert mapped(texts, lambda v: scalars.age_years(v.cast("date"), as_of)) == expected


def test_json_valid_is_strict(mapped):
    texts = ['{"a":1}', "[1,2]", "1", '"x"', "null", " {} ", '{"a":1} x', "{'a':1}", "[1,]", "1,2", "", "NaN",
             '{"a":1}}', "]", '1],[2', '{"a":NaN}', "01", '"\\u12"']

    def strict(text):
        try:
            json.loads(text, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    assert mapped(texts, scalars.json_valid) == [strict(t) for t in texts]
    assert mapped(['{"a":1,"a":2}'], scalars.json_valid) == [True]


def test_interpolate(spark):
    df = spark.createDataFrame([("Kim", "", "19900315"), ("Lee", "t0", "x")], "name string, token string, birth string")
    text = scalars.interpolate("{{{name:upper}}}{token:if  auth={token:hash}} {birth:date 2006-01-02}")
    digest = hashlib.sha256(b"t0").hexdigest()
    assert [r[0] for r in df.select(text).collect()] == ["{KIM} 1990-03-15", "{LEE} auth=" + digest + " x"]
    for bad in ("{name:nope}", "{}", "{name!r}", "{name:upper x}"):
        with pytest.raises(ValueError):
            scalars.interpolate(bad)
    assert df.select(scalars.interpolate("")).first()[0] == ""
