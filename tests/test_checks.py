import pytest
from pyspark.sql import functions as F

from rowpact.contract import Bounds, CleanseRule, ColumnSpec, PatternRule
from rowpact.operators import checks, cleanse


def test_int(mapped):
    good = ["0", "-1", "+7", "007", "9223372036854775807", "-9223372036854775808"]
    bad = ["9223372036854775808", " 1", "1 ", "1.0", "1e3", "", "-", "1_000", "0x10", "١", "1\n"]
    assert mapped(good + bad, checks.is_int) == [True] * len(good) + [False] * len(bad)


def test_float(mapped):
    good = ["0", "1.5", ".5", "5.", "-1e10", "1E-400", "1e308", "inf", "-Infinity", "NaN", "+INF", "0x1p3",
            "0X.8P-1", "1_000.5", "0x_1p0"]
    bad = ["1e400", "-1e400", "1d", "1f", " 1", "1 ", "", ".", "e5", "+nan", "infin", "0x1", "1__0", "_1", "1_",
           "0x1p99999", "1,5", "1\n"]
    assert mapped(good + bad, checks.is_float) == [True] * len(good) + [False] * len(bad)


def test_decimal(mapped):
    good = ["0", "-1.25", ".5", "5.", "+3", "1e400", "1E-5", "123456789012345678901234567890.5", "1e2147483647"]
    bad = ["", ".", "-", "1.2.3", "1e", "1e1.5", "inf", "nan", "0x1", " 1", "1e2147483648", "1_0", "1d",
           "1.5e-2147483648"]
    assert mapped(good + bad, checks.is_decimal) == [True] * len(good) + [False] * len(bad)


def test_range(mapped):
    bounds = Bounds(min=__import__("decimal").Decimal("-1.5"), max=__import__("decimal").Decimal(10))
    texts = ["-1.5", "-1.51", "10", "10.000001", "abc", "1e1", "1e30"]
    assert mapped(texts, lambda v: checks.is_in_range(v, bounds)) == [
        True, False, True, False, False, True, False]


def messages(mapped, spec, texts, **options):
    return mapped(texts, lambda v: checks.first_error(v, cleanse.cleanse(v, spec), spec, "2000-06-30", **options))


def test_required_looks_at_the_raw_value(mapped):
    required = ColumnSpec("v", required=True, preprocess=(CleanseRule(trim=True),), min_len=1)
    assert messages(mapped, required, ["", "  ", "x"]) == [
        "required field is missing or empty", "value too short (min 1 characters)", None]
    assert messages(mapped, ColumnSpec("v", min_len=3), ["", "ab"]) == [
        None, "value too short (min 3 characters)"]


def test_lengths_count_bytes_unless_told_otherwise(mapped):
    spec = ColumnSpec("v", min_len=3, max_len=8)
    assert messages(mapped, spec, ["한", "한글로", "ab"]) == [
        None, "value too long (max 8 characters)", "value too short (min 3 characters)"]
    assert messages(mapped, spec, ["한", "한글로"], length_unit="chars") == [
        "value too short (min 3 characters)", None]
    with pytest.raises(ValueError):
        checks.text_length(F.lit("x"), "words")


def test_first_failing_check_wins(mapped):
    spec = ColumnSpec(
        "v", "int", min_len=2, max_len=4, regex="^[1-9]", enum=("10", "1234", "2000"),
        validators=(PatternRule("0$", ""), PatternRule("^1", "must start with 1"), PatternRule("", "unused")),
        range=Bounds(max=__import__("decimal").Decimal(500)))
    assert messages(mapped, spec, ["x", "1", "12345", "099", "11", "1234", "2000", "10"]) == [
        "invalid integer", "value too short (min 2 characters)", "value too long (max 4 characters)",
        "value does not match required pattern", "value must be one of: 10, 1234, 2000",
        "value does not match validation rule", "must start with 1", None]


def test_range_is_last_and_can_be_off(mapped):
    spec = ColumnSpec("v", "int", range=Bounds(min=__import__("decimal").Decimal(5)))
    assert messages(mapped, spec, ["4", "5"]) == ["value out of range", None]
    assert messages(mapped, spec, ["4"], enforce_range=False) == [None]


def test_birth_dates(mapped):
    spec = ColumnSpec("v", "date")
    assert messages(mapped, spec, ["19900101", "20000701", "18790101", "1990", "19900230", "20000630"]) == [
        None, "invalid age: -1 (must be 0-120)", "invalid age: 121 (must be 0-120)", "invalid date format",
        "invalid date format", None]
    iso = ColumnSpec("v", "date", format="2006-01-02")
    assert messages(mapped, iso, ["2050-01-01", "20500101"]) == [None, "invalid date format"]


def test_cleansing_order(mapped):
    rules = (CleanseRule(trim=True, remove=("-",), replace=(("a", "b"), ("b", "c"))), CleanseRule(replace=(("c", " "),), trim=True))
    assert mapped(["  a-x ", "c"], lambda v: cleanse.preprocess(v, rules)) == [" x", " "]
    assert mapped(["1", "3"], lambda v: cleanse.normalize(v, {"1": "M"})) == ["M", "3"]
    assert mapped(["1"], lambda v: cleanse.normalize(v, {})) == ["1"]


def test_custom_message_is_literal(mapped):
    spec = ColumnSpec("v", validators=(PatternRule("^a", "100% a"),))
    assert messages(mapped, spec, ["b"]) == ["100% a"]


def test_large_dictionary_by_join(spark, values):
    codes = spark.createDataFrame([("1", "one"), ("2", "two")], "code string, word string")
    out = cleanse.normalize_with_table(values(["1", "3", "2"]), "v", codes, "code", "word")
    assert [r["v"] for r in out.orderBy("row").collect()] == ["one", "3", "two"]


@pytest.mark.parametrize("low, high", [("1500", "480000"), ("-0.5", None), (None, "12.000001"), ("0.0000001", "3"), ("-1000000000000", "1e12")])
def test_short_numbers_are_judged_like_all_others(spark, low, high):
    from decimal import Decimal
    from rowpact.operators.checks import _is_in_range_of_any_form
    bounds = Bounds(Decimal(low) if low else None, Decimal(high) if high else None)
    texts = ["0", "-0", "+1500", "1500.000000", "1499.999999", "1500.0000001", "480000", "480000.000001", "-0.5", "-0.500001", "12.000001", "12.0000010", "000000012",
             "999999999999", "1000000000000", "-999999999999.999999", "3", "3.0", "3.", ".5", "1e3", "0x1p4", "1_500", "", "x", "nan", "-inf", "2999999.9", "0.000000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select("t", checks.is_in_range(t, bounds).alias("quick"), _is_in_range_of_any_form(t, bounds).alias("slow")).collect()
    assert [(r["t"], r["quick"]) for r in rows] == [(r["t"], r["slow"]) for r in rows]
