"""Numbers in range, rules that can't be computed, JSON in any session, templates."""

import pytest
from pyspark.sql import functions as F

from rowpact import Contract, validate
from rowpact.contract import Bounds
from rowpact.functions.scalars import interpolate, json_valid
from rowpact.operators.checks import is_in_range
from rowpact.operators.outcome import response_keys_match
from rowpact.sources.staging import release, staging_path


@pytest.mark.parametrize("bounds, inside, outside", [
    (Bounds(min=-500), ["1e30", "Infinity", "0x1p4", "1_000", "123456789012345678901234567", "-500", ".-5", "1e-400"],
     ["-inf", "nan", "-500.0000000000000000000001", "abc", " 1", ""]),
    (Bounds(min=1500), ["1500", "1500.000", "1.5e3", "00001500", "1500.0000000000000000000000001"], ["1499.9999999999999", "0", "-1500", "1499." + "9" * 40]),
    (Bounds(max=1500), ["1500", "-1e30", "0x5DCp0"], ["1500." + "0" * 40 + "1", "1e309", "0x5DDp0"]),
    (Bounds(min=9007199254740993, max=9007199254740993), ["9007199254740993", "9007199254740993.0"], ["9007199254740992", "9007199254740994"]),
])
def test_range(mapped, bounds, inside, outside):
    assert mapped(inside + outside, lambda v: is_in_range(v, bounds)) == [True] * len(inside) + [False] * len(outside)


def test_a_rule_that_overflows_fails_its_row_only(spark):
    contract = Contract.from_dict({"version": 1, "columns": [{"name": "p", "type": "decimal(12,2)"}],
                                   "row_rules": [{"name": "r", "expr": "CAST(p AS DECIMAL(12,2)) < 5"}, {"name": "d", "expr": "10 / (CAST(p AS DOUBLE) - 4) < 9"}]})
    rows = spark.createDataFrame([(1, "1e30"), (2, "3"), (3, "7"), (4, "4")], "row long, p string")
    found = {r["row"]: [e["message"].split("'")[1] for e in r["errors"]] for r in validate(rows, contract).collect()}
    assert found == {1: ["r"], 2: [], 3: ["r"], 4: ["d"]}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("repeated", ["true", "false"])
def test_json_is_the_same_in_any_session(spark, mapped, repeated):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", repeated)
    try:
        good = ['{"a":1,"a":2}', "1", '"x"', "null", '{"a":{"b":[1,{"c":null}]}}']
        bad = ["[1", "1 2", "1,2", "", "[1] x", "{a:1}", "{'a':1}", "NaN", "01", '{"a":1}}', "1]x", "[1],[2]", '{"a":1},"b":2']
        assert mapped(good + bad, json_valid) == [True] * len(good) + [False] * len(bad)
        assert mapped(['{"s":"fail","s":"ok"}', '{"s":"ok","s":"fail"}', "{}"], lambda v: response_keys_match(v, {"s": "ok"})) == [True, False, False]
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_else_in_templates(mapped):
    assert mapped(["", "x"], lambda v: interpolate("{v:if <{v}> else none}", {"v": v})) == ["none", "<x>"]


@pytest.mark.parametrize("text", ["{{ .proxy }}", "{{.proxy}}", "{{ if .token }}x{{ end }}"])
def test_fields_of_another_template_language_are_refused(text):
    with pytest.raises(ValueError, match="another template language"):
        interpolate(text)


def test_staged_tables_can_be_released(spark):
    path = staging_path(spark, "t")
    spark.range(3).write.parquet(path)
    release(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("pattern, hits, misses", [
    ("(?m:a)b$", ["ab"], ["ab\n", "ab\nx"]),
    ("(?m)^$", ["", "x\n", "\nx"], ["x", "x\ny"]),
    ("(?m)^b$", ["b", "a\nb", "b\nc"], ["ab", "a\nbc"]),
    ("(?:(?m)^b)c", ["a\nbc", "bc"], ["abc"]),
    ("((?m)^b)|^c$", ["a\nb", "c"], ["a\nc", "c\n"]),
    ("(?m)^a(?-m:$)", ["x\na"], ["a\nx"]),
    ("^a$", ["a"], ["a\n", "x\na"]),
    ("(?i:a)b", ["Ab"], ["AB"]),
])
def test_flags_end_with_their_group(mapped, pattern, hits, misses):
    from rowpact.functions.patterns import matches

    assert mapped(hits + misses, lambda v: matches(v, pattern)) == [True] * len(hits) + [False] * len(misses)
