"""Uniqueness in place, names that are taken, and logs of a run as one commit."""

import json
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rowpact import Contract, commit_logs, committed, error_rows, read_log, row_outcomes, validate
from rowpact.contract import ContractError
from rowpact.operators import uniqueness
from rowpact.sources import sinks
from tests.sample import CONTRACT
from tests.test_sources import sample_requests, sample_responses
from tests.test_validate import brute_force, errors, table, two_keys

# --- uniqueness in place


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "3", "x", "", None]), st.sampled_from(["p", "q", "", None])), max_size=25), st.integers(1, 5))
def test_in_place_is_the_same(spark, pairs, partitions):
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(pairs)]
    random.Random(7).shuffle(rows)
    assert errors(validate(table(spark, rows, partitions), two_keys(), in_place=True)) == brute_force(rows)


def test_only_claims_of_contested_values_are_moved(spark):
    """Nearly unique values and one hot value; the hot one is spread by row number."""
    rows = [(i, str(i), "hot" if i % 3 == 0 else f"b{i}") for i in range(1, 3001)] + [(5000, "17", "last")]
    df, keys = table(spark, rows, 6), [("a",), ("b",)]
    bits = uniqueness.contested_bits(df, keys, F.lit(True), "row")
    assert bits.agg(F.sum(F.bit_count("_bits"))).first()[0] == 2  # 17 and hot
    marked = {r["row"] for r in uniqueness.mark_suspects(df, keys, F.lit(True), bits, "s").filter("s").collect()}
    assert marked == {i for i in range(3, 3001, 3)} | {17, 5000}
    flagged = uniqueness.flag_in_place(df, keys, F.lit(True), "row", ["x", "y"])
    assert {r["row"] for r in flagged.filter("x").collect()} == {5000}
    assert {r["row"] for r in flagged.filter("y").collect()} == set(range(6, 3001, 3))
    assert flagged.count() == len(rows)


def test_null_values_take_no_part(spark):
    rows = [(1, None, "p"), (2, None, "p"), (3, "1", None), (4, "1", None)]
    flagged = uniqueness.flag_in_place(table(spark, rows, 2), [("a",), ("b",)], F.lit(True), "row", ["x", "y"])
    assert sorted((r["row"], r["x"], r["y"]) for r in flagged.collect()) == [(1, False, False), (2, False, True), (3, False, False), (4, True, False)]


def test_values_that_share_a_bit_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(uniqueness, "WORDS", 1)
    rows = [(i, str(i % 150), f"b{i}") for i in range(1, 400)]
    assert errors(validate(table(spark, rows, 3), two_keys(), in_place=True)) == brute_force(rows)


def test_composite_key_in_place(spark):
    contract = two_keys(uniqueness=[{"columns": ["a", "b"], "composite": "true"}])
    rows = [(1, "1", "p"), (2, "1", "q"), (3, "1", "p"), (4, "1", ""), (5, "1", ""), (6, "x", "p"), (7, "x", "p")]
    found = [e for e in errors(validate(table(spark, rows, 2), contract, in_place=True)) if "unique" in e[3]]
    assert [(e[0], e[1]) for e in found] == [(3, "a,b")]


def test_wide_rows_stay_in_the_plan(spark):
    """Above the exchange of whole rows stands the filter on suspects; the bits are made once."""
    df = spark.range(1000).selectExpr("id AS row", "CAST(id % 998 AS STRING) AS a", "CAST(id AS STRING) AS b", "repeat('w', 100) AS wide")
    flagged = uniqueness.flag_in_place(df, [("a",), ("b",)], F.lit(True), "row", ["x", "y"])
    flagged.collect()
    lines = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert any("ReusedExchange" in x for x in lines)
    moved = [k for k, x in enumerate(lines) if "Exchange hashpartitioning(row" in x and "Reused" not in x]
    assert moved and all(any("Filter" in x for x in lines[k + 1 : k + 5]) for k in moved)


# --- names


@pytest.mark.parametrize("name", ["errors", "Valid", "_raw_a", "_rule_0", "_dup_0"])
def test_names_of_the_result_are_refused(spark, name):
    with pytest.raises(ContractError, match="itself"):
        Contract.from_dict({"version": 1, "columns": [{"name": name, "type": "string"}]})
    df = spark.createDataFrame([(1, "p", "q")], f"row bigint, a string, `{name}` string")
    with pytest.raises(ContractError, match="itself"):
        validate(df, two_keys())


def test_names_that_can_not_be_told_apart_are_refused(spark):
    with pytest.raises(ContractError, match="case"):
        validate(spark.createDataFrame([(1, "p", "q")], "row bigint, a string, B string"), two_keys())
    numbered = Contract.from_dict({"version": 1, "columns": [{"name": "row", "type": "string"}]})
    with pytest.raises(ContractError, match="row numbers"):
        validate(spark.createDataFrame([(1,)], "row bigint"), numbered)
    rows = spark.createDataFrame([(1, "x")], "line bigint, row string")
    assert validate(rows, numbered, row="line").filter("valid").count() == 1
    assert validate(spark.createDataFrame([(1, "1", "_id")], "row bigint, a string, _id string"), two_keys()).first()["_id"] == "_id"


# --- logs as one commit

def at():
    return F.lit("2025-08-11T17:02:15+09:00")


@pytest.fixture
def run(spark):
    requests = sample_requests(spark)
    return requests.drop("request", "rendered"), row_outcomes(requests, sample_responses(spark), CONTRACT)


def test_all_logs_or_none(spark, tmp_path, run, monkeypatch):
    where = str(tmp_path / "logs")
    assert committed(spark, where) == {}
    with pytest.raises(FileNotFoundError):
        read_log(spark, where, "sent")
    write = sinks.write_csv

    def broken(df, path):
        if path.endswith("validate_errors"):
            raise OSError("disk is full")
        write(df, path)

    monkeypatch.setattr(sinks, "write_csv", broken)
    with pytest.raises(OSError):
        commit_logs(*run, CONTRACT, where, at())
    assert committed(spark, where) == {} and not [x for x in os.listdir(where) if x.startswith("attempt-")]
    monkeypatch.setattr(sinks, "write_csv", write)
    first = commit_logs(*run, CONTRACT, where, at())
    assert first == committed(spark, where) and set(first) == set(sinks.LOGS)
    assert read_log(spark, where, "sent").count() == 4 and read_log(spark, where, "validate_errors").first()["column"] == "phone"

    monkeypatch.setattr(sinks, "write_csv", broken)
    with pytest.raises(OSError):
        commit_logs(*run, CONTRACT, where, at())
    assert committed(spark, where) == first and read_log(spark, where, "sent").count() == 4  # the run before is still whole
    monkeypatch.setattr(sinks, "write_csv", write)
    second = commit_logs(*run, CONTRACT, where, at())
    assert second == committed(spark, where) and not set(second.values()) & set(first.values())
    assert sinks.expire_attempts(spark, where) == 1 and sinks.expire_attempts(spark, where) == 0
    assert read_log(spark, where, "failed_rows").count() > 0
    with open(f"{where}/{sinks.COMMITTED}") as f:
        assert set(json.load(f)) == {"attempt", "tables"}
    with pytest.raises(ValueError):
        read_log(spark, where, "no such log")


def test_a_run_without_failures_has_no_table_of_them(spark, tmp_path, run):
    validated, outcomes = run
    made = commit_logs(validated, outcomes.limit(0), CONTRACT, str(tmp_path), at())
    assert set(made) == set(sinks.LOGS) - {"failed_rows"} and read_log(spark, str(tmp_path), "sent").count() == 0
    assert error_rows(validated).count() == read_log(spark, str(tmp_path), "validate_errors").count()
