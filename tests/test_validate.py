import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowpact import Contract, error_rows, invalid_rows, typed, valid_rows, validate
from rowpact.operators import summary, uniqueness
from rowpact.operators.validate import check_columns
from tests.sample import AS_OF, CONTRACT, ROWS, SCHEMA

DUPLICATE = "duplicate value violates uniqueness constraint"


def two_keys(**extra):
    return Contract.from_dict({
        "version": 1,
        "columns": [{"name": "a", "type": "int", "required": True}, {"name": "b", "type": "string"}],
        "uniqueness": [{"columns": ["a", "b"]}],
        **extra,
    })


def table(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "row bigint, a string, b string")
    return df.repartition(partitions) if partitions else df


def errors(validated):
    return [(r["row"], r["column"], r["value"], r["message"])
            for r in error_rows(validated).orderBy("row", "pos").collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return validate(spark.createDataFrame(ROWS, SCHEMA), CONTRACT, AS_OF).cache()


def test_sample_table(sample):
    assert errors(sample) == [(3, "phone", "+821098765432", DUPLICATE)]
    assert summary.validation_summary(sample).first().asDict() == {
        "total": 4, "valid": 3, "invalid": 1, "error_count": 1}
    rows = {r["row"]: r for r in valid_rows(sample).collect()}
    assert sorted(rows) == [1, 2, 4]
    assert rows[2]["gender"] == "F" and rows[2]["phone"] == "+821098765432"
    assert rows[4]["token"] == rows[4]["proxy"] == ""
    assert invalid_rows(sample).first()["_raw_phone"] == "010 9876 5432"


def test_typed_output(spark, sample):
    out = typed(sample, CONTRACT)
    assert dict(out.dtypes)["birth"] == "date"
    assert out.count() == 3


def brute_force(rows):
    """Reading order, one set per key; a rejected row still claims its other keys."""
    seen, found = {"a": set(), "b": set()}, []
    for row, a, b in sorted(rows):
        if a is None or not a.lstrip("-").isdigit():
            found.append((row, "a", a or "", "required field is missing or empty" if not a else "invalid integer"))
            continue
        for name, value in (("a", a), ("b", b or "")):
            if value == "":
                continue
            if value in seen[name]:
                found.append((row, name, value, DUPLICATE))
            seen[name].add(value)
    return found


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "3", "x", "", None]), st.sampled_from(["p", "q", "", None])),
                min_size=1, max_size=25), st.integers(1, 5))
def test_first_row_wins(spark, pairs, partitions):
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(pairs)]
    random.Random(7).shuffle(rows)
    validated = validate(table(spark, rows, partitions), two_keys())
    assert errors(validated) == brute_force(rows)
    counts = summary.validation_summary(validated).first()
    assert counts["total"] == counts["valid"] + counts["invalid"] == len(rows)


def test_staged_and_broadcast_agree(spark, tmp_path):
    rows = [(i, str(i % 40), "hot" if i % 3 else f"b{i % 50}") for i in range(1, 400)]
    contract = two_keys()
    lazy = errors(validate(table(spark, rows, 7), contract))
    staged = errors(validate(table(spark, rows, 5), contract, staging=str(tmp_path / "contested")))
    assert lazy == staged == brute_force(rows)
    checked = check_columns(table(spark, rows, 3), contract)
    keys, clean, flags = contract.unique_keys, F.size("errors") == 0, ["d0", "d1"]
    contested = uniqueness.stage_contested(checked, keys, clean, "row", str(tmp_path / "again"))
    out = uniqueness.flag_from_contested(checked, keys, clean, "row", flags, contested)
    got = {(r["row"], n) for r in out.collect() for n, f in (("a", r["d0"]), ("b", r["d1"])) if f}
    assert got == {(row, name) for row, name, _, _ in lazy}
    assert uniqueness.fits_broadcast(contested) and not uniqueness.fits_broadcast(contested, 100)


def test_too_many_contested_values_for_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowpact.operators.validate.fits_broadcast", lambda contested: False)
    rows = [(i, str(i % 7), "b") for i in range(1, 30)]
    validated = validate(table(spark, rows, 3), two_keys(), staging=str(tmp_path / "contested"))
    assert errors(validated) == brute_force(rows)


def test_missing_column_counts_as_empty(spark):
    df = spark.createDataFrame([(1, "p")], "row bigint, b string")
    assert errors(validate(df, two_keys())) == [(1, "a", "", "required field is missing or empty")]


def test_row_with_broken_rule_still_claims(spark):
    contract = two_keys(row_rules=[{"name": "even", "expr": "CAST(a AS INT) % 2 = 0 && b <> '&&'"}])
    rows = [(1, "1", "p"), (2, "2", "p"), (3, "4", "q"), (4, "6", "&&"), (5, "bad", "r")]
    rule = "row rule 'even' failed: CAST(a AS INT) % 2 = 0 && b <> '&&'"
    assert errors(validate(table(spark, rows), contract)) == [
        (1, "", "", rule), (2, "b", "p", DUPLICATE), (4, "", "", rule), (5, "a", "bad", "invalid integer")]


def test_every_broken_rule_is_reported(spark):
    contract = two_keys(row_rules=[{"name": "r1", "expr": "a > 5"}, {"name": "r2", "expr": "b = 'z'"},
                                   {"name": "r3", "expr": "NULLIF(b, 'p') IS NOT NULL AND NULL"}])
    found = errors(validate(table(spark, [(1, "1", "p")]), contract))
    assert [m for _, _, _, m in found] == ["row rule 'r1' failed: a > 5", "row rule 'r2' failed: b = 'z'",
                                           "row rule 'r3' failed: NULLIF(b, 'p') IS NOT NULL AND NULL"]


def test_age_rule(spark):
    contract = Contract.from_dict({
        "version": 1, "columns": [{"name": "birth", "type": "string"}],
        "row_rules": [{"name": "adult", "expr": "age(birth) >= 18 && age(birth) <= 65"}]})
    df = spark.createDataFrame([(1, "19820630"), (2, "19820701"), (3, ""), (4, "x"), (5, "19300101")],
                               "row bigint, birth string")
    bad = [r[0] for r in errors(validate(df, contract, "2000-06-30"))]
    assert bad == [2, 3, 4, 5]


def test_rule_texts_are_left_alone(spark):
    rule = {"name": "r", "expr": "b <> 'age(a) && x' && b <> \"&&\""}
    rows = [(1, "1", "age(a) && x"), (2, "2", "&&"), (3, "3", "ok")]
    assert [r[0] for r in errors(validate(table(spark, rows), two_keys(row_rules=[rule])))] == [1, 2]


def test_unknown_rule_column_fails_early(spark):
    with pytest.raises(AnalysisException):
        validate(table(spark, [(1, "1", "p")]), two_keys(row_rules=[{"name": "r", "expr": "nope = 1"}]))


def test_composite_key(spark):
    contract = Contract.from_dict({
        "version": 1, "columns": [{"name": "a", "type": "string"}, {"name": "b", "type": "string"}],
        "uniqueness": [{"columns": ["a", "b"], "composite": True}]})
    rows = [(1, "a", "bc"), (2, "ab", "c"), (3, "a", "bc"), (4, "a", ""), (5, "a", "")]
    assert errors(validate(table(spark, rows), contract)) == [(3, "a,b", "a,bc", DUPLICATE)]


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "1", "p", 9)], "row bigint, a string, b string, extra int")
    assert validate(df, two_keys()).first()["extra"] == 9


def test_strict_gate(spark):
    good, bad = table(spark, [(1, "1", "p")]), table(spark, [(1, "x", "p")])
    assert summary.strict_gate(validate(good, two_keys())).count() == 1
    with pytest.raises(summary.ContractViolation):
        summary.strict_gate(validate(bad, two_keys()))


def test_first_errors_in_row_order(spark):
    rows = [(i, "x", "p") for i in range(20, 0, -1)]
    assert [r["row"] for r in summary.first_errors(validate(table(spark, rows, 4), two_keys())).collect()] == [1, 2, 3, 4, 5]


def test_wide_contract(spark):
    """Forty columns with every kind of check still compile."""
    columns = [{"name": f"c{i}", "type": ["int", "float", "decimal(9,2)", "date", "string"][i % 5], "required": i % 2 == 0,
                "max_len": 20, "regex": "^[0-9.]*$", "preprocess": [{"trim": True, "remove": ["-"]}]} for i in range(40)]
    contract = Contract.from_dict({"version": 1, "columns": columns, "uniqueness": [{"columns": ["c0", "c4"]}]})
    value = F.when(F.col("id") % 5 == 3, F.lit("19900101")).otherwise(F.col("id").cast("string"))
    df = spark.range(1, 51).select(F.col("id").alias("row"), *[
        (F.lit("19900101") if i % 5 == 3 else value).alias(f"c{i}") for i in range(40)])
    counts = summary.validation_summary(validate(df, contract, "2000-01-01")).first()
    assert counts["total"] == 50 and counts["valid"] == 41  # the date text repeats in ten rows


def test_more_keys_than_bits(spark):
    names = [f"k{i}" for i in range(65)]
    contract = Contract.from_dict({"version": 1, "columns": [{"name": n, "type": "string"} for n in names],
                                   "uniqueness": [{"columns": names}]})
    rows = [(1, *(f"{n}1" for n in names)), (2, *(f"{n}{1 if n in ('k3', 'k62') else 2}" for n in names))]
    df = spark.createDataFrame(rows, ["row", *names])
    assert [c for _, c, _, _ in errors(validate(df, contract))] == ["k3", "k62"]


def test_typed_floats(spark):
    contract = Contract.from_dict({"version": 1, "columns": [{"name": "f", "type": "float"}]})
    df = spark.createDataFrame([(1, "1_000.5"), (2, "-inf"), (3, "0x1p-1"), (4, "")], "row bigint, f string")
    got = [r["f"] for r in typed(validate(df, contract), contract).orderBy("row").collect()]
    assert got == [1000.5, float("-inf"), 0.5, None]
