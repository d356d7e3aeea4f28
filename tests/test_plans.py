"""Plans of registered queries: what must not be in them, and what must."""

import pytest

import __spark_entry__ as entry
from rowpact.plans.catalog import QUERIES
from rowpact.plans.oracles import oracles

SF = "/root/testdata/sf0.001"
STREAMS = {name for name in entry.queries() if name.startswith("stream_")}
PURE = ["error_rows", "valid_rows", "validate_summary", "unique_multi", "render_requests", "retry_collapse",
        "row_outcome", "resume_anti", "inrun_skip", "check_regex", "preview_jsonl", "dict_join", "failed_rows"]


def plan(df, optimized=False):
    execution = df._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString()


@pytest.mark.parametrize("name", PURE)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for node in ("EvalPython", "PythonUDF", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(entry.queries()["unique_single"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    text = plan(entry.queries()["check_birth_age"](spark, SF))
    assert "Exchange" not in text and "o_totalprice" not in text


def test_uniqueness_joins_by_row_not_by_value(spark):
    text = plan(entry.queries()["unique_multi"](spark, SF))
    assert "partial_min" in text  # owners are combined before the shuffle
    assert text.count("Expand") == 0 and text.count("Window") == 0


def test_checks_are_not_copied_into_filters(spark):
    """Each date is parsed once on either side of the owner join."""
    text = plan(entry.queries()["valid_rows"](spark, SF), optimized=True)
    assert text.count("AS _date_birth") == 2
    assert all("RLIKE" not in line for line in text.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_every_query_has_sql(spark):
    assert set(oracles()) == set(QUERIES)
