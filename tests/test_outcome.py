import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F

from rowpact import RequestSpec, collapse_attempts, render, row_outcomes, row_states, run_summary, validate
from rowpact.operators import outcome, resume, summary
from rowpact.operators.lookup import counted_join, lookup_join
from rowpact.sources import sinks
from tests.sample import AS_OF, CONTRACT, ROWS, SCHEMA, SPEC

ATTEMPTS = ("row bigint, ts timestamp_ntz, status_code int, error string, body string, "
            "headers map<string, array<string>>")
START = dt.datetime(2024, 3, 31, 1, 59)
OK = RequestSpec(method="GET", url="u", status_in=(200, 201))


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_small_predicates(mapped):
    assert mapped(["200", "226", "299", "0"], lambda v: outcome.status_success(v.cast("int"), ())) == [
        True, True, False, False]
    assert mapped(["0", "499", "500", "599", "600", "429", "200"], lambda v: outcome.retryable(v.cast("int"))) == [
        True, False, True, True, False, True, False]
    texts = ["", None, "i/o timeout: connection refused", "x connection refused", "no such host", "context canceled",
             "context deadline exceeded", "Timeout"]
    assert mapped(texts, outcome.error_category) == [
        "", "", "timeout", "connection_refused", "dns_error", "canceled", "timeout", "unknown"]
    assert mapped(["x" * 200, "한" * 201, ""], outcome.response_preview) == ["x" * 200, "한" * 200 + "...", ""]


def test_response_keys(mapped):
    bodies = ['{"status":"success","n":1}', '{"status":"success"} x', '{"status":"fail"}', "[]", "", "null",
              "{'status':'success'}", '{"n":1,"status":"success","status":"success"}', '{"STATUS":"success"}']
    assert mapped(bodies, lambda v: outcome.response_keys_match(v, {"status": "success"})) == [
        True, False, False, False, False, False, False, True, False]
    assert mapped(['{"a":1.5,"b":true,"c":{"d":[1]}}'],
                  lambda v: outcome.response_keys_match(v, {"a": "1.5", "b": "true", "c": '{"d":[1]}'})) == [True]


def test_first_header(spark):
    df = spark.createDataFrame([({"A": ["1", "2"], "B": []},)], "h map<string, array<string>>")
    assert df.select(outcome.first_header(F.col("h"))).first()[0] == {"A": "1"}


def simulate(tries, retry_http=False):
    """What a client with three retries reports for these prepared answers."""
    sticky = ""
    for n, (seconds, status, error, body) in enumerate(tries):
        sticky = error or sticky
        worth = status == 0 or 500 <= status < 600 or status == 429
        again = worth if retry_http else bool(error) and worth
        if not again or n == 3 or n == len(tries) - 1:
            return (n, status, not error and status in (200, 201), sticky, (seconds - tries[0][0]) * 1000)


@pytest.mark.parametrize("retry_http", [False, True])
def test_retries_collapse_like_a_client(spark, retry_http):
    rng = random.Random(3)
    kinds = [(0, "no such host", ""), (0, "timeout", ""), (500, "", "oops"), (429, "", ""), (503, "unexpected EOF", ""),
             (404, "", ""), (200, "unexpected EOF", ""), (200, "", "fine")]
    calls = {row: [(10 * row + i, *rng.choice(kinds)) for i in range(rng.randint(1, 7))] for row in range(1, 80)}
    rows = [(row, at(t), status, error, body, None) for row, tries in calls.items() for t, status, error, body in tries]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ATTEMPTS).repartition(5)
    got = {r["row"]: (r["retries"], r["status_code"], r["success"], r["error_detail"], r["latency_ms"])
           for r in collapse_attempts(df, OK, retry_http_status=retry_http).collect()}
    assert got == {row: simulate(tries, retry_http) for row, tries in calls.items()}


def test_hot_request_sends_few_rows_to_the_shuffle(spark):
    df = spark.range(0, 20000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("row"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("status_code"),
        F.lit("timeout").alias("error"), F.lit("").alias("body"),
        F.lit(None).cast("map<string,array<string>>").alias("headers"))
    collapsed = collapse_attempts(df, OK)
    plan = collapsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert collapsed.filter("row = 1").first()["retries"] == 3


def sample_requests(spark):
    return render(validate(spark.createDataFrame(ROWS, SCHEMA), CONTRACT, AS_OF), SPEC, CONTRACT)


def sample_responses(spark):
    """Rows 1, 2 and 4 fail to resolve their host four times, over 1 + 2 + 4 seconds."""
    host = {1: "lookup api.example.com", 2: "proxyconnect tcp: dial tcp: lookup proxy.example.com",
            4: "lookup api.example.com"}
    rows = [(row, at(delay), 0, f'Post "https://api.example.com/users": {text}: no such host', "", None)
            for row, text in host.items() for delay in (0, 1, 3, 7)]
    return collapse_attempts(spark.createDataFrame(rows, ATTEMPTS), SPEC)


def test_sample_run(spark):
    outcomes = row_outcomes(sample_requests(spark), sample_responses(spark), CONTRACT).cache()
    got = {r["row"]: r for r in sinks.sent_log(outcomes, CONTRACT, F.lit("now")).collect()}
    assert {k: (r["error_category"], r["retries"], r["status_code"], r["success"], r["latency_ms"])
            for k, r in got.items()} == {
        1: ("dns_error", 3, 0, False, 7000), 2: ("dns_error", 3, 0, False, 7000),
        3: ("validation_error", 0, 0, False, 0), 4: ("dns_error", 3, 0, False, 7000)}
    assert got[3]["error_detail"] == "Row validation failed" and got[3]["ts"] == "now"
    assert sinks.request_error_log(outcomes, CONTRACT, F.lit("now")).count() == 4
    counts = run_summary(outcomes).first()
    assert (counts["total"], counts["success"], counts["failed"], counts["skipped"], counts["pending"]) == (4, 0, 4, 0, 0)
    assert counts["duration_ms"] == 7000
    assert summary.progress(outcomes).first()["fraction"] == 1.0
    failed = {tuple(r) for r in sinks.failed_rows(outcomes, CONTRACT).collect()}
    assert failed == {(*r[1:], "validation_failed" if r[0] == 3 else "dns_error") for r in ROWS}
    legacy = [tuple(r) for r in sinks.failed_rows(outcomes, CONTRACT, legacy=True).collect()]
    assert sorted(r[-1] for r in legacy) == ["dns_error"] * 3 + ["validation_error", "validation_failed"]
    assert ("박영희", "+821098765432", "19850720", "F", "def789token012", "http://proxy.example.com:8080",
            "dns_error") in legacy


def test_outcome_states(spark):
    contract = type(CONTRACT).from_dict({"version": 1, "columns": [{"name": "v", "type": "string", "required": True}]})
    rows = [(1, "same"), (2, "same"), (3, ""), (4, "done before"), (5, "no url"), (6, "no answer"), (7, "same"), (8, "bad")]
    df = spark.createDataFrame(rows, "row bigint, v string")
    spec = RequestSpec(method="GET", url=F.when(F.col("v") != "no url", F.col("v")), sources={"url": "{v}"},
                       status_in=(200,))
    requests = render(validate(df, contract), spec, contract)
    answers = [(1, 404), (2, 200), (3, 200), (4, 200), (5, 200), (7, 200), (8, 404)]
    responses = collapse_attempts(
        spark.createDataFrame([(r, at(0), s, "", "", None) for r, s in answers], ATTEMPTS), spec)
    checkpoint = requests.filter("row = 4").select("request.request_hash")
    outcomes = row_outcomes(requests, responses, contract, checkpoint).cache()
    assert {r["row"]: r["outcome"] for r in outcomes.collect()} == {
        1: "failed", 2: "success", 3: "validation_error", 4: "skipped", 5: "template_error", 6: "pending",
        7: "skipped", 8: "failed"}
    counts = run_summary(outcomes).first()
    assert [counts[c] for c in ("success", "failed", "skipped", "template_errors", "pending")] == [1, 3, 2, 1, 1]
    reasons = {r["row"]: r["x"] for r in outcomes.select("row", outcome.failure_reason().alias("x")).collect()}
    assert reasons == {1: "request_failed", 2: None, 3: "validation_failed", 4: None, 5: "template_error", 6: None,
                       7: None, 8: "request_failed"}
    assert resume.checkpoint_set(outcomes).count() == 1


def test_second_run_has_nothing_to_do(spark, tmp_path):
    path = str(tmp_path / "done")
    df = spark.range(1, 200).select(F.col("id").alias("row"), F.sha2((F.col("id") % 50).cast("string"), 256)
                                    .alias("request_hash"), F.lit(True).alias("success"))
    resume.append_checkpoint(df, path)
    done = spark.read.parquet(path)
    assert done.count() == 50
    assert resume.pending_requests(df, done).isEmpty()
    assert resume.skipped_requests(df, done).count() == 199
    assert resume.pending_requests(df, done.filter("request_hash < '8'")).join(
        done.filter("request_hash < '8'"), "request_hash", "left_semi").isEmpty()


def test_hot_hash_is_spread_and_exact(spark):
    left = spark.range(1, 3001).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    right = left.filter("key is not null").groupBy("key").agg(F.min("row").alias("first")).filter("first % 5 <> 4")
    want = {r["row"]: r["first"] for r in left.join(right, "key", "left").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(left, right, "key", ["first"])
        got = {r["row"]: r["first"] for r in joined.collect()}
        hot_parts = joined.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want and len(got) == 3000
    assert hot_parts == 4  # every shuffle partition has rows of the hot key


def test_both_sides_of_a_lookup_get_the_same_hot_keys(spark, monkeypatch):
    """Whatever the sketch says, even when it changes its mind between calls, no row loses its match."""
    from rowpact.operators import lookup

    said = iter([["hot"], ["k1"], []])
    monkeypatch.setattr(lookup, "hot_keys", lambda df, key: spark.createDataFrame([(k,) for k in next(said)], "_hot_key string"))
    left = spark.range(1, 301).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    right = left.groupBy("key").agg(F.min("row").alias("first"))
    for _ in range(3):
        assert lookup_join(left, right, "key", ["first"]).filter("first IS NULL").isEmpty()


def test_in_run_repeats(spark):
    rows = [(1, "h", False), (2, "h", True), (3, "h", False), (4, "h", True), (5, "g", False), (6, None, True)]
    df = spark.createDataFrame(rows, "row bigint, request_hash string, success boolean")
    assert {r["row"]: r["repeated"] for r in resume.flag_repeated(df).collect()} == {
        1: False, 2: False, 3: True, 4: True, 5: False, 6: False}


def many_requests(spark, folder):
    """300 rows in a written table, a third of them with one hash, some invalid, some without a request; their responses."""
    contract = type(CONTRACT).from_dict({"version": 1, "columns": [{"name": "v", "type": "string", "required": True}]})
    rows = [(k, "hot" if k % 3 == 0 else "" if k % 7 == 0 else "no url" if k % 11 == 0 else f"v{k % 40}") for k in range(1, 301)]
    spec = RequestSpec(method="GET", url=F.when(F.col("v") != "no url", F.col("v")), sources={"url": "{v}"}, status_in=(200,))
    render(validate(spark.createDataFrame(rows, "row bigint, v string"), contract), spec, contract).write.parquet(folder)
    requests = spark.read.parquet(folder)
    answers = [(k, at(0), 200 if k % 5 == 0 else 404, "", "", None) for k in range(1, 301) if k % 13]
    responses = collapse_attempts(spark.createDataFrame(answers, ATTEMPTS), spec)
    checkpoint = requests.filter("v = 'v8'").select("request.request_hash").unionByName(
        spark.createDataFrame([(None,), ("of no row",)], "request_hash string"))
    return rows, requests, responses, contract, checkpoint


def brute_outcomes(rows):
    ok = {k for k, v in rows if v not in ("", "no url") and k % 5 == 0 and k % 13}
    first = {}
    for k, v in rows:
        if k in ok:
            first.setdefault(v, k)
    return {k: "validation_error" if v == "" else "skipped" if v == "v8" or first.get(v, k) < k else "template_error" if v == "no url"
            else "pending" if k % 13 == 0 else "success" if k % 5 == 0 else "failed" for k, v in rows}


@pytest.mark.parametrize("hot_rows", [20, 100_000])
def test_wide_columns_come_last(spark, tmp_path, monkeypatch, hot_rows):
    """States, whichever way a frequent hash takes, are those of a loop over the rows; building them runs no job."""
    monkeypatch.setattr(outcome, "counted_join", functools.partial(counted_join, hot_rows=hot_rows))
    rows, requests, responses, contract, checkpoint = many_requests(spark, str(tmp_path / "requests"))
    spark.sparkContext.setJobGroup("building", "")
    states = row_states(requests, responses, checkpoint)
    outcomes = row_outcomes(requests, responses, contract, checkpoint)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("run", "")
    assert {r["row"]: r["outcome"] for r in states.collect()} == brute_outcomes(rows)
    assert {r["row"]: (r["outcome"], r["_raw_v"]) for r in outcomes.collect()} == {
        k: (brute_outcomes(rows)[k], v) for k, v in rows}
    assert sorted(map(str, outcomes.select(states.columns).collect())) == sorted(map(str, states.collect()))
    assert run_summary(states).first() == run_summary(outcomes).first()

    def steps(df):
        """The plan's lines but for the tables, which name all that they have."""
        return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" not in x]

    # Summaries know no wide column; of the outcomes' joins only the last one has any.
    assert not any("_raw_v" in x for df in (run_summary(states), summary.progress(states)) for x in steps(df))
    joins = [k for k, x in enumerate(steps(outcomes)) if "Join " in x]
    assert max(k for k, x in enumerate(steps(outcomes)) if "_raw_v" in x) < joins[1]


def test_outcomes_of_empty_tables(spark, tmp_path):
    rows, requests, responses, contract, checkpoint = many_requests(spark, str(tmp_path / "requests"))
    assert row_outcomes(requests.limit(0), responses, contract, checkpoint).isEmpty()
    states = row_states(requests, responses.filter("false"), checkpoint.filter("false"))
    assert {r["outcome"] for r in states.collect()} == {"validation_error", "template_error", "pending"}
    assert row_states(requests, responses).count() == 300


def test_report_and_counters_take_one_job(spark, tmp_path):
    contract = type(CONTRACT).from_dict({"version": 1, "columns": [
        {"name": "v", "type": "int", "required": True}, {"name": "w", "type": "string", "required": True}]})
    data = spark.createDataFrame([(k, str(k) if k % 3 else "x", "" if k % 5 == 0 else "w") for k in range(1, 101)], "row bigint, v string, w string")
    validated = validate(data, contract)
    path = str(tmp_path / "report")
    spark.sparkContext.setJobGroup("report", "")
    counters = sinks.write_report(validated, contract, path, F.lit("now"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("report")
    spark.sparkContext.setJobGroup("after", "")
    assert len(jobs) == 1
    assert counters == summary.validation_summary(validated).first().asDict()
    assert counters == {"total": 100, "valid": 53, "invalid": 47, "error_count": 53}
    lines = spark.read.csv(path, header=True).fillna("")
    assert sorted(map(str, lines.collect())) == sorted(map(str, sinks.validation_report(
        validated, contract, F.lit("now")).select(*[F.col(c).cast("string") for c in lines.columns]).collect()))
    with pytest.raises(summary.ContractViolation, match="47 of 100"):
        sinks.write_report(validated, contract, path, F.lit("now"), strict=True)
    assert spark.read.csv(path, header=True).count() == 53
    empty = sinks.write_report(validate(data.limit(0), contract), contract, path, F.lit("now"), strict=True)
    assert empty == {"total": 0, "valid": 0, "invalid": 0, "error_count": 0}
