import pytest
from pyspark.sql import functions as F

from rowpact import Contract, read_csv, read_numbered_csv, validate, write_logs, row_outcomes
from rowpact.sources import csv as csv_source, sinks
from rowpact.sources.staging import staging_path
from tests.sample import AS_OF, CONTRACT, ROWS
from tests.test_outcome import sample_requests, sample_responses

PAIR = Contract.from_dict({"version": 1, "columns": [{"name": "a", "type": "string"}, {"name": "b", "type": "string"}]})


@pytest.fixture
def file(tmp_path):
    def write(text, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(text.encode("utf-8"))
        return str(path)
    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sample_file(spark, file):
    text = ("name,phone,birth,gender,token,proxy\n김철수,010-1234-5678,19900315,M,abc123token456,\n"
            "박영희,01098765432,19850720,2,def789token012,http://proxy.example.com:8080\n"
            "이민수,010 9876 5432,19951010,1,ghi345token678,\n최지영,010-5555-1234,20001205,F,, ")
    df = read_numbered_csv(spark, file(text), CONTRACT)
    assert sorted(rows(df)) == ROWS
    assert validate(df, CONTRACT, AS_OF).filter("valid").count() == 3


def test_blanks_quotes_and_empty_fields(spark, file):
    path = file('a,b\n  x , y\n\n"  q ""x"", ",\n"",z \n')
    assert rows(read_csv(spark, path, PAIR)) == [("x ", "y"), ('  q "x", ', ""), ("", "z ")]


def test_line_breaks_inside_quotes(spark, file):
    path = file('a,b\n"one\ntwo",2\n3,"4\r\n5"\n')
    assert rows(read_csv(spark, path, PAIR, multi_line=True)) == [("one\ntwo", "2"), ("3", "4\n5")]


@pytest.mark.parametrize("text", ["a,b\n1\n", "a,b\n1,2,3\n", "a,b\n1,2\n3\n"])
def test_wrong_width_is_fatal(spark, file, text):
    df = read_csv(spark, file(text), PAIR)
    with pytest.raises(Exception, match="MALFORMED"):
        df.select("a").collect()
    assert csv_source.count_rows(spark, file(text), PAIR).first()[0] == text.count("\n") - 1


@pytest.mark.parametrize("header", ["b,a", "a,B", "a", "a,b,c", "a,x"])
def test_header_must_match(spark, file, header):
    path = file(header + "\n1,2\n")
    with pytest.raises(csv_source.HeaderMismatch):
        read_csv(spark, path, PAIR)
    assert not all(r["matches"] for r in csv_source.header_report(spark, path, PAIR).collect())


def test_header_of_every_file_counts(spark, tmp_path, file):
    file("a,b\n1,2\n", "1.csv")
    file("a,c\n1,2\n", "2.csv")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path), PAIR, check=False).collect()


SPLITS = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100",
          "spark.sql.files.minPartitionNum": "64", "spark.sql.leafNodeDefaultParallelism": "12"}


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("before", [{}, {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}])
def test_row_numbers_follow_file_order_however_files_are_split(spark, tmp_path, multi_line, before):
    """The splits change between building and counting: every row stays, numbered 1 to n."""
    from rowpact.plans.frames import orders_raw
    contract = Contract.from_dict({"version": 1, "columns": [{"name": "orderkey", "type": "int"}, {"name": "priority", "type": "string"}]})
    path = str(tmp_path / "orders")
    ordered = orders_raw(spark, "/root/testdata/sf0.001").repartitionByRange(5, "row").sortWithinPartitions("row")
    sinks.write_csv(ordered.select("orderkey", "priority"), path)
    try:
        for key, value in before.items():
            spark.conf.set(key, value)
        numbered = read_numbered_csv(spark, path, contract, multi_line=multi_line)
        for key in before:
            spark.conf.unset(key)
        for change in [{}, SPLITS, {"spark.sql.files.maxPartitionBytes": "700"}]:
            for key, value in change.items():
                spark.conf.set(key, value)
            wrong = numbered.filter("row <> CAST(orderkey AS BIGINT) + 1").count()
            counts = numbered.agg(F.count("*"), F.min("row"), F.max("row"), F.countDistinct("row")).first()
            assert wrong == 0 and tuple(counts) == (1500, 1, 1500, 1500)
    finally:
        for key in SPLITS:
            spark.conf.unset(key)


def test_a_record_is_never_cut_silently(spark, file):
    path = file('a,b\n1,"x\n2,y"\n')
    assert rows(read_csv(spark, path, PAIR)) == [("1", "x\n2,y")]
    with pytest.raises(ValueError, match="odd number of quotes"):
        read_csv(spark, path, PAIR, multi_line=False)


def test_letters_of_the_header_count_in_every_file(spark, tmp_path, file):
    file("a,b\n1,2\n", "1.csv")
    file("A,B\n1,2\n", "2.csv")
    with pytest.raises(csv_source.HeaderMismatch, match="2.csv"):
        read_csv(spark, str(tmp_path), PAIR)


def test_row_number_needs_a_free_name(spark, file):
    contract = Contract.from_dict({"version": 1, "columns": [{"name": "row", "type": "string"}]})
    path = file("row\nx\n")
    with pytest.raises(ValueError, match="row="):
        read_numbered_csv(spark, path, contract)
    assert rows(read_numbered_csv(spark, path, contract, row="n")) == [(1, "x")]


def test_header_only_file(spark, file):
    assert rows(read_numbered_csv(spark, file("a,b\n"), PAIR)) == []


NASTY = [("1", 'line\nbreak'), ("2", 'two\n\nblank, "quoted"\n'), ("3", ""), ("4", '"'), ("5", "x" * 900 + "\n" + "y" * 5000), ("6", " lead"), ("7", '","\n1,2\n"')]


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [1 << 10, 3000, 1 << 16, 128 << 20])
def test_blocks_of_any_size_give_the_same_records(spark, tmp_path, block, end):
    """Quoted line breaks, quotes and blank lines across the bounds of blocks, in files of several sizes."""
    expected = []
    for number, copies in enumerate([4, 0, 1]):
        text = "a,b" + end
        for k in range(copies):
            for key, value in NASTY:
                expected.append((f"{number}-{k}-{key}", value.replace("\r\n", "\n")))
                text += f"{expected[-1][0]},{quoted(value)}{end}" + (end if k % 3 == 0 else "")
        (tmp_path / f"{number}.csv").write_bytes(text.encode())
    conf = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        got = read_numbered_csv(spark, str(tmp_path), PAIR, staging=f"{tmp_path}/../lines{block}")
        count = csv_source.count_rows(spark, str(tmp_path), PAIR).first()[0]
        found = sorted(got.collect())
        assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path), PAIR, staging=f"{tmp_path}/../other{block}").collect()) == sorted(expected)
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert [tuple(r) for r in found] == [(k, *r) for k, r in enumerate(expected, 1)]
    assert count == len(expected)
    if block == 1 << 10:
        assert spark.read.parquet(f"{tmp_path}/../lines{block}-blocks").filter("_inside").count() >= 2


def test_only_lines_of_spanning_records_move(spark, tmp_path, file):
    file('a,b\n' + "".join(f"{k},x\n" for k in range(3000)) + '1,"y\nz"\n')
    plan = read_numbered_csv(spark, str(tmp_path), PAIR, staging=f"{tmp_path}/../moved")._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_line" in x]
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(_file" in x and "_record" in x]) == 1 and not moved


@pytest.mark.parametrize("text", ['a,b\n1,"x\n2,y\n', 'a,b\n1,x"y\n2,z"\n3,4\n', 'a,b\n1,"x"\n"2,y\n'])
def test_quotes_that_cannot_be_told_apart_are_fatal(spark, file, text):
    with pytest.raises(Exception, match="never closed|MALFORMED"):
        read_csv(spark, file(text), PAIR).collect()


def test_headers_of_many_files_in_one_job(spark, tmp_path, file):
    for k in range(80):
        file("\ufeffa,b\n1,2\n" if k % 2 else 'a,"b"\n1,2\n' * 50, f"{k:03d}.csv")
    from rowpact.sources.records import first_records
    assert first_records(spark, str(tmp_path)).count() == 80
    spark.sparkContext.setJobGroup("headers", "")
    csv_source.check_header(spark, str(tmp_path), PAIR)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # however many files: with adaptive execution a job for the shuffle and one for the result
    file('a,"c\nd"\n1,2\n', "077.csv")
    with pytest.raises(csv_source.HeaderMismatch, match=r"'c\\nd'.*077.csv"):
        csv_source.check_header(spark, str(tmp_path), PAIR)


def test_head_rows(spark):
    df = spark.range(1, 100).select(F.col("id").alias("row")).repartition(4)
    assert [r[0] for r in csv_source.head_rows(df, 3).collect()] == [1, 2, 3]


def test_csv_round_trip(spark, tmp_path):
    texts = ['plain', ' padded ', 'com,ma', 'quo"te', 'line\nbreak', '', '한글']
    path = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "a string, b string").coalesce(1), path)
    back = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
            .select("a", F.coalesce("b", F.lit(""))))
    assert [r[1] for r in sorted(back.collect())] == texts


def test_nothing_to_write(spark, tmp_path):
    empty = spark.createDataFrame([], "a string")
    assert not sinks.write_csv_if_any(empty, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_logs_of_a_run(spark, tmp_path):
    requests = sample_requests(spark)
    validated = requests.drop("request", "rendered")
    outcomes = row_outcomes(requests, sample_responses(spark), CONTRACT)
    write_logs(validated, outcomes, CONTRACT, str(tmp_path), F.lit("2025-08-11T17:02:15+09:00"))
    read = lambda name: spark.read.csv(f"{tmp_path}/{name}", header=True, escape='"')
    assert read("sent").columns == ["ts", "row", "request_id", "status_code", "success", "latency_ms", "retries",
                                    "error_category", "error_detail", "response_preview", "request_hash"]
    assert read("sent").count() == 4 and read("request_errors").count() == 4
    assert [tuple(r) for r in read("validate_errors").collect()] == [
        ("2025-08-11T17:02:15+09:00", "3", "phone", "+821098765432", "duplicate value violates uniqueness constraint")]
    assert read("failed_rows").columns == [*CONTRACT.names, "failure_reason"]


def test_secrets_are_masked(spark):
    contract = Contract.from_dict({"version": 1, "columns": [
        {"name": "pin", "type": "int", "secret": True}, {"name": "note", "type": "string", "max_len": 3}]})
    df = spark.createDataFrame([(1, "12a45", "my pin is 7")], "row bigint, pin string, note string")
    log = sinks.validation_log(validate(df, contract), contract, F.lit("t"))
    assert [r["value"] for r in log.orderBy("column").collect()] == ["my*******" + " 7", "12*45"]
    report = sinks.validation_report(validate(df, contract), contract, F.lit("t"), mask_secrets=False)
    assert {r["value"] for r in report.collect()} == {"12a45", "my pin is 7"}


def test_staging_path_is_fresh(spark):
    assert staging_path(spark, "x") != staging_path(spark, "x")
