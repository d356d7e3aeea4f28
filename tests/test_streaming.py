import pytest
from pyspark.sql import functions as F

from rowpact import Contract
from rowpact.operators.lookup import counted_join
from rowpact.streaming import stream

CONTRACT = Contract.from_dict({
    "version": 1,
    "columns": [{"name": "a", "type": "int", "required": True}, {"name": "b", "type": "string"}],
    "row_rules": [{"name": "small", "expr": "CAST(a AS INT) < 100"}],
    "uniqueness": [{"columns": ["a", "b"]}],
})
BATCHES = [
    [(2, "1", "p"), (1, "1", "q"), (3, "x", "r")],
    [(4, "2", "q"), (5, "1", "r"), (6, "500", "s")],
    [(7, "3", "s"), (8, "9", "p"), (0, "1", "z")],
]


@pytest.fixture
def source(spark, tmp_path):
    """A folder with one file per batch and a stream that takes one file at a time."""
    folder = tmp_path / "in"
    schema = "row bigint, a string, b string"

    def add(number):
        part = spark.createDataFrame(BATCHES[number], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))

    def read():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return add, read


def errors(spark, path):
    rows = spark.read.parquet(path).select("row", F.explode("errors").alias("e")).select("row", "e.column")
    return sorted((r["row"], r["column"]) for r in rows.collect())


EXPECTED = [(0, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, ""), (7, "b"), (8, "b")]


def test_first_batch_to_show_a_value_keeps_it(spark, tmp_path, source):
    add, read = source
    out, claims, checkpoint = (str(tmp_path / n) for n in ("out", "claims", "checkpoint"))
    for number in range(3):  # three restarts, one new file each
        add(number)
        stream.unique_stream(read(), CONTRACT, out, claims, checkpoint)
    assert errors(spark, out) == EXPECTED
    assert spark.read.parquet(out).count() == 9


def test_replayed_batch_changes_nothing(spark, tmp_path, source):
    add, read = source
    out, claims = str(tmp_path / "out"), str(tmp_path / "claims")
    add(0)
    stream.unique_stream(read(), CONTRACT, out, claims, str(tmp_path / "c1"))
    before = errors(spark, out)
    stream.unique_stream(read(), CONTRACT, out, claims, str(tmp_path / "c2"))  # batch 0 once more
    assert errors(spark, out) == before
    assert spark.read.parquet(claims).groupBy("_key", "_value").count().filter("count > 1").isEmpty()


def test_stateless_stream_and_summary(spark, tmp_path, source):
    add, read = source
    for number in range(3):
        add(number)
    validated = stream.validate_stream(read(), CONTRACT)
    out = str(tmp_path / "out")
    stream.write_stream(validated, out, str(tmp_path / "c1"))
    assert errors(spark, out) == [(3, "a"), (6, "")]
    latest = str(tmp_path / "latest")
    stream.write_latest(stream.summarize_stream(validated), latest, str(tmp_path / "c2"))
    assert spark.read.parquet(latest).first().asDict() == {"total": 9, "valid": 7, "invalid": 2, "error_count": 2}


def test_resume_forgets_failures(spark, tmp_path, source):
    add, read = source
    out, hashes, checkpoint = (str(tmp_path / n) for n in ("out", "hashes", "checkpoint"))
    for number in range(3):
        add(number)
        requests = read().select("row", F.col("b").alias("request_hash"), F.col("a").cast("string").isin("1", "2", "3").alias("success"))
        stream.resume_stream(requests, out, hashes, checkpoint)
    skipped = {r["row"] for r in spark.read.parquet(out).filter("skipped").collect()}
    # p and q succeed in batch 0, r fails there and succeeds in batch 1, s fails before it succeeds
    assert skipped == {4, 8}


def test_hashes_on_record_are_those_of_successes(spark, tmp_path, source):
    add, read = source
    out, hashes, checkpoint = (str(tmp_path / n) for n in ("out", "hashes", "checkpoint"))
    for number in range(3):
        add(number)
        requests = read().select("row", F.col("b").alias("request_hash"), F.col("a").cast("string").isin("1", "2", "3").alias("success"))
        stream.resume_stream(requests, out, hashes, checkpoint)
    found = [(r["batch"], r["request_hash"]) for r in spark.read.parquet(hashes).collect()]
    assert sorted(found) == [(0, "p"), (0, "q"), (1, "r"), (2, "s"), (2, "z")]


def test_batches_do_not_read_the_history(spark, tmp_path, source):
    """What earlier batches put on record may go: the state is all that later ones need."""
    add, read = source
    out, claims, checkpoint = (str(tmp_path / n) for n in ("out", "claims", "checkpoint"))
    for number in range(3):
        add(number)
        stream.unique_stream(read(), CONTRACT, out, f"{claims}{number}", checkpoint)
    assert errors(spark, out) == EXPECTED


def test_batch_that_fails_is_done_again(spark, tmp_path, source, monkeypatch):
    """The state of a batch that did not end is not kept."""
    add, read = source
    out, claims, checkpoint = (str(tmp_path / n) for n in ("out", "claims", "checkpoint"))
    add(0)
    stream.unique_stream(read(), CONTRACT, out, claims, checkpoint)
    add(1)
    real = stream.append_duplicates

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(stream, "append_duplicates", fail)
    with pytest.raises(Exception, match="lost"):
        stream.unique_stream(read(), CONTRACT, out, claims, checkpoint)
    monkeypatch.setattr(stream, "append_duplicates", real)
    add(2)
    stream.unique_stream(read(), CONTRACT, out, claims, checkpoint)
    assert errors(spark, out) == EXPECTED


def test_frequent_keys_are_joined_by_row(spark):
    left = spark.range(1, 401).select(F.col("id").alias("row"), F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("h"))
    right = left.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    got = counted_join(left, right, "h", ["least"], "n", hot_rows=50)
    expected = {k: None if k % 4 == 0 else 1 if k % 4 < 3 else k for k in range(1, 401)}
    assert {r["row"]: r["least"] for r in got.collect()} == expected
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
