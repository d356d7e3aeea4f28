import hashlib

import pytest
from pyspark.sql import functions as F

from rowpact import ContractError, RequestSpec, preview, render, valid_rows, validate
from rowpact.operators.request import request_hash, request_id, request_json
from tests.sample import AS_OF, CONTRACT, PREVIEW, ROWS, SCHEMA, SPEC


@pytest.fixture(scope="module")
def rendered(spark):
    validated = validate(spark.createDataFrame(ROWS, SCHEMA), CONTRACT, AS_OF)
    return render(valid_rows(validated), SPEC, CONTRACT).cache()


def lines(df):
    return [r[0] for r in df.orderBy("row").select(request_json()).collect()]


def test_sample_preview(rendered):
    got = lines(rendered)
    assert got[:2] == PREVIEW and len(got) == 3
    assert '"headers":{"Content-Type":"application/json","User-Agent":"agent/1.0"}' in got[2]


def test_preview_limits_rows_before_validation(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert lines(preview(df, CONTRACT, SPEC, 3, AS_OF)) == PREVIEW
    late = df.filter("row >= 3")  # without row 2 nobody else holds the phone of row 3
    assert [r["row"] for r in preview(late, CONTRACT, SPEC, 3, AS_OF).collect()] == [3]


def expected_hash(data, headers=""):
    text = f"method:POST\nurl:{SPEC.url}\nbody:{SPEC.body}\n{headers}"
    text += "".join(f"data:{k}={data[k]}\n" for k in sorted(data))
    return hashlib.sha256(text.encode()).hexdigest()


def test_hash_covers_definition_and_processed_values(rendered):
    row = rendered.orderBy("row").first()
    data = {n: row[n] for n in CONTRACT.names}
    assert data["phone"] == "+821012345678"
    assert row["request"]["request_hash"] == expected_hash(data)


def test_hash_does_not_depend_on_column_order(rendered):
    names = CONTRACT.names
    assert [r[0] for r in rendered.select(request_hash(SPEC, names)).collect()] == [
        r[0] for r in rendered.select(request_hash(SPEC, names[::-1])).collect()]


def test_hash_with_headers(rendered):
    row = rendered.orderBy("row").select("*", request_hash(SPEC, CONTRACT.names, True).alias("h")).first()
    headers = "".join(f"header:{k}={SPEC.headers[k]}\n" for k in sorted(SPEC.headers))
    assert row["h"] == expected_hash({n: row[n] for n in CONTRACT.names}, headers)


def test_request_id(spark):
    df = spark.createDataFrame([(7, "x", "y")], "row bigint, a string, b string")
    got = df.select(request_id(["a", "b"], prefix="")).first()[0]
    assert got == "req_7_" + hashlib.sha256(b"a=x\nb=y\n").hexdigest()[:16]


def test_rows_that_cannot_be_rendered(spark, rendered):
    spec = RequestSpec(method="PUT", url=F.concat(F.lit("https://x/"), F.nullif("token", F.lit(""))),
                       headers={"X": F.nullif("token", F.lit(""))}, sources={"url": "https://x/{token}"})
    rows = {r["row"]: r["rendered"] for r in render(rendered.drop("request", "rendered"), spec, CONTRACT).collect()}
    assert rows == {1: True, 2: True, 4: False}
    with pytest.raises(ContractError):
        RequestSpec(method="PUT", url=F.lit("x"))


def test_json_escapes(spark):
    df = spark.createDataFrame([(1, "<a&b> \"\\é")], "row bigint, v string")
    spec = RequestSpec(method="POST", url="u", body="{v}")
    contract = type(CONTRACT).from_dict({"version": 1, "columns": [{"name": "v", "type": "string"}]})
    assert lines(render(df, spec, contract)) == [
        '{"body":"\\u003ca\\u0026b\\u003e\\u2028\\"\\\\é","headers":{},"method":"POST","proxy":"","row":1,"url":"u"}']
