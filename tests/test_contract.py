from decimal import Decimal

import pytest
from pyspark.sql import types as T

from rowpact import Contract, ContractError, RequestSpec

# A stock list: every kind of rule once, as users write it.
STOCK_YAML = r"""
version: 1
null_policy: {treat_empty_as_null: true}
uniqueness:
  - columns: [shelf, article]
    composite: true
columns:
  - {name: article, type: string, required: true, min_len: 3, preprocess: [{remove: ["#", "\t"], trim: true}]}
  - {name: shelf, type: int, enum: ["1", "2", "007"], normalize: {map: {"7": "007"}}}
  - {name: key, type: string, secret: true, validators: [{regex: "^k[0-9]+$", message: "a key"}]}
row_rules:
  - {name: low, expr: "shelf <> '2' OR article < 'm'"}
"""
ORDER_YAML = """
url: "http://stock.example/{article}"
method: PUT
body: "{shelf}"
success: {status_in: [202], response_keys: {done: "yes"}}
"""


def contract(**column):
    return Contract.from_dict({"version": 1, "columns": [{"name": "a", "type": "string", **column}]})


def test_yaml_scalars_stay_text():
    stock = Contract.from_yaml(STOCK_YAML)
    assert stock.names == ["article", "shelf", "key"]
    assert stock.column("shelf").enum == ("1", "2", "007")
    assert stock.column("shelf").normalize == (("7", "007"),)
    assert stock.column("article").preprocess[0].remove == ("#", "\t") and stock.column("article").min_len == 3
    assert stock.secret_names == ["key"] and stock.column("key").validators[0].message == "a key"
    assert stock.unique_keys == (("shelf", "article"),)
    assert stock.row_rules[0].name == "low" and stock.treat_empty_as_null


@pytest.mark.parametrize("source", [
    {"version": 2, "columns": [{"name": "a", "type": "string"}]},
    {"version": 1, "columns": []},
    {"version": 1, "columns": [{"name": "", "type": "string"}]},
    {"version": 1, "columns": [{"name": "a", "type": "string"}, {"name": "a", "type": "int"}]},
])
def test_bad_contracts(source):
    with pytest.raises(ContractError):
        Contract.from_dict(source)


@pytest.mark.parametrize("kind,ok", [
    ("int", True), ("float", True), ("date", True), ("datetime", True), ("decimal(10,2)", True),
    ("decimal( 10 , 2 )", True), ("decimal(2,3)", False), ("decimal(0,0)", False),
    ("decimal(5)", False), ("decimal(5,-1)", False), ("text", False), ("", False), ("Int", False),
])
def test_types(kind, ok):
    if ok:
        assert contract(type=kind).columns[0].type == kind
    else:
        with pytest.raises(ContractError):
            contract(type=kind)


@pytest.mark.parametrize("regex", ["(", "[a", "(?=x)", r"(a)\1", "a**", "x{2000}", "(?<!a)b"])
def test_patterns_that_re2_rejects(regex):
    with pytest.raises(ContractError):
        contract(regex=regex)
    with pytest.raises(ContractError):
        contract(validators=[{"regex": regex}])


def test_layouts_with_names_and_zones():
    assert contract(type="date", format="Mon 2006 15:04Z07:00").columns[0].layout == "Mon 2006 15:04Z07:00"


def test_same_key_twice_counts_once():
    both = Contract.from_dict({
        "version": 1,
        "columns": [{"name": "a", "type": "string"}, {"name": "b", "type": "string"}],
        "uniqueness": [{"columns": ["a", "b"]}, {"columns": ["a"]}, {"columns": ["nowhere"]},
                       {"columns": ["a", "b"], "composite": True}],
    })
    assert both.unique_keys == (("a",), ("b",), ("a", "b"))


def test_schemas():
    c = Contract.from_dict({"version": 1, "columns": [
        {"name": "i", "type": "int"}, {"name": "f", "type": "float"},
        {"name": "d", "type": "decimal(9,3)"}, {"name": "t", "type": "date"},
        {"name": "s", "type": "string", "range": {"min": "1.5"}}]})
    assert {f.dataType for f in c.struct_type()} == {T.StringType()}
    assert [f.dataType for f in c.typed_struct_type()] == [
        T.LongType(), T.DoubleType(), T.DecimalType(9, 3), T.DateType(), T.StringType()]
    assert c.column("s").range.min == Decimal("1.5")
    assert c.column("missing") is None


def test_request_spec():
    order = RequestSpec.from_yaml(ORDER_YAML)
    assert order.status_in == (202,) and order.response_keys == {"done": "yes"} and order.method == "PUT"
    with pytest.raises(ContractError):
        RequestSpec.from_yaml(ORDER_YAML.replace("method: PUT", "method: ''"))
    with pytest.raises(ContractError):
        RequestSpec(method="GET", url="")
    assert RequestSpec(method="GET", url="http://x").status_in == (
        200, 201, 202, 203, 204, 205, 206, 207, 208, 226)
