"""CSV tables with a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rowpact.contract import Contract
from rowpact.fixed_values import PREVIEW_ROWS
from rowpact.operators.cleanse import fold_empty
from rowpact.sources.records import blocks_of, files_of, first_records, records, with_facts
from rowpact.sources.staging import staging_path

BOM = "\ufeff"


class HeaderMismatch(ValueError):
    """The header differs from the contract's column names."""


_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
    "columnPruning": False,  # a record of the wrong width must fail whatever is selected
}


def header_fields(spark: SparkSession, path: str, width: int) -> list[str | None]:
    """The first record of the table, with room for one field too many."""
    positions = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width + 1)])
    first = (
        spark.read.schema(positions)
        .options(**{**_OPTIONS, "header": False})
        .option("mode", "PERMISSIVE")
        .csv(path)
        .limit(1)
        .collect()
    )
    return list(first[0]) if first else []


def header_report(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Position by position: expected name, found name, equal or not (case matters)."""
    found = header_fields(spark, path, len(contract.names))
    rows = []
    for i in range(max(len(contract.names), len(found))):
        expected = contract.names[i] if i < len(contract.names) else None
        actual = found[i] if i < len(found) else None
        if expected is not None or actual is not None:
            rows.append((i, expected, actual, expected == actual))
    return spark.createDataFrame(rows, "position int, expected string, found string, matches boolean")


def _named(text: Column, width: int) -> Column:
    """The fields of a header, with room for one too many."""
    names = [f"f{i}" for i in range(width + 1)]
    options = {k: str(v) for k, v in {**_OPTIONS, "header": False, "mode": "PERMISSIVE"}.items()}
    own = F.when(text.startswith(BOM), text.substr(F.lit(2), F.length(text))).otherwise(text)
    found = F.from_csv(own, ", ".join(f"{n} string" for n in names), options)
    return F.array_compact(F.array(*[found[n] for n in names]))


def check_header(spark: SparkSession, path: str, contract: Contract) -> None:
    """The header of every file equals the contract's names, letter by letter; of files that differ the first is named.

    One job, however many files there are. Spark itself compares without case.
    """
    named = first_records(spark, path).select("_file", _named(F.col("_text"), len(contract.names)).alias("_found"))
    wrong = named.filter(F.col("_found") != F.array(*map(F.lit, contract.names)))
    first = wrong.agg(F.min(F.struct("_file", "_found")).alias("w")).first()["w"]
    if first:
        raise HeaderMismatch(f"header {first['_found']} of {first['_file']} does not equal the contract's columns {contract.names}")


def _no_header(contract: Contract) -> Column:
    """Whether a record is data; a header that differs by more than case fails the job, checked or not."""
    named = F.transform(_named(F.col("_text"), len(contract.names)), F.lower)
    wrong = F.raise_error(F.concat(F.lit("the header differs from the contract's columns in "), F.col("_file"))).cast("boolean")
    header = F.when(named == F.array(*[F.lit(n.lower()) for n in contract.names]), F.lit(False)).otherwise(wrong)
    return F.when(F.col("_record") > 1, F.lit(True)).otherwise(header)


def read_csv(
    spark: SparkSession,
    path: str,
    contract: Contract,
    multi_line: bool = True,
    check: bool = True,
    staging: str | None = None,
) -> DataFrame:
    """All-text columns of the contract, '' for empty fields. Any malformed record is fatal.

    Quoted fields may hold line breaks. Files are split into blocks all the same: their lines are written to `staging` once, and
    records are put together from there (see `records`). `multi_line=False` is the caller's promise that no record spans lines: then nothing is
    written, and a line with an odd number of quotes fails the call, which reads the lines once for that. The header of every file is
    compared exactly.
    """
    if multi_line:
        return _numbered(spark, path, contract, check, staging or staging_path(spark, "lines")).select(*[f"`{n}`" for n in contract.names])
    if check:
        check_header(spark, path, contract)
    _check_one_line_records(spark, path)
    raw = (
        spark.read.schema(contract.struct_type())
        .options(**_OPTIONS)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(*[fold_empty(F.col(f"`{n}`")).alias(n) for n in contract.names])


def _check_one_line_records(spark: SparkSession, path: str) -> None:
    """Fails where a line has an odd number of quotes: a record may go on in the next line there."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    if spark.read.text(path).filter(quotes % 2 == 1).limit(1).count():
        raise ValueError(f"{path} has a line with an odd number of quotes: read it with multi_line=True")


def read_numbered_csv(
    spark: SparkSession, path: str, contract: Contract, multi_line: bool = True, check: bool = True,
    staging: str | None = None, row: str = "row",
) -> DataFrame:
    """`read_csv` with a row number: 1, 2, ... in file order, without sorting.

    The files' lines are written to `staging` once. Numbers come from running totals with one row per block and per file, so
    rows move only if they span lines.
    """
    if row in contract.names:
        raise ValueError(f"the contract has a column {row!r}: name the row number otherwise (row=...)")
    if not multi_line:
        _check_one_line_records(spark, path)
    numbered = _numbered(spark, path, contract, check, staging or staging_path(spark, "lines"))
    return numbered.select(F.col("_row").alias(row), *[f"`{n}`" for n in contract.names])


def _numbered(spark: SparkSession, path: str, contract: Contract, check: bool, staging: str) -> DataFrame:
    """_row and the contract's columns."""
    if check:
        check_header(spark, path, contract)
    facts = with_facts(spark, path)
    facts.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(facts.schema).parquet(staging)
    # Small tables beside the lines: one row per block, and one per file.
    blocks_of(staged).write.mode("overwrite").parquet(f"{staging}-blocks")
    blocks = spark.read.schema(blocks_of(staged).schema).parquet(f"{staging}-blocks")
    found = records(staged, blocks)
    base = F.coalesce(F.sum(F.col("_records") - 1).over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files_of(blocks).filter("_records > 0").select("_file", base.alias("_base"))
    options = {k: str(v) for k, v in {**_OPTIONS, "header": False, "mode": "FAILFAST"}.items()}
    schema = ", ".join(f"_field_{k} string" for k in range(len(contract.names)))
    rows = found.filter(_no_header(contract)).join(files, "_file").select(
        (F.col("_base") + F.col("_record") - 1).alias("_row"), F.from_csv("_text", schema, options).alias("_fields"))
    # A CRLF inside quotes reads as a line feed.
    value = lambda k: F.replace(fold_empty(F.col(f"_fields._field_{k}")), F.lit("\r\n"), F.lit("\n"))
    return rows.select("_row", *[value(k).alias(n) for k, n in enumerate(contract.names)])


def count_rows(spark: SparkSession, path: str, contract: Contract, multi_line: bool = True) -> DataFrame:
    """Number of records without the headers; the width of a record does not matter here. Lines are read once and not written.

    Without `multi_line` each line that is not blank is a record.
    """
    facts = with_facts(spark, path)
    if not multi_line:
        facts = facts.withColumns({"_odd": F.lit(False), "_open": F.lit(False)})
    return files_of(blocks_of(facts)).agg(F.coalesce(F.sum(F.greatest(F.col("_records") - 1, F.lit(0))), F.lit(0)).alias("row_count"))


def head_rows(df: DataFrame, n: int = PREVIEW_ROWS, row: str = "row") -> DataFrame:
    """The first `n` input rows, before any validation. Rows are numbered 1, 2, ..., so a filter finds them."""
    return df.filter(F.col(row) <= n).orderBy(row)
