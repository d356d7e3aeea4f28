"""Row contracts on Spark: validation, request preparation and outcome tracking."""

from rowpact.contract import (
    Bounds,
    CleanseRule,
    ColumnSpec,
    Contract,
    ContractError,
    PatternRule,
    RowRule,
    UniqueRule,
)
from rowpact.operators.outcome import collapse_attempts, row_outcomes, row_states
from rowpact.operators.request import RequestSpec, preview, render
from rowpact.operators.summary import (
    ContractViolation,
    first_errors,
    run_summary,
    strict_gate,
    validation_summary,
)
from rowpact.operators.validate import error_rows, invalid_rows, typed, valid_rows, validate
from rowpact.sources.csv import read_csv, read_numbered_csv
from rowpact.sources.sinks import commit_logs, committed, failed_rows, read_log, write_logs, write_report

__all__ = [
    "Bounds", "CleanseRule", "ColumnSpec", "Contract", "ContractError", "ContractViolation",
    "PatternRule", "RequestSpec", "RowRule", "UniqueRule", "collapse_attempts", "commit_logs",
    "committed", "error_rows",
    "failed_rows", "first_errors", "invalid_rows", "preview", "read_csv", "read_log", "read_numbered_csv",
    "render", "row_outcomes", "row_states", "run_summary", "strict_gate", "typed", "valid_rows", "validate",
    "validation_summary", "write_logs", "write_report",
]
