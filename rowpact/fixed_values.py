"""Texts, patterns, codes and formats that results must carry exactly."""

from __future__ import annotations

# --- fixed values: validation messages -------------------------------------------------
MSG_REQUIRED = "required field is missing or empty"
MSG_INT = "invalid integer"
MSG_FLOAT = "invalid float"
MSG_DECIMAL = "invalid decimal"
MSG_DATE = "invalid date format"
MSG_AGE = "invalid age: {age} (must be 0-120)"
MSG_MIN_LEN = "value too short (min {n} characters)"
MSG_MAX_LEN = "value too long (max {n} characters)"
MSG_REGEX = "value does not match required pattern"
MSG_ENUM = "value must be one of: {values}"
MSG_VALIDATOR = "value does not match validation rule"
MSG_RANGE = "value out of range"
MSG_DUPLICATE = "duplicate value violates uniqueness constraint"
MSG_ROW_RULE = "row rule '{name}' failed: {expr}"

# --- fixed values: date handling -------------------------------------------------------
DEFAULT_DATE_LAYOUT = "20060102"
MIN_AGE = 0
MAX_AGE = 120
INPUT_DATE_LAYOUTS = ("20060102", "2006-01-02", "01/02/2006", "02/01/2006")

# --- fixed values: outcomes ------------------------------------------------------------
DEFAULT_SUCCESS_STATUS = (200, 201, 202, 203, 204, 205, 206, 207, 208, 226)
MAX_RETRIES = 3
PREVIEW_CHARS = 200
TOO_MANY_REQUESTS = 429
ERROR_CATEGORIES = (
    ("timeout", "timeout"),
    ("connection refused", "connection_refused"),
    ("no such host", "dns_error"),
    ("context canceled", "canceled"),
    ("context deadline exceeded", "timeout"),
)
CATEGORY_UNKNOWN = "unknown"
CATEGORY_VALIDATION = "validation_error"
CATEGORY_TEMPLATE = "template_error"
DETAIL_VALIDATION = "Row validation failed"
REASON_VALIDATION = "validation_failed"
REASON_REQUEST = "request_failed"

# --- fixed values: output tables -------------------------------------------------------
SENT_COLUMNS = (
    "ts", "row", "request_id", "status_code", "success", "latency_ms",
    "retries", "error_category", "error_detail", "response_preview", "request_hash",
)
REQUEST_ERROR_COLUMNS = (
    "ts", "row", "request_id", "error_category", "error_detail", "status_code",
)
VALIDATION_LOG_COLUMNS = ("ts", "row", "column", "value", "message")
VALIDATION_REPORT_COLUMNS = ("timestamp", "row", "column", "value", "message")
FAILED_REASON_COLUMN = "failure_reason"
PREVIEW_ROWS = 10
FIRST_ERRORS = 5

# --- fixed values: named patterns ------------------------------------------------------
PATTERN_PRESETS = {
    "none": "",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "mobile": r"^01[0-9]-[0-9]{4}-[0-9]{4}$",
    "mobile_digits": r"^01[0-9][0-9]{8}$",
    "korean_name": r"^[가-힣]{2,10}$",
    "latin_name": r"^[a-zA-Z\s]{2,50}$",
    "digits": r"^[0-9]+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "yyyymmdd": r"^[0-9]{8}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "zip": r"^[0-9]{5}$",
}

# --- fixed values: the lines that a request hash is taken of ---------------------------
HASH_HEAD = "method:{method}\nurl:{url}\nbody:{body}\n"
HASH_HEADER = "header:{key}={value}\n"
HASH_VALUE = "data:{name}={value}\n"
