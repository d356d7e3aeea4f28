"""The registered queries as SQL for DuckDB, on the same tables.

Each text is written from the meaning of the query, not derived from the Spark plan.
"""

from __future__ import annotations

AS_OF = "DATE '2000-06-30'"

# The white space characters, and the texts that results carry.
WS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||"
      + "||".join(f"chr({c})" for c in range(8192, 8203))
      + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")

ORDERS_RAW = """
orders_raw AS (
  SELECT o_orderkey + 1 AS row, CAST(o_orderkey AS VARCHAR) AS orderkey,
         CAST(o_custkey AS VARCHAR) AS custkey, o_orderstatus AS status,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
         strftime(o_orderdate, '%Y%m%d') AS odate, o_orderpriority AS priority,
         CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(12,2)) AS amount
  FROM orders)"""


def age(date: str) -> str:
    return (f"(year({AS_OF}) - year({date}) - CASE WHEN strftime({date}, '%m%d') > "
            f"strftime({AS_OF}, '%m%d') THEN 1 ELSE 0 END)")


def age_error(date: str) -> str:
    return (f"CASE WHEN {age(date)} NOT BETWEEN 0 AND 120 THEN 'invalid age: ' || {age(date)} || "
            "' (must be 0-120)' END")


ORDERS_CHECKED = ORDERS_RAW + f""",
orders_checked AS (
  SELECT *, CASE WHEN status = 'P' THEN 'O' ELSE status END AS nstatus,
    CASE WHEN amount NOT BETWEEN 1500 AND 480000 THEN 'value out of range' END AS price_m,
    {age_error('d')} AS odate_m,
    CASE WHEN strlen(priority) > 16 THEN 'value too long (max 16 characters)'
         WHEN NOT regexp_matches(priority, '^[1-5]-[A-Z]+$')
         THEN 'value does not match required pattern' END AS priority_m
  FROM orders_raw),
orders_columns AS (
  SELECT *, coalesce(price_m, odate_m, priority_m) IS NULL AS columns_ok FROM orders_checked),
orders_dups AS (
  SELECT *, columns_ok AND row_number() OVER (PARTITION BY columns_ok, custkey ORDER BY row) > 1 AS dup
  FROM orders_columns),
orders_ruled AS (
  SELECT *, columns_ok AND NOT dup AS unique_ok,
    ({age('d')} BETWEEN 0 AND 4) AS recent_ok,
    NOT (nstatus = 'F' AND amount > 400000) AS big_ok
  FROM orders_dups),
orders_errors AS (
  SELECT row, 1 AS pos, 'price' AS "column", price AS value, price_m AS message
  FROM orders_ruled WHERE price_m IS NOT NULL
  UNION ALL SELECT row, 2, 'odate', odate, odate_m FROM orders_ruled WHERE odate_m IS NOT NULL
  UNION ALL SELECT row, 3, 'priority', priority, priority_m FROM orders_ruled WHERE priority_m IS NOT NULL
  UNION ALL SELECT row, 4, 'custkey', custkey, 'duplicate value violates uniqueness constraint'
  FROM orders_ruled WHERE dup
  UNION ALL SELECT row, 5, '', '', 'row rule ''recent'' failed: age(odate) >= 0 && age(odate) <= 4'
  FROM orders_ruled WHERE unique_ok AND NOT recent_ok
  UNION ALL SELECT row, 6, '', '', 'row rule ''big_finished'' failed: NOT (status = ''F'' AND CAST(price AS DECIMAL(12,2)) > 400000)'
  FROM orders_ruled WHERE unique_ok AND NOT big_ok),
orders_valid AS (SELECT * FROM orders_ruled WHERE unique_ok AND recent_ok AND big_ok)"""

CUSTOMER_RAW = """
customer_raw AS (
  SELECT c_custkey + 1 AS row, chr(9) || ' ' || c_name || ' ' || chr(12288) AS name,
    '010-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-'
      || lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR), 4, '0') AS phone,
    strftime(DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER), '%Y%m%d') AS birth,
    CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS DATE) AS born,
    CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS acctbal, c_mktsegment AS segment,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'token-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) END AS token,
    CASE WHEN c_custkey % 7 = 0 THEN 'http://proxy' || c_nationkey || '.example.com:8080'
         WHEN c_custkey % 11 = 0 THEN 'ftp://old.example.com' ELSE '' END AS proxy,
    c_name, c_nationkey
  FROM customer)"""


def e164(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return (f"CASE WHEN (length({digits}) = 10 AND {digits} LIKE '0%') OR (length({digits}) = 11 "
            f"AND {digits} LIKE '01%') THEN '+82' || substr({digits}, 2) ELSE {digits} END")


def mask(value: str) -> str:
    return (f"CASE WHEN length({value}) <= 4 THEN repeat('*', length({value})) ELSE left({value}, 2) "
            f"|| repeat('*', length({value}) - 4) || right({value}, 2) END")


CUSTOMER_CHECKED = CUSTOMER_RAW + f""",
customer_checked AS (
  SELECT row, name AS raw_name, phone AS raw_phone, birth, acctbal, segment AS raw_segment, token,
    proxy, born, c_nationkey, trim(name, {WS}) AS name, {e164('phone')} AS phone,
    CASE WHEN segment = 'HOUSEHOLD' THEN 'HOME' ELSE segment END AS segment,
    CASE WHEN strlen(trim(name, {WS})) > 50 THEN 'value too long (max 50 characters)'
         WHEN NOT regexp_matches(trim(name, {WS}), '^Customer#[0-9]+$') THEN 'unexpected name' END AS name_m,
    CASE WHEN NOT regexp_matches(replace(phone, '-', ''), '^[0-9]{{10,11}}$')
         THEN '10 or 11 digits expected' END AS phone_m,
    {age_error('born')} AS birth_m,
    CASE WHEN CAST(acctbal AS DECIMAL(12,2)) < -500 THEN 'value out of range' END AS acctbal_m,
    CASE WHEN segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
         THEN 'value must be one of: AUTOMOBILE, BUILDING, FURNITURE, HOME' END AS segment_m,
    CASE WHEN proxy = '' THEN NULL WHEN NOT regexp_matches(proxy, '^https?://.*$')
         THEN 'http or https expected' END AS proxy_m
  FROM customer_raw),
customer_columns AS (
  SELECT *, coalesce(name_m, phone_m, birth_m, acctbal_m, segment_m, proxy_m) IS NULL AS columns_ok
  FROM customer_checked),
customer_dups AS (
  SELECT *, columns_ok AND row_number() OVER (PARTITION BY columns_ok, phone ORDER BY row) > 1 AS dup
  FROM customer_columns),
customer_all AS (
  SELECT *, columns_ok AND NOT dup AND ({age('born')} BETWEEN 0 AND 45) AS ok,
    columns_ok AND NOT dup AND NOT ({age('born')} BETWEEN 0 AND 45) AS rule_broken
  FROM customer_dups),
customer_errors AS (
  SELECT row, 1 AS pos, 'name' AS "column", raw_name AS value, name_m AS message FROM customer_all WHERE name_m IS NOT NULL
  UNION ALL SELECT row, 2, 'phone', raw_phone, phone_m FROM customer_all WHERE phone_m IS NOT NULL
  UNION ALL SELECT row, 3, 'birth', birth, birth_m FROM customer_all WHERE birth_m IS NOT NULL
  UNION ALL SELECT row, 4, 'acctbal', acctbal, acctbal_m FROM customer_all WHERE acctbal_m IS NOT NULL
  UNION ALL SELECT row, 5, 'segment', raw_segment, segment_m FROM customer_all WHERE segment_m IS NOT NULL
  UNION ALL SELECT row, 6, 'proxy', proxy, proxy_m FROM customer_all WHERE proxy_m IS NOT NULL
  UNION ALL SELECT row, 7, 'phone', phone, 'duplicate value violates uniqueness constraint' FROM customer_all WHERE dup
  UNION ALL SELECT row, 8, '', '', 'row rule ''age_range'' failed: age(birth) >= 0 && age(birth) <= 45'
  FROM customer_all WHERE rule_broken)"""

URL_TEXT = "https://api.example.com/customers/{segment:lower}"
BODY_TEXT = ('{{"name":"{name}","phone":"{phone}","born":"{birth:date 2006-01-02T15:04:05Z}",'
             '"segment":"{segment}"}}')
HASH_HEAD = f"'method:POST' || chr(10) || 'url:{URL_TEXT}' || chr(10) || 'body:{BODY_TEXT}' || chr(10)"


def data_lines(columns: dict[str, str]) -> str:
    return " || ".join(f"'data:{k}=' || {columns[k]} || chr(10)" for k in sorted(columns))


CUSTOMER_DATA = {n: n for n in ("name", "phone", "birth", "acctbal", "segment", "token", "proxy")}
ORDERS_DATA = {n: n for n in ("orderkey", "custkey", "status", "price", "odate", "priority")}

HEADERS_JSON = ("'{' || CASE WHEN token <> '' THEN '\"Authorization\":\"Bearer ' || token || '\",' ELSE '' END "
                "|| '\"Content-Type\":\"application/json\",\"X-Phone\":\"' || phone || '\"}'")

REQUESTS = CUSTOMER_CHECKED + f""",
requests AS (
  SELECT *, sha256({HASH_HEAD} || {data_lines(CUSTOMER_DATA)}) AS request_hash,
    'https://api.example.com/customers/' || lower(segment) AS url, {HEADERS_JSON} AS headers,
    '{{"name":"' || name || '","phone":"' || phone || '","born":"' || strftime(born, '%Y-%m-%d')
      || 'T00:00:00Z","segment":"' || segment || '"}}' AS body
  FROM customer_all WHERE ok)"""

ATTEMPTS = """
attempts AS (
  SELECT user_id + 1 AS row, event_id, ts,
    CASE event_type WHEN 'purchase' THEN 200 WHEN 'view' THEN 201 WHEN 'click' THEN 404
                    WHEN 'signup' THEN 503 ELSE 0 END AS status_code,
    CASE WHEN event_type <> 'error' THEN '' ELSE
      CASE event_id % 6 WHEN 0 THEN 'dial tcp: i/o timeout'
        WHEN 1 THEN 'dial tcp 10.0.0.1:443: connect: connection refused'
        WHEN 2 THEN 'dial tcp: lookup api.example.com: no such host'
        WHEN 3 THEN 'context canceled' WHEN 4 THEN 'context deadline exceeded'
        ELSE 'write: broken pipe, token rejected' END END AS error,
    CASE WHEN event_type = 'error' THEN '' ELSE props END AS body
  FROM events)"""


def category(error: str) -> str:
    return (f"CASE WHEN {error} = '' THEN '' WHEN {error} LIKE '%timeout%' THEN 'timeout' "
            f"WHEN {error} LIKE '%connection refused%' THEN 'connection_refused' "
            f"WHEN {error} LIKE '%no such host%' THEN 'dns_error' "
            f"WHEN {error} LIKE '%context canceled%' THEN 'canceled' "
            f"WHEN {error} LIKE '%context deadline exceeded%' THEN 'timeout' ELSE 'unknown' END")


def responses(repeats: str) -> str:
    return ATTEMPTS + f""",
tried AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY ts, event_id) AS n FROM attempts),
final_n AS (
  SELECT row, coalesce(min(n) FILTER (WHERE NOT ({repeats})), max(n)) AS last_n,
         min(ts) AS started_at
  FROM tried WHERE n <= 4 GROUP BY row),
responses AS (
  SELECT t.row, f.started_at, t.ts, t.status_code, t.error = '' AND t.status_code IN (200, 201) AS success,
    CAST(floor((epoch_us(t.ts) - epoch_us(f.started_at)) / 1000) AS BIGINT) AS latency_ms,
    CAST(t.n - 1 AS INTEGER) AS retries,
    coalesce((SELECT max_by(e.error, e.n) FROM tried e WHERE e.row = t.row AND e.n <= f.last_n AND e.error <> ''), '') AS error_detail,
    CASE WHEN t.error <> '' THEN '' WHEN length(t.body) <= 200 THEN t.body ELSE left(t.body, 200) || '...' END AS response_preview
  FROM tried t JOIN final_n f ON t.row = f.row AND t.n = f.last_n)"""


TRANSPORT_REPEATS = "error <> '' AND (status_code = 0 OR status_code BETWEEN 500 AND 599 OR status_code = 429)"
HTTP_REPEATS = "status_code = 0 OR status_code BETWEEN 500 AND 599 OR status_code = 429"
RESPONSES = responses(TRANSPORT_REPEATS)

EARLIER = """
earlier AS (
  SELECT request_hash FROM requests
  WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))"""


def canonical(columns: list[str], raw: dict[str, str] | None = None) -> str:
    raw = raw or {}
    return " || ".join(f"'{c}=' || {raw.get(c, c)} || chr(10)" for c in columns)


CUSTOMER_COLUMNS = list(CUSTOMER_DATA)
RAW_NAMES = {"name": "raw_name", "phone": "raw_phone", "segment": "raw_segment"}

OUTCOMES = REQUESTS + "," + RESPONSES + "," + EARLIER + f""",
answered AS (
  SELECT c.*, q.request_hash, r.started_at, r.ts, r.status_code, r.success, r.latency_ms, r.retries,
    r.error_detail, r.response_preview
  FROM customer_all c LEFT JOIN requests q ON q.row = c.row LEFT JOIN responses r ON r.row = c.row),
outcomes AS (
  SELECT a.*,
    'req_' || row || '_' || substr(sha256({canonical(CUSTOMER_COLUMNS, RAW_NAMES)}), 1, 16) AS request_id,
    CASE WHEN NOT ok THEN 'validation_error'
      WHEN request_hash IN (SELECT request_hash FROM earlier) THEN 'skipped'
      WHEN EXISTS (SELECT 1 FROM answered b WHERE b.ok AND b.success AND b.request_hash = a.request_hash AND b.row < a.row) THEN 'skipped'
      WHEN success IS NULL THEN 'pending' WHEN success THEN 'success' ELSE 'failed' END AS outcome
  FROM answered a),
shown AS (
  SELECT row, request_id, coalesce(request_hash, '') AS request_hash, outcome,
    CASE WHEN outcome IN ('success', 'failed') THEN status_code ELSE 0 END AS status_code,
    outcome = 'success' AS success,
    CASE WHEN outcome IN ('success', 'failed') THEN latency_ms ELSE 0 END AS latency_ms,
    CASE WHEN outcome IN ('success', 'failed') THEN retries ELSE 0 END AS retries,
    CASE WHEN outcome = 'validation_error' THEN 'validation_error'
         WHEN outcome IN ('success', 'failed') THEN {category('error_detail')} ELSE '' END AS error_category,
    CASE WHEN outcome = 'validation_error' THEN 'Row validation failed'
         WHEN outcome IN ('success', 'failed') THEN error_detail ELSE '' END AS error_detail,
    CASE WHEN outcome IN ('success', 'failed') THEN response_preview ELSE '' END AS response_preview,
    CASE WHEN outcome IN ('success', 'failed') THEN started_at END AS started_at,
    CASE WHEN outcome IN ('success', 'failed') THEN ts END AS ts
  FROM outcomes)"""

REASON = ("CASE WHEN outcome = 'validation_error' THEN 'validation_failed' WHEN outcome = 'failed' "
          "THEN CASE WHEN error_category = '' THEN 'request_failed' ELSE error_category END ELSE '' END")
LOGGED = "('success', 'failed', 'validation_error')"


def masked(text: str) -> str:
    return f"CASE WHEN {text} LIKE '%token%' THEN {mask(text)} ELSE {text} END"


PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)"
WHOLE = "CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)"
NUMBER_TEXTS = f"""
number_texts AS (
  SELECT o_orderkey + 1 AS row, o_orderkey % 13 AS form, CASE o_orderkey % 13
    WHEN 0 THEN {PRICE} WHEN 1 THEN {WHOLE} WHEN 2 THEN '+' || {WHOLE} WHEN 3 THEN '-' || {PRICE} || 'e2'
    WHEN 4 THEN ' ' || {WHOLE} || ' ' WHEN 5 THEN {PRICE} || 'd' WHEN 6 THEN {WHOLE} || '.'
    WHEN 7 THEN '.' || {WHOLE} WHEN 8 THEN {WHOLE} || 'e400' WHEN 9 THEN '0x' || {WHOLE} || 'p-2'
    WHEN 10 THEN '-Infinity' WHEN 11 THEN {WHOLE} || '0000000000000000000'
    ELSE substr({WHOLE}, 1, 1) || '_' || {WHOLE} END AS text
  FROM orders)"""
DATE_TEXTS = """
date_texts AS (
  SELECT o_orderkey + 1 AS row, o_orderkey % 8 AS form, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 8
    WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 4 THEN strftime(o_orderdate, '%Y%m32') WHEN 5 THEN strftime(o_orderdate, '%Y0230')
    WHEN 6 THEN ' ' || strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y%m%d0') END AS text
  FROM orders)"""
DATE_VALUE = ("""CASE form WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d
    WHEN 3 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END END""")

EVENT_ROWS = """
event_rows AS (
  SELECT event_id + 1 AS row, CAST(user_id AS VARCHAR) AS "user", event_type AS kind, props,
    CAST(value AS DECIMAL(12,2)) AS amount,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup')
      THEN 'value must be one of: view, click, purchase, signup' END AS kind_m,
    CASE WHEN CAST(value AS DECIMAL(12,2)) > 100 THEN 'value out of range' END AS amount_m,
    CASE WHEN strlen(props) > 10 THEN 'value too long (max 10 characters)'
      WHEN NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$') THEN 'value does not match required pattern' END AS props_m
  FROM events),
event_checked AS (
  SELECT *, coalesce(kind_m, amount_m, props_m) IS NULL AS columns_ok,
    kind <> 'purchase' OR amount >= 1 AS paid FROM event_rows)"""
PAID = "row rule ''paid'' failed: kind <> ''purchase'' OR CAST(amount AS DOUBLE) >= 1"

PRESETS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "mobile": r"^01[0-9]-[0-9]{4}-[0-9]{4}$",
    "mobile_digits": r"^01[0-9][0-9]{8}$",
    "korean_name": r"^[\x{AC00}-\x{D7A3}]{2,10}$",
    "latin_name": r"^[a-zA-Z\s]{2,50}$",
    "digits": r"^[0-9]+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "yyyymmdd": r"^[0-9]{8}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "zip": r"^[0-9]{5}$",
}
DOC_PATTERN = r"(?i)\b(?:licen[sc]e|copyright|email)\b|[.!?]\s+the\b|[a-zäöü]+\.$"
FLAT = "row, 'POST' AS method, url, headers, body, proxy, request_hash"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


def message(source: str, test: str, text: str) -> str:
    return f"SELECT row, CASE WHEN {test} THEN '{text}' ELSE '' END AS message FROM {source}"


def doc(text: str) -> str:
    return f"SELECT doc_id + 1 AS row, sha256({text}) AS text_hash, CAST(length({text}) AS INTEGER) AS n_chars FROM documents"


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


def summary(valid: str, errors: str, total: str) -> str:
    return (f"SELECT (SELECT count(*) FROM {total}) AS total, (SELECT count(*) FROM {valid}) AS valid, "
            f"(SELECT count(*) FROM {total}) - (SELECT count(*) FROM {valid}) AS invalid, "
            f"(SELECT count(*) FROM {errors}) AS error_count")


def oracles() -> dict[str, str]:
    raw_orders = "SELECT orderkey, custkey, status, price, odate, priority FROM orders_raw"
    orders_summary = with_(ORDERS_CHECKED, summary("orders_valid", "orders_errors", "orders_ruled"))
    raw_customer = ("raw_name AS name, raw_phone AS phone, birth, acctbal, raw_segment AS segment, token, proxy")
    names = ["orderkey", "custkey", "status", "price", "odate", "priority"]
    chain = f"trim({replaced(f'trim(text, {WS})', [('chr(10)', chr(39) * 2), (chr(39) + 'a' + chr(39), chr(39) + ' ' + chr(39))])}, {WS})"
    chain = replaced(chain, [("' '", "'_'"), ("'__'", "'-'")])
    fragile = "SELECT row, CASE WHEN token = '' THEN 'template_error' ELSE '' END AS error_category FROM customer_all WHERE ok"
    shown_sent = ("row, request_id, status_code, success, latency_ms, retries, error_category, "
                  f"{masked('error_detail')} AS error_detail, {masked('response_preview')} AS response_preview, request_hash")
    processed = {  # processed values of an invalid row: columns with an error are blank
        "name": "CASE WHEN name_m IS NULL THEN name ELSE '' END",
        "phone": "CASE WHEN phone_m IS NULL THEN phone ELSE '' END",
        "birth": "CASE WHEN birth_m IS NULL THEN birth ELSE '' END",
        "acctbal": "CASE WHEN acctbal_m IS NULL THEN acctbal ELSE '' END",
        "segment": "CASE WHEN segment_m IS NULL THEN segment ELSE '' END",
        "token": "token",
        "proxy": "CASE WHEN proxy_m IS NULL THEN proxy ELSE '' END",
    }
    processed_list = ", ".join(f"{v} AS {k}" for k, v in processed.items())
    profile = ", ".join(
        f"count(*) FILTER (WHERE regexp_matches(value, '{p}')) AS {n}" for n, p in PRESETS.items())
    first_head = "row_number() OVER (PARTITION BY columns_ok, phone ORDER BY row)"
    preview_ctes = CUSTOMER_CHECKED.replace("FROM customer)", "FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) c)")
    preview_requests = REQUESTS.replace(CUSTOMER_CHECKED, preview_ctes)
    assert first_head in preview_ctes
    out = {
        "csv_scan": with_(ORDERS_RAW, raw_orders),
        "header_check": "SELECT * FROM (VALUES " + ", ".join(
            f"({i}, '{n}', '{n}', true)" for i, n in enumerate(names))
            + ") t(position, expected, found, matches)",
        "row_number": "SELECT row_number() OVER (ORDER BY o_orderkey) AS row, CAST(o_orderkey AS VARCHAR) AS orderkey FROM orders",
        "row_count": "SELECT count(*) AS row_count FROM orders",
        "preview_head": with_(ORDERS_RAW, f"SELECT row, {', '.join(names)} FROM orders_raw ORDER BY row LIMIT 10"),
        "request_id": with_(ORDERS_RAW, f"SELECT row, 'req_' || row || '_' || substr(sha256({canonical(names)}), 1, 16) AS request_id FROM orders_raw"),
        "validate_fold": with_(CUSTOMER_CHECKED, "SELECT (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer_all WHERE ok) AS valid, (SELECT count(*) FROM customer_errors) AS error_count"),
        "validation_report": with_(ORDERS_CHECKED, "SELECT '2000-06-30T00:00:00Z' AS timestamp, row, \"column\", value, message FROM orders_errors"),
        "preview_jsonl": with_(REQUESTS, """, lines AS (SELECT '{"body":' || replace(CAST(to_json(body) AS VARCHAR), '&', '\\u0026') || ',"headers":' || headers
            || ',"method":"POST","proxy":"' || proxy || '","row":' || row || ',"url":"' || url || '"}' AS line FROM requests)
            SELECT sha256(line) AS line_hash, CAST(length(line) AS INTEGER) AS line_length FROM lines"""),
        "sent_log": with_(OUTCOMES, f"SELECT {shown_sent} FROM shown WHERE outcome IN {LOGGED}"),
        "request_error_log": with_(OUTCOMES, f"SELECT row, request_id, error_category, {masked('error_detail')} AS error_detail, status_code FROM shown WHERE outcome IN {LOGGED} AND NOT success"),
        "validation_log": with_(CUSTOMER_CHECKED, f"SELECT '2000-06-30T00:00:00Z' AS ts, row, \"column\", {masked('value')} AS value, message FROM customer_errors"),
        "failed_rows": with_(OUTCOMES, f"SELECT {raw_customer}, {REASON} AS failure_reason FROM shown JOIN customer_all USING (row) WHERE {REASON} <> ''"),
        "failed_rows_legacy": with_(OUTCOMES, f""", failed AS (SELECT {processed_list}, {REASON} AS failure_reason FROM shown JOIN customer_all USING (row) WHERE {REASON} <> '')
            SELECT * FROM failed UNION ALL SELECT * REPLACE ('validation_error' AS failure_reason) FROM failed WHERE failure_reason = 'validation_failed'"""),
        "null_policy": "SELECT o_orderkey + 1 AS row, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS priority FROM orders",
        "check_required": with_(CUSTOMER_RAW, message("customer_raw", "token = ''", "required field is missing or empty")),
        "prep_trim": doc(f"trim('x' || chr(12288) || text, 'x' || {WS})").replace("'x' || chr(12288) || text", "text").replace("'x' || ", ""),
        "prep_remove": doc(replaced("text", [("' '", "''"), ("chr(10)", "''"), ("'the'", "''"), ("'é'", "''")])),
        "prep_replace": doc(replaced("text", [("'the'", "'THE'"), ("'THE'", "'{the}'"), ("'é'", "'e'"), ("'.'", "'!'")])),
        "prep_chain": doc(chain),
        "normalize_map": "SELECT o_orderkey + 1 AS row, CASE o_orderstatus WHEN 'P' THEN 'O' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders",
        "check_int": with_(NUMBER_TEXTS, message("number_texts", "NOT (regexp_matches(text, '^[+-]?[0-9]+$') AND TRY_CAST(text AS BIGINT) IS NOT NULL)", "invalid integer")),
        "check_float": with_(NUMBER_TEXTS, message("number_texts", "form IN (4, 5, 8)", "invalid float")),
        "check_decimal": with_(NUMBER_TEXTS, message("number_texts", "NOT regexp_matches(text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')", "invalid decimal")),
        "check_date": with_(DATE_TEXTS, """SELECT row, form = 0 AS compact, form = 1 AS iso,
            form = 2 OR (form = 3 AND day(d) <= 12) AS us, form = 3 OR (form = 2 AND day(d) <= 12) AS european FROM date_texts"""),
        "check_date_zoned": """SELECT row, CASE WHEN form IN (0, 1, 2) THEN strftime(day, '%Y-%m-%d') END AS zoned,
            CASE WHEN form = 3 THEN strftime(day, '%Y-%m-%d') END AS compact, CASE WHEN form = 5 THEN strftime(day, '%Y-%m-%d') END AS half_day,
            CASE WHEN form = 7 THEN strftime(day, '%Y-%m-%d') END AS ordinal, CASE WHEN form = 9 THEN strftime(day, '%Y-%m-%d') END AS named
            FROM (SELECT o_orderkey + 1 AS row, o_orderkey % 10 AS form, CAST(o_orderdate AS DATE) AS day FROM orders)""",
        "check_birth_age": with_(ORDERS_RAW, f"SELECT row, coalesce({age_error('d')}, '') AS message FROM orders_raw"),
        "check_min_len": message("(SELECT doc_id + 1 AS row, text FROM documents)", "text <> '' AND strlen(text) < 800", "value too short (min 800 characters)"),
        "check_max_len": message("(SELECT doc_id + 1 AS row, text FROM documents)", "strlen(text) > 2000", "value too long (max 2000 characters)"),
        "check_regex": message("(SELECT doc_id + 1 AS row, text FROM documents)", f"text <> '' AND NOT regexp_matches(text, '{DOC_PATTERN}')", "value does not match required pattern"),
        "check_enum": message("(SELECT doc_id + 1 AS row, lang FROM documents)", "lang NOT IN ('en', 'de', 'fr')", "value must be one of: en, de, fr"),
        "check_validators": with_(CUSTOMER_RAW, message("customer_raw", "proxy <> '' AND NOT regexp_matches(proxy, '^https?://.*$')", "http or https expected")),
        "check_range_texts": with_(NUMBER_TEXTS, message("number_texts", """coalesce(CASE
            WHEN form IN (4, 5, 8, 10, 11) THEN true
            WHEN form = 9 THEN CAST(replace(text, 'p-2', '') AS BIGINT) / 4.0 > 200000
            ELSE CAST(replace(text, '_', '') AS DOUBLE) NOT BETWEEN -500 AND 200000 END, true)""", "value out of range")),
        "check_range": with_(ORDERS_RAW, message("orders_raw", "amount NOT BETWEEN 1500 AND 480000", "value out of range")),
        "preset_profile": with_(CUSTOMER_RAW, f""", texts AS (
            SELECT 'name' AS column_name, trim(name, {WS}) AS value FROM customer_raw UNION ALL SELECT 'phone', phone FROM customer_raw
            UNION ALL SELECT 'birth', birth FROM customer_raw UNION ALL SELECT 'segment', segment FROM customer_raw
            UNION ALL SELECT 'proxy', proxy FROM customer_raw UNION ALL SELECT 'url', url FROM pages)
            SELECT column_name, {profile} FROM texts GROUP BY column_name"""),
        "e164_kr": with_(CUSTOMER_RAW, f"SELECT row, {e164('phone')} AS phone FROM customer_raw"),
        "first_error": with_(ORDERS_CHECKED, "SELECT row, coalesce(price_m, odate_m, priority_m, '') AS message FROM orders_checked"),
        "row_errors": with_(CUSTOMER_CHECKED, """SELECT c.row, CAST(count(e.row) AS INTEGER) AS error_count,
            coalesce(string_agg(e."column", ',' ORDER BY pos), '') AS columns, coalesce(string_agg(message, '|' ORDER BY pos), '') AS messages
            FROM customer_all c LEFT JOIN customer_errors e ON e.row = c.row AND pos <= 6 GROUP BY c.row"""),
        "error_rows": with_(ORDERS_CHECKED, "SELECT row, \"column\", value, message FROM orders_errors"),
        "valid_rows": with_(CUSTOMER_CHECKED, "SELECT row, name, phone, birth, acctbal, segment, token, proxy FROM customer_all WHERE ok"),
        "invalid_rows": with_(CUSTOMER_CHECKED, f"SELECT row, {raw_customer} FROM customer_all WHERE NOT ok"),
        "typed_rows": with_(ORDERS_CHECKED, "SELECT row, CAST(orderkey AS BIGINT) AS orderkey, CAST(custkey AS BIGINT) AS custkey, nstatus AS status, price, CAST(d AS VARCHAR) AS odate FROM orders_valid"),
        "unique_single": with_(ORDERS_RAW, "SELECT row, row_number() OVER (PARTITION BY custkey ORDER BY row) > 1 AS dup_custkey FROM orders_raw"),
        "unique_multi": with_(ORDERS_RAW, """SELECT row, row_number() OVER (PARTITION BY custkey ORDER BY row) > 1 AS dup_custkey,
            row_number() OVER (PARTITION BY price ORDER BY row) > 1 AS dup_price,
            row_number() OVER (PARTITION BY odate ORDER BY row) > 1 AS dup_odate FROM orders_raw"""),
        "unique_in_place": with_(ORDERS_RAW, """SELECT row, row_number() OVER (PARTITION BY custkey ORDER BY row) > 1 AS dup_custkey,
            row_number() OVER (PARTITION BY price ORDER BY row) > 1 AS dup_price,
            row_number() OVER (PARTITION BY odate ORDER BY row) > 1 AS dup_odate FROM orders_raw"""),
        "unique_composite": with_(ORDERS_RAW, "SELECT row, row_number() OVER (PARTITION BY custkey, status ORDER BY row) > 1 AS dup_pair FROM orders_raw"),
        "row_rules": with_(ORDERS_CHECKED, """SELECT row, 'row rule ''recent'' failed: age(odate) >= 0 && age(odate) <= 4' AS message FROM orders_ruled WHERE columns_ok AND NOT recent_ok
            UNION ALL SELECT row, 'row rule ''big_finished'' failed: NOT (status = ''F'' AND CAST(price AS DECIMAL(12,2)) > 400000)' FROM orders_ruled WHERE columns_ok AND NOT big_ok"""),
        "row_rule_age": with_(CUSTOMER_RAW, f"SELECT row, {age('born')} BETWEEN 0 AND 45 AS holds FROM customer_raw"),
        "age_years": with_(CUSTOMER_RAW, f"SELECT row, CAST({age('born')} AS INTEGER) AS age FROM customer_raw"),
        "fn_date_format": with_(DATE_TEXTS, f"""SELECT row, coalesce(strftime({DATE_VALUE}, '%Y-%m-%dT00:00:00Z'), text) AS stamp,
            coalesce(strftime({DATE_VALUE}, '%d.%m.%y'), text) AS short FROM date_texts"""),
        "fn_date_format_zoned": """SELECT row, strftime(day, '%Y-%m-%dT00:00:00Z') AS zoned, strftime(day, '%a, %d %b %Y 00:00:00 +0000') AS mail,
            strftime(day, '%A ') || lpad(CAST(day(day) AS VARCHAR), 2, ' ') || strftime(day, ' %B %Y 12:00AM UTC') AS long, strftime(day, '%Y-%j 00.000') AS ordinal
            FROM (SELECT o_orderkey + 1 AS row, CAST(o_orderdate AS DATE) AS day FROM orders)""",
        "fn_e164": with_(CUSTOMER_RAW, f"SELECT row, 'tel:' || {e164('phone')} || ';seg=' || segment AS phone FROM customer_raw"),
        "fn_mask": with_(CUSTOMER_RAW, f"SELECT row, {mask('token')} AS token, {mask('segment')} AS segment, {mask('left(phone, 3)')} AS prefix FROM customer_raw"),
        "fn_hash": "SELECT doc_id + 1 AS row, sha256(text) AS digest FROM documents",
        "fn_case": with_(CUSTOMER_RAW, "SELECT row, upper(name) AS upper_name, lower(segment) AS lower_segment FROM customer_raw"),
        "fn_trim": with_(CUSTOMER_RAW, f"SELECT row, trim(name, {WS}) AS name FROM customer_raw"),
        "fn_interpolate": with_(ORDERS_RAW, """SELECT row, '{"order":' || orderkey || ',"by":"' || custkey || '","on":"' || strftime(d, '%Y-%m-%d') || '"}' AS text FROM orders_raw"""),
        "fn_if_present": with_(CUSTOMER_RAW, "SELECT row, CASE WHEN token <> '' THEN 'Bearer ' || token ELSE 'anonymous' END AS authorization FROM customer_raw"),
        "json_valid": """SELECT event_id, json_valid(CASE event_id % 6 WHEN 1 THEN props || ' x' WHEN 2 THEN '[' || props || ',1]'
            WHEN 3 THEN replace(props, '"', '''') WHEN 4 THEN props || ',' || props WHEN 5 THEN replace(props, '}', '') ELSE props END) AS well_formed FROM events""",
        "render_requests": with_(REQUESTS, f"SELECT {FLAT} FROM requests"),
        "render_headers": with_(CUSTOMER_RAW, f"SELECT row, {HEADERS_JSON} AS headers FROM customer_raw"),
        "request_hash": with_(ORDERS_RAW, f"SELECT row, sha256({HASH_HEAD} || {data_lines(ORDERS_DATA)}) AS request_hash FROM orders_raw"),
        "request_hash_hdr": with_(ORDERS_RAW, f"""SELECT row, sha256({HASH_HEAD} || 'header:Authorization={{token:if Bearer {{token}}}}' || chr(10)
            || 'header:Content-Type=application/json' || chr(10) || 'header:X-Phone={{phone}}' || chr(10) || {data_lines(ORDERS_DATA)}) AS request_hash FROM orders_raw"""),
        "preview": with_(preview_requests, f"SELECT {FLAT} FROM requests"),
        "template_errors": with_(CUSTOMER_CHECKED, fragile),
        "status_success": with_(ATTEMPTS, "SELECT event_id, status_code IN (200, 201) AS success FROM attempts"),
        "status_default": with_(ATTEMPTS, "SELECT event_id, status_code BETWEEN 200 AND 208 OR status_code = 226 AS success FROM attempts"),
        "response_keys": with_(ATTEMPTS, "SELECT event_id, status_code IN (200, 201) AND CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.k') = '42', false) ELSE false END AS success FROM attempts"),
        "error_category": with_(ATTEMPTS, f"SELECT event_id, {category('error')} AS category FROM attempts"),
        "response_preview": "SELECT doc_id + 1 AS row, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS preview FROM documents",
        "retryable": with_(ATTEMPTS, f"SELECT event_id, {HTTP_REPEATS} AS retryable FROM attempts"),
        "retry_collapse": with_(RESPONSES, f"SELECT row, status_code, success, latency_ms, retries, {category('error_detail')} AS error_category, error_detail, response_preview FROM responses"),
        "retry_collapse_http": with_(responses(HTTP_REPEATS), f"SELECT row, status_code, success, retries, {category('error_detail')} AS error_category FROM responses"),
        "row_outcome": with_(OUTCOMES, "SELECT row, outcome, status_code, success, latency_ms, retries, error_category, error_detail, request_hash FROM shown"),
        "failure_reason": with_(OUTCOMES, f"SELECT row, {REASON} AS failure_reason FROM shown"),
        "first_header": "SELECT event_id, 'application/json' AS content_type, CAST(event_id AS VARCHAR) AS trace, 2 AS n_headers FROM events",
        "resume_anti": with_(REQUESTS + "," + EARLIER, "SELECT row, request_hash FROM requests WHERE request_hash NOT IN (SELECT request_hash FROM earlier)"),
        "resume_skipped": with_(REQUESTS + "," + EARLIER, "SELECT row, request_hash FROM requests WHERE request_hash IN (SELECT request_hash FROM earlier)"),
        "checkpoint_set": with_(OUTCOMES, "SELECT DISTINCT request_hash FROM shown WHERE success"),
        "inrun_skip": "SELECT event_id + 1 AS row, coalesce(min(CASE WHEN event_type IN ('purchase', 'view') THEN event_id END) OVER (PARTITION BY user_id) < event_id, false) AS repeated FROM events",
        "dict_join": "SELECT c_custkey + 1 AS row, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 4",
        "validate_summary": orders_summary,
        "validate_staged": orders_summary,
        "validate_in_place": orders_summary,
        "validate_observed": orders_summary,
        "first_errors": with_(ORDERS_CHECKED, """, ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY pos) - 1 AS place FROM orders_errors)
            SELECT row, CAST(place AS INTEGER) AS pos, "column", value, message FROM ranked ORDER BY row, place LIMIT 5"""),
        "run_summary": with_(OUTCOMES, """SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS success,
            count(*) FILTER (WHERE outcome IN ('failed', 'validation_error')) AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
            CAST(0 AS BIGINT) AS template_errors, count(*) FILTER (WHERE outcome = 'pending') AS pending,
            CAST(floor((epoch_us(max(ts)) - epoch_us(min(started_at))) / 1000) AS BIGINT) AS duration_ms FROM shown"""),
        "strict_gate": with_(ORDERS_CHECKED, "SELECT count(*) = 0 AS passed, count(*) AS invalid FROM (SELECT DISTINCT row FROM orders_errors)"),
        "mask_log": with_(ATTEMPTS, f"SELECT event_id, {masked('error')} AS error_detail FROM attempts"),
        "mask_values": with_(CUSTOMER_RAW, f"SELECT row, 'token' AS column_name, {mask('token')} AS value FROM customer_raw UNION ALL SELECT row, 'segment', segment FROM customer_raw"),
        "progress": with_(OUTCOMES, "SELECT count(*) FILTER (WHERE outcome <> 'pending') AS processed, count(*) AS total, count(*) FILTER (WHERE outcome <> 'pending') / count(*) AS fraction FROM shown"),
        "stream_validate": with_(EVENT_ROWS, f"""SELECT row, columns_ok AND paid AS valid, CASE WHEN columns_ok THEN CASE WHEN paid THEN '' ELSE '{PAID}' END
            ELSE concat_ws('|', kind_m, amount_m, props_m) END AS messages FROM event_checked"""),
        "stream_summary": with_(EVENT_ROWS, """SELECT count(*) AS total, count(*) FILTER (WHERE columns_ok AND paid) AS valid,
            count(*) FILTER (WHERE NOT (columns_ok AND paid)) AS invalid,
            CAST(sum(CASE WHEN columns_ok THEN CASE WHEN paid THEN 0 ELSE 1 END ELSE (kind_m IS NOT NULL)::INT + (amount_m IS NOT NULL)::INT + (props_m IS NOT NULL)::INT END) AS BIGINT) AS error_count FROM event_checked"""),
        "stream_unique": with_(EVENT_ROWS, """, flagged AS (SELECT *, columns_ok AND row_number() OVER (PARTITION BY columns_ok, "user" ORDER BY row) > 1 AS dup_user,
            columns_ok AND row_number() OVER (PARTITION BY columns_ok, props ORDER BY row) > 1 AS dup_props FROM event_checked)
            SELECT row, columns_ok AND paid AND NOT dup_user AND NOT dup_props AS valid,
            CASE WHEN columns_ok AND NOT dup_user AND NOT dup_props THEN '' WHEN columns_ok THEN concat_ws(',', CASE WHEN dup_user THEN 'user' END, CASE WHEN dup_props THEN 'props' END)
            ELSE concat_ws(',', CASE WHEN kind_m IS NOT NULL THEN 'kind' END, CASE WHEN amount_m IS NOT NULL THEN 'amount' END, CASE WHEN props_m IS NOT NULL THEN 'props' END) END AS columns FROM flagged"""),
        "stream_resume": "SELECT event_id + 1 AS row, coalesce(min(CASE WHEN event_type IN ('purchase', 'view') THEN event_id END) OVER (PARTITION BY user_id) < event_id, false) AS skipped FROM events",
    }
    return out
