"""SQL for DuckDB of the queries that SQL can express."""

OP1 = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
windows AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT r, k, n, item FROM windows JOIN grams USING (n, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP6 = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM split WHERE len(w) >= 5)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
metrics AS (
  SELECT r, lang, source, base_failed, 'symbol_share' AS metric, 20 AS least, 1000 * n_symbols // greatest(word_chars, 1) AS v FROM based
  UNION ALL SELECT r, lang, source, base_failed, 'dup_line_share', 150, 1000 * n_dup_lines // greatest(n_lines, 1) FROM based
  UNION ALL SELECT r, lang, source, base_failed, 'word_length', 200, 100 * word_chars // greatest(n_words, 1) FROM based),
sketch AS (
  SELECT lang, source, metric, least, v >> greatest(length(bin(v)) - 7, 0) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n
  FROM metrics WHERE NOT base_failed GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total
  FROM sketch),
most AS (
  SELECT lang, source, metric, least, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
  FROM ranked GROUP BY ALL),
above AS (
  SELECT DISTINCT r FROM metrics m JOIN most t
  ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.metric = t.metric
  WHERE v > q3 + 3 * greatest(q3 - q1, t.least))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM above) AS kept
FROM based
"""

OP2 = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, text AS whole_text, string_split(coalesce(text, ''), chr(10)) AS l
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
numbered AS (SELECT r, doc_id, l, unnest(l) AS line, unnest(range(len(l))) AS j FROM split),
trimmed AS (SELECT r, doc_id, j, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM numbered),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY j) - 1 AS p, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM trimmed WHERE t <> ''),
nexts AS (
  SELECT r, doc_id, p, t, w, lead(t) OVER n AS t1, lead(w) OVER n AS w1, lead(t, 2) OVER n AS t2
  FROM full_lines WINDOW n AS (PARTITION BY r ORDER BY p)),
grouped AS (
  SELECT r, doc_id, p, 1 AS n, t AS g FROM nexts WHERE w > 50 UNION ALL
  SELECT r, doc_id, p, 2, t || chr(10) || t1 FROM nexts WHERE w + w1 > 50 UNION ALL
  SELECT r, doc_id, p, 3, t || chr(10) || t1 || chr(10) || t2 FROM nexts WHERE t2 IS NOT NULL),
later AS (
  SELECT r, p, n FROM (SELECT r, p, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, r, p) AS k FROM grouped) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS p FROM later),
marked AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) = 1 THEN 0 ELSE 1 END AS first FROM gone),
counts AS (SELECT r, count(*) AS n_removed, sum(first) AS n_runs FROM marked GROUP BY r),
kept AS (
  SELECT n.r, string_agg(n.line, chr(10) ORDER BY n.j) AS text FROM trimmed n LEFT JOIN full_lines f ON n.r = f.r AND n.j = f.j
  LEFT JOIN gone ON gone.r = n.r AND gone.p = f.p WHERE gone.p IS NULL GROUP BY n.r),
sizes AS (SELECT r, count(*) AS n_lines FROM full_lines GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d JOIN split s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.text IS NOT DISTINCT FROM s.whole_text
LEFT JOIN sizes USING (r) LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

_OP11_ROUND = """
near{k} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cut c JOIN books{k} b ON c.p = b.p AND c.j = b.j GROUP BY ALL) GROUP BY r, p),
"""
_OP11_BOOKS = """
means{k} AS (SELECT n.p, n.e, c.j, CAST(floor(sum(c.x) / count(*)) AS HUGEINT) AS x FROM near{k} n JOIN cut c ON n.r = c.r AND n.p = c.p GROUP BY ALL),
books{n} AS (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e AND b.j = m.j),
"""
OP11 = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbers AS (
  SELECT r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, (SELECT max(len(embedding)) // 16 FROM kept) AS w FROM kept),
cut AS (SELECT r, i // w AS p, i % w AS j, CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) AS x FROM numbers),
books0 AS (SELECT p, r AS e, j, x FROM cut WHERE r < 64),
""" + _OP11_ROUND.format(k=0) + _OP11_BOOKS.format(k=0, n=1) + _OP11_ROUND.format(k=1) + _OP11_BOOKS.format(k=1, n=2) + _OP11_ROUND.format(k=2) + """
coded AS (SELECT r, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
final AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded USING (r), final
"""


def _op13(levels: int = 8) -> str:
    """Trees of up to 16 ** levels nodes, level by level: t of the sources, u of their subroots."""
    def climb(name: str, start: str) -> str:
        steps = [f"{name}0 AS ({start})"]
        for k in range(levels):
            steps.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            steps.append(
                f"{name}a{k} AS (SELECT tree, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,"
                f" coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {name}{k} WHERE n > 1"
                f" WINDOW w AS (PARTITION BY tree, i // 16 ORDER BY i))")
        tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
        return ",\n".join([*steps, f"{name}top AS ({tops})"])

    def fold(name: str, start: str, at: str, tree: str, source: str) -> str:
        steps = [f"{start}0 AS ({source})"]
        for k in range(levels):
            steps.append(
                f"{start}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN a.pre IS NULL THEN folded ELSE sha256(a.pre || folded || a.post) END AS folded,"
                f" proof || coalesce(a.pre || a.post, '') AS proof) FROM {start}{k} f LEFT JOIN {name}a{k} a ON a.tree = {tree} AND a.i = {at} >> {4 * k})")
        return ",\n".join(steps)

    values = "[CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), {text}]"
    leaf = "sha256(list_aggregate(list_transform(" + values + ", lambda x: coalesce(strlen(x) || ':' || x, '-')), 'string_agg', ''))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM (SELECT unnest(range(256)) AS k)),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
hashed AS (
  SELECT d.doc_id, source, {leaf.format(text="text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf.format(text=lower)} END AS claim
  FROM documents d LEFT JOIN crcs USING (doc_id)),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
{climb("t", "SELECT g AS tree, i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM leaves")},
{climb("u", "SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM ttop")},
{fold("t", "f", "f.i", "f.g", "SELECT *, coalesce(claim, leaf) AS folded, '' AS proof FROM leaves")},
{fold("u", "v", "f.g", "0", f"SELECT * FROM f{levels}")}
SELECT doc_id, leaf, ttop.h AS subroot, utop.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = utop.h AS verified
FROM v{levels} JOIN ttop ON ttop.tree = g, utop
"""


OP13 = _op13()

ORACLES = {"op1_decontaminate": OP1, "op2_line_dedup": OP2, "op6_quality_rules": OP6, "op11_vector_codes": OP11, "op13_merkle_manifest": OP13}
