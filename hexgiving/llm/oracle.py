"""DuckDB SQL of the queries that SQL can express."""

OP2 = r"""
WITH RECURSIVE
raw AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
        FROM pages),
parsed AS (SELECT page_id, html,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query, rest FROM raw),
p AS (SELECT *, CASE WHEN rest IS NOT NULL THEN host || path || query END AS node FROM parsed),
hrefs AS (SELECT node, host, path, unnest([
        regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:["'']?|"[^">]*\s|''[^''>]*\s)canonical\b[^>]*>'),
                       '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
        regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*'),
                       '(?is)^.*\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS href
        FROM p WHERE node IS NOT NULL),
targets AS (SELECT node, replace(href, '&amp;', '&') AS href, host, path FROM hrefs WHERE href <> ''),
absolute AS (SELECT node, CASE WHEN contains(href, '://') THEN substr(href, strpos(href, '://') + 3)
        WHEN starts_with(href, '//') THEN substr(href, 3) WHEN starts_with(href, '/') THEN host || href
        ELSE host || regexp_replace(path, '[^/]*$', '') || href END AS rest FROM targets),
target AS (SELECT node,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM absolute),
edge AS (SELECT node AS a, host || path || query AS b FROM target),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b),
class AS (SELECT a AS node, min(b) AS c FROM reach GROUP BY a),
rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (SELECT node, host, path FROM p UNION SELECT host || path || query, host, path FROM target),
own AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.action, length(r.host || r.path)) AS action
        FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
        ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL),
class_action AS (SELECT c, min(action) AS action FROM class JOIN urls USING (node) JOIN own USING (host, path) GROUP BY c)
SELECT page_id, p.host, p.path, own.rule, coalesce(own.action, k.action, 'allow') AS verdict,
       own.action IS NULL AND k.action IS NOT NULL AS by_alias
FROM p LEFT JOIN own USING (host, path) LEFT JOIN class USING (node) LEFT JOIN class_action k USING (c)
"""

OP10 = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS u FROM documents),
unit AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS pos FROM split),
placed AS (SELECT doc_id, unit, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos) AS ends,
        trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM unit),
counted AS (SELECT doc_id, ends - length(unit) AS start, ends, norm, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words
        FROM placed),
ranked AS (SELECT *, row_number() OVER w AS rank, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start
        FROM counted WHERE n_words >= 8 WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(ends AS INTEGER) AS "end", CAST(n_words AS INTEGER) AS n_words,
       first_doc_id, CAST(first_start AS INTEGER) AS first_start
FROM ranked WHERE rank > 1
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
digest AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, h,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(
            h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
        row_number() OVER (PARTITION BY payload ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to FROM digest
"""

ORACLE: dict[str, str] = {"op2_url_filter": OP2, "op10_substring_dedup": OP10, "op13_warc_archive": OP13}
