"""The queries of this subpackage that SQL can express, for DuckDB. They say what comes out, not how."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> str:
    return f"coalesce(regexp_extract_all({LOWER.format(text)}, '{ALNUM}'), [])"


OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {words('text')} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w) q),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
t AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.b), d.doc_id)) AS text_id FROM documents d LEFT JOIN l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1),
k AS (SELECT l.a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN o.text_id END) AS n_text_links FROM l JOIN t o ON o.doc_id = l.b GROUP BY 1)
SELECT doc_id, class_id, text_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links FROM c JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '<', '\l'), '#', '\h')"
OP4 = rf"""WITH raw AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 4 AS tokens FROM raw),
s AS (SELECT *, first_value(CASE WHEN n = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS sys, length('### ' || replace({_ESCAPED.format('role')}, ':', '\c') || ': ' || {_ESCAPED.format('text')} || '</turn>') + 1 AS chars FROM t),
a AS (SELECT *, greatest((832 - sys) // 2, 1) AS stride, n = 1 AND sys > 0 AS led, CASE WHEN n = 1 AND sys > 0 THEN 0 ELSE tokens END AS own, CASE WHEN NOT (n = 1 AND sys > 0) AND tokens > greatest((832 - sys) // 2, 1) THEN 1 ELSE 0 END AS solo FROM s),
b AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY n) - own AS begun, 2 * sum(solo) OVER (PARTITION BY conv_id ORDER BY n) - solo AS segment FROM a),
c AS (SELECT *, floor((begun - min(begun) OVER (PARTITION BY conv_id, segment)) / stride) AS span FROM b),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY segment, span) AS win FROM c),
h AS (SELECT conv_id, win, min(begun) AS start, min(n) AS first FROM d GROUP BY 1, 2 HAVING min(n) > 1),
again AS (SELECT h.conv_id, sum(chars) AS chars FROM h JOIN d ON d.conv_id = h.conv_id AND (d.led OR d.n < h.first AND h.start - d.begun <= 192) GROUP BY 1),
m AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS lost, sum(chars) AS chars FROM d GROUP BY 1)
SELECT m.conv_id, n_turns, sha256(said) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, CAST(m.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars FROM m LEFT JOIN again ON again.conv_id = m.conv_id"""

OP7 = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][k % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / w, k) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, k) - w)) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM v),
p AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS stop, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, least(greatest(stop - place, 0), size) + least(greatest(stop - source_size - place, 0), size) AS taken FROM p"""

OP9 = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
x AS (SELECT DISTINCT item, w[k:k + least(len(w), 10) - 1] AS win FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS k FROM i WHERE len(w) > 0) q),
size AS (SELECT DISTINCT len(win) AS n FROM x),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
o AS (SELECT doc_id, k, n, w[k:k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, size WHERE len(w) >= n) q),
m AS (SELECT doc_id, k, n, item FROM o JOIN x ON x.win = o.win),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS place FROM m) q GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) q GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)"""

ORACLES = {"op2_ngram_jaccard": OP2, "op4_chat_windows": OP4, "op7_source_schedule": OP7, "op9_suffix_decontaminate": OP9}
