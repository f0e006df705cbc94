"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, i, line, regexp_replace({LOWER.format("line")}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS key
  FROM (SELECT rowid_, doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
        FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
gone AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone USING (key) GROUP BY r, doc_id
"""

OP2 = f"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
items AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
spans AS (
  SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT s.id AS doc_id, s.i, s.n, b.id AS item FROM spans s JOIN items b ON s.win = b.win AND s.n = b.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.id = c.doc_id LEFT JOIN found f ON w.id = f.doc_id WHERE w.kind = 'd'
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM r
"""

OP9 = f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""



def _crc_table() -> list[int]:
    """crc32 of each byte alone, by its rule."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


#: Bytes of letters up to U+00FF, digits and signs, from their code points.
_BYTES = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"

OP12 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS w FROM documents),
occurs AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, c, {_CRC.format("doc_id || ':' || w")} AS h FROM occurs),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
shorter AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON s.d = v.word
  UNION SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON s.d = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
climb AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN climb c USING (word) JOIN forms t ON c.root = t.word WHERE t.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_decontaminate": OP2, "op6_warc": OP6, "op9_exact_dedup": OP9, "op12_spelling": OP12}
