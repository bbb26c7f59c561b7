"""DuckDB SQL of the subpackage's queries."""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
               lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                 lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
part AS (
  SELECT ids.c, o.p, o.r, o.x, 0 AS half FROM ids JOIN own o ON o.c = ids.base AND o.p <= ids.h
  UNION ALL
  SELECT ids.c, o.p, o.r, o.x, 1 FROM ids JOIN own o ON o.c = ids.c AND o.p > ids.h),
seq AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY half, p) AS d, r, x FROM part),
prefix AS (
  SELECT c, d, strlen(x) AS size,
         sha256(string_agg(sha256(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d)) AS node
  FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM ids),
link AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up,
         d = max(d) OVER (PARTITION BY c) AS ends FROM prefix),
node AS (
  SELECT node, any_value(d) AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM link GROUP BY node),
child AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT a.node AS top, sum(n.saved) AS saved, count(*) FILTER (WHERE child.n IS NULL) AS leaves
  FROM node n LEFT JOIN child ON child.up = n.node
  JOIN prefix a ON a.c = n.conv_id AND a.d <= n.depth GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
       coalesce(child.n, 0) AS n_children, below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below ON below.top = n.node LEFT JOIN child ON child.up = n.node LEFT JOIN node u ON u.node = n.up
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
        FROM b WHERE len(w) > 0)),
at AS (
  SELECT k, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT "at".k, "at".i, "at".n, win.item_id FROM "at" JOIN win ON win.n = "at".n AND win.g = "at".g),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
""".replace("\nat AS", '\n"at" AS')

CHAT_FORMAT = """
WITH r AS (
  SELECT conv_id, turn, replace(regexp_replace(coalesce(role, 'unknown'), '[\\r\\n]', ' ', 'g'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
k AS (SELECT *, CASE WHEN turn IS NULL THEN role || chr(1) || text END AS loose FROM r),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, loose ORDER BY turn, role, text) - 1 AS n,
         CAST(floor(min(turn) OVER (PARTITION BY conv_id, loose) / 64) AS BIGINT) AS start FROM k),
s AS (SELECT DISTINCT conv_id, loose, role AS speaker FROM k),
p AS (
  SELECT t.conv_id, t.loose, t.start, t.n, t.n // 64 AS chunk, s.speaker, t.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM t JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.loose IS NOT DISTINCT FROM t.loose),
q AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, loose, speaker, chunk ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM p)
SELECT conv_id, start + chunk AS part, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own_turns,
       string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(begins AS BIGINT) || ':' || CAST(begins + length(body) AS BIGINT) END, ',' ORDER BY n), '') AS mask,
       CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_masked
FROM q GROUP BY conv_id, loose, start, chunk, speaker
"""
