"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

#: CRC-32 of the ASCII text {0}: one polynomial division step for each bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT,
  list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), lambda acc, b:
    list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)),
  4294967295::UBIGINT)::BIGINT"""

_WORD = r"'[^\x20\x09-\x0D]+'"

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT conv_id, coalesce(base.own[1:h], []) || list_slice(t.own, h + 1, len(t.own)) AS seq
  FROM (SELECT *, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM turns) t
  LEFT JOIN (SELECT conv_id AS b, own FROM turns) base ON base.b = t.conv_id - t.conv_id % 20),
members AS (SELECT conv_id, d, list_slice(seq, 1, d) AS prefix, len(seq) = d AS here
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN here THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    bool_and(here) AS leaf,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(prefix[d].text, {_WORD})) END AS saved
  FROM members GROUP BY prefix, d),
up AS (SELECT prefix, d, leaf, saved, list_slice(prefix, 1, a) AS above, a
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes)),
below AS (
  SELECT above, a, sum(CASE WHEN a + 1 = d THEN 1 ELSE 0 END) AS n_children,
    sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM up GROUP BY above, a)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.above = n.prefix AND b.a = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = list_slice(n.prefix, 1, n.d - 1)
"""

PERIODIC_RUNS = f"""
WITH marked AS (
  SELECT doc_id, w, len(w) AS n, h % 10 AS tenth, h // 10 AS g
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    {_CRC.format("doc_id::VARCHAR")} AS h FROM documents)),
placed AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM marked WHERE tenth = 0 AND n > 0),
made AS (
  SELECT doc_id, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w, n
  FROM placed
  UNION ALL SELECT doc_id, w, n FROM marked WHERE NOT (tenth = 0 AND n > 0)),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM made),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT doc_id, start, size + q AS length, min(q) AS period FROM stretches GROUP BY doc_id, start, size + q),
per_doc AS (
  SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.p AS period,
  (-1000 * top.l) // top.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed.text, '')) AS collapsed_sha256
FROM made LEFT JOIN per_doc USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""
