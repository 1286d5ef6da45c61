"""DuckDB SQL of the queries whose definition SQL can express by other means than the operator's."""

from __future__ import annotations


def crc32_sql(byte_list: str) -> str:
    """The unsigned CRC-32 of a list of bytes."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform({byte_list}, lambda y: y::UBIGINT)), lambda crc, b: {byte}), 4294967295::UBIGINT)"


def utf8_sql(text: str) -> str:
    """The UTF-8 bytes of a text of code points below U+0100."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] WHEN ord(c) < 192 THEN [194, ord(c)] ELSE [195, ord(c) - 64] END))"


#: Single edits by the neighbourhood of deletions.
SPELLING = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
), once AS (
  SELECT run, n, {crc32_sql(utf8_sql("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL)
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM once GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN words AS b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), rows AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM rows
  UNION ALL SELECT chain.word, rows.form FROM chain JOIN rows ON chain.at = rows.word WHERE rows.form IS NOT NULL
)
SELECT rows.*, chain.at AS root FROM rows JOIN chain USING (word) JOIN rows AS last ON chain.at = last.word AND last.form IS NULL
"""

#: Nodes by the joined digests of their turns, subtrees by all pairs of places on the members' paths.
TRIE = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS MATERIALIZED (
  SELECT c, {crc32_sql(utf8_sql("c::VARCHAR"))}::BIGINT % 4 AS h FROM (SELECT DISTINCT c FROM own)
), taken AS (
  SELECT ids.c, lead.i AS p, lead.role, lead.text FROM ids JOIN own AS lead ON lead.c = ids.c - ids.c % 20 AND lead.i < h
), rebuilt AS (
  SELECT * FROM taken UNION ALL
  SELECT own.c, coalesce(n, 0) + own.i - h, role, text FROM own JOIN ids USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM taken GROUP BY c) USING (c) WHERE own.i >= h
), steps AS (
  SELECT c, p + 1 AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    string_agg(md5(role || chr(0) || text), ',') OVER (PARTITION BY c ORDER BY p) AS path FROM rebuilt
), members AS MATERIALIZED (
  SELECT c, depth, words, path, coalesce(lag(path) OVER (PARTITION BY c ORDER BY depth), '') AS parent, max(depth) OVER (PARTITION BY c) AS n FROM steps
  UNION ALL SELECT ids.c, 0, 0, '', NULL, coalesce(n, 0) FROM ids LEFT JOIN (SELECT c, max(depth) AS n FROM steps GROUP BY c) USING (c)
), nodes AS MATERIALIZED (
  SELECT path, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) * (count(*) - 1) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '')) AS ends_sha256
  FROM members GROUP BY path
), children AS (
  SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT DISTINCT a.path, b.path AS below FROM members AS a JOIN members AS b ON a.c = b.c AND a.depth <= b.depth
), totals AS (
  SELECT subtrees.path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM subtrees JOIN nodes ON nodes.path = below LEFT JOIN children ON children.path = below GROUP BY subtrees.path
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes LEFT JOIN nodes AS up ON up.path = nodes.parent LEFT JOIN children ON children.path = nodes.path JOIN totals ON totals.path = nodes.path
"""

#: Similarity of all sets that share a shingle, components by following the links.
NEAR_COPIES = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, coalesce(list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)), []) AS s FROM texts
), classes AS MATERIALIZED (
  SELECT s, len(s) AS n, row_number() OVER () AS v, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (
  SELECT v, n, hash(unnest(s)) AS h FROM classes
), links AS MATERIALIZED (
  SELECT a.v AS a, b.v AS b FROM shingles AS a JOIN shingles AS b ON a.h = b.h AND a.v < b.v
  GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), near AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT v, v AS at FROM classes UNION SELECT reach.v, near.b FROM reach JOIN near ON reach.at = near.a
), known AS (
  SELECT reach.v, min(least) AS component_id FROM reach JOIN classes ON classes.v = reach.at GROUP BY reach.v
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN known USING (v)
"""
