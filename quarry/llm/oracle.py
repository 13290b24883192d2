"""DuckDB SQL for the queries whose results SQL can state."""

from __future__ import annotations

from quarry.llm import secrets
from quarry.llm.warc import ALPHABET


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT p.doc_id AS a, q.doc_id AS b FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id
      GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.m, s.doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a"""

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('{ALPHABET}',
    (((('0x' || substr(x, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p"""


def _found(name: str, pattern: str, group: int, least: int) -> str:
    """A CTE of (doc_id, s, e, v): the pattern's matches in code points."""
    return f"""{name} AS (SELECT doc_id, s::BIGINT AS s, (s + length(m))::BIGINT AS e, v FROM (
  SELECT doc_id, ms[k] AS m, vs[k] AS v, list_sum(list_transform(parts[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda y: length(y))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
    SELECT doc_id, string_split_regex(t, {_lit(pattern)}) AS parts, regexp_extract_all(t, {_lit(pattern)}, 0) AS ms, regexp_extract_all(t, {_lit(pattern)}, {group}) AS vs
    FROM d WHERE regexp_matches(t, {_lit(pattern)})))) WHERE length(v) >= {least})"""


def _op10() -> str:
    ctes = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)", *(_found(k, p, g, n) for k, p, g, n in secrets.BASE)]
    dense = []
    for i, c in enumerate(secrets.CLASSES):
        ctes.append(_found(f"c{i}", f"[{c.members}]+", 0, c.least))
        ctes.append(f"""h{i} AS (SELECT doc_id, s, min(i) AS lo, max(i) AS hi FROM (
  SELECT doc_id, s, i, list_sum(list_transform(list_distinct(w), lambda y: len(list_filter(w, lambda z: z = y)) / {c.window}.0 * -log2(len(list_filter(w, lambda z: z = y)) / {c.window}.0))) AS bits
  FROM (SELECT doc_id, s, i, string_split(substr(v, i + 1, {c.window}), '') AS w FROM (
    SELECT c.doc_id, s, v, unnest(range(0, length(v) - {c.window} + 1)) AS i FROM c{i} c JOIN d ON c.doc_id = d.doc_id
    WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND NOT regexp_matches(substr(t, greatest(s - 7, 1), e - greatest(s - 8, 0)), {_lit(secrets.ALLOWED)})))) WHERE bits >= {c.bits} GROUP BY doc_id, s)""")
        dense.append(f"SELECT doc_id, s + lo AS s, s + hi + {c.window} AS e FROM h{i}")
    base = " UNION ALL ".join(f"SELECT doc_id, s, e, '{k}' AS kind, {i} AS rank FROM {k}" for i, (k, *_) in enumerate(secrets.BASE))
    ctes += [f"base AS ({base})", f"dense AS ({' UNION '.join(dense)})",
             """more AS (SELECT * FROM dense x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)
  AND NOT EXISTS (SELECT 1 FROM dense y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND x.e <= y.e AND (y.s <> x.s OR y.e <> x.e)))""",
             f"every AS (SELECT * FROM base UNION ALL SELECT doc_id, s, e, 'entropy', {len(secrets.BASE)} FROM more)"]
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    ctes += [f"b AS (SELECT doc_id, {', '.join(f'count(*) FILTER (WHERE kind = {_lit(k)}) AS n_{k}' for k, *_ in secrets.BASE)}, {joined} AS j FROM base GROUP BY doc_id)",
             f"a AS (SELECT doc_id, {joined} AS j FROM every GROUP BY doc_id)"]
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, *_ in secrets.BASE)
    return f"""WITH {', '.join(ctes)}
SELECT d.doc_id, {counts}, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(a.j, '') AS spans
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id"""


OP11 = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT k.conv_id, 0 AS own, t.pos, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.h
      UNION ALL SELECT k.conv_id, 1, t.pos, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
s AS (SELECT k.conv_id, coalesce(x.turns, []) AS turns FROM k LEFT JOIN (
        SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY own, pos) AS turns FROM r GROUP BY conv_id) x ON x.conv_id = k.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS seq, len(turns) AS whole FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole = d) AS ends FROM p GROUP BY seq, d),
c AS (SELECT seq[1:d - 1] AS seq, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * strlen(n.seq[n.d].text) ELSE 0 END AS saved FROM n LEFT JOIN c ON c.seq = n.seq AND c.d = n.d),
u AS (SELECT a.seq, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens FROM m a JOIN m b ON b.d >= a.d AND b.seq[1:a.d] = a.seq GROUP BY a.seq, a.d)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.seq = m.seq AND u.d = m.d LEFT JOIN n q ON m.d > 0 AND q.d = m.d - 1 AND q.seq = m.seq[1:m.d - 1]"""

OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*)::HUGEINT AS f FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
s AS (SELECT c.*, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
      FROM c JOIN t USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.m > b.m AND 100 * q.f >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


ORACLE_SQL = {"op12_collocations": OP12, "op11_prefix_trie": OP11, "op4_near_dedup": OP4, "op6_warc": OP6, "op10_secret_scan": _op10()}
