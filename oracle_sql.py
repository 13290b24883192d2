"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Built from small CTE blocks so that every query restates the whole computation
from the raw tables in plain SQL. Conventions shared with the Spark side:
scores rounded to 6 digits before ranking, ties broken by id, ranks BIGINT.
"""

from __future__ import annotations

from quarry import config
from quarry.functions.text import segment_pattern

PATTERN_RE2 = segment_pattern(dialect="re2")
STOP = config.stopwords()
WS_CLASS = r"[\s\p{Z}\x{0B}\x{85}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def toks(col: str, remove_stop: bool = True) -> str:
    base = f"regexp_extract_all(lower(coalesce({col}, '')), {lit(PATTERN_RE2)})"
    if remove_stop:
        base = f"list_filter({base}, lambda t: NOT list_contains({str_list(STOP)}, t))"
    return base


def not_blank(col: str) -> str:
    return f"NOT regexp_matches(coalesce({col}, ''), {lit('^' + WS_CLASS + '*$')})"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, {lit('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


DOCS = "docs AS (SELECT doc_id, text, source, lang AS label FROM documents)"
QUERIES = f"queries AS (SELECT item_id AS query_id, text FROM benchmark WHERE {not_blank('text')})"
USER_TURNS = (
    "queries AS (SELECT (conv_id * 2147483648 + turn)::BIGINT AS query_id, text FROM conversations "
    f"WHERE role = 'user' AND {not_blank('text')})"
)


def tfidf_ctes(min_df: int = 2, max_df: float = 0.9) -> str:
    """d_tf, n_docs, vocab, d_post(doc_id, term, weight), q_w(query_id, term, weight), cos(query_id, doc_id, score)."""
    return f"""
d_tf AS (SELECT doc_id, term, count(*) AS tf
         FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM docs) WHERE length(term) >= 2 GROUP BY ALL),
n_docs AS (SELECT count(*)::BIGINT AS n FROM docs),
vocab AS (SELECT term, count(*)::BIGINT AS df, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
          FROM d_tf, n_docs GROUP BY term, n
          HAVING count(*) >= {min_df} AND count(*) <= {float(max_df)}::DOUBLE * n),
d_w AS (SELECT doc_id, term, tf, tf * idf AS w FROM d_tf JOIN vocab USING (term)),
d_post AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM d_w),
q_tf AS (SELECT query_id, term, count(*) AS tf
         FROM (SELECT query_id, unnest({toks('text')}) AS term FROM queries) WHERE length(term) >= 2 GROUP BY ALL),
q_ww AS (SELECT query_id, term, tf * idf AS w FROM q_tf JOIN vocab USING (term)),
q_w AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM q_ww),
cos AS (SELECT q.query_id, d.doc_id, round(sum(q.weight * d.weight), 6) AS score
        FROM q_w q JOIN d_post d USING (term) GROUP BY ALL)"""


def hash_ctes(dims: int = 64, remove_stop: bool = False, min_len: int = 2) -> str:
    """d_vec(doc_id, b, v), q_vec(query_id, b, v) unit vectors; dense(query_id, doc_id, score)."""
    def enc(tbl: str, idc: str) -> str:
        return f"""(SELECT {idc}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {idc})) AS v FROM (
          SELECT {idc}, b, sum(s) AS v FROM (
            SELECT {idc}, (h % {dims})::INTEGER AS b, CASE WHEN (h // {dims}) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s
            FROM (SELECT {idc}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h
                  FROM (SELECT {idc}, unnest({toks('text', remove_stop)}) AS tok FROM {tbl}) WHERE length(tok) >= {min_len}))
          GROUP BY ALL) WHERE v <> 0)"""
    return f"""
d_vec AS {enc('docs', 'doc_id')},
q_vec AS {enc('queries', 'query_id')},
dense AS (SELECT q.query_id, d.doc_id, round(sum(q.v * d.v), 6) AS score
          FROM q_vec q JOIN d_vec d USING (b) GROUP BY ALL)"""


def full_scores() -> str:
    """Every query x document with both engine scores (0 when absent)."""
    return """
full_s AS (SELECT q.query_id, d.doc_id, coalesce(c.score, 0.0) AS tfidf, coalesce(e.score, 0.0) AS emb
           FROM queries q CROSS JOIN docs d
           LEFT JOIN cos c ON c.query_id = q.query_id AND c.doc_id = d.doc_id
           LEFT JOIN dense e ON e.query_id = q.query_id AND e.doc_id = d.doc_id)"""


def ranked_rrf(k: int) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tfidf DESC, doc_id) AS rank_tfidf,
                     row_number() OVER (PARTITION BY query_id ORDER BY emb DESC, doc_id) AS rank_emb FROM full_s),
fused AS (SELECT *, round(1.0 / (60 + rank_tfidf) + 1.0 / (60 + rank_emb), 6) AS score FROM ranked),
rrf_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused
            QUALIFY rank <= {k})"""


def q_tfidf_topk() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()},
full_t AS (SELECT q.query_id, d.doc_id, coalesce(c.score, 0.0) AS score FROM queries q CROSS JOIN docs d
           LEFT JOIN cos c ON c.query_id = q.query_id AND c.doc_id = d.doc_id)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM full_t)
WHERE rank <= 3"""


def q_rrf_fusion() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {ranked_rrf(10)}
SELECT query_id, doc_id, score, rank_tfidf, rank_emb, rank FROM rrf_top"""


def q_hybrid_rrf() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {ranked_rrf(3)}
SELECT r.query_id, r.doc_id, r.score, r.tfidf, r.emb, r.rank, d.label
FROM rrf_top r JOIN docs d USING (doc_id)"""


def q_clean_text() -> str:
    return f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS clean_text FROM documents"


DICT = str_list([w.lower() for w in config.custom_words()])


def q_segment_dictionary() -> str:
    return f"""SELECT doc_id, len(t)::BIGINT AS n_tokens,
  len(list_filter(t, lambda x: list_contains({DICT}, x)))::BIGINT AS n_dict,
  len(list_filter(t, lambda x: length(x) = 1))::BIGINT AS n_single
FROM (SELECT doc_id, {toks('text', False)} AS t FROM documents)"""


def q_stopword_filter() -> str:
    return f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(k)::BIGINT AS n_kept, (len(t) - len(k))::BIGINT AS n_removed
FROM (SELECT doc_id, {toks('text', False)} AS t, {toks('text', True)} AS k FROM documents)"""


def q_vocab_df() -> str:
    return f"WITH {DOCS}, {QUERIES}, {tfidf_ctes()} SELECT term, df, round(idf, 6) AS idf FROM vocab"


def q_tfidf_weights() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}
SELECT doc_id, term, tf::BIGINT AS tf, round(weight, 6) AS weight FROM d_post"""


def q_doc_top_terms() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}
SELECT doc_id, term, weight, rank FROM (
  SELECT doc_id, term, round(weight, 6) AS weight,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM d_post)
WHERE rank <= 5"""


def q_corpus_stats() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}
SELECT (SELECT count(*) FROM docs)::BIGINT AS n_docs,
       (SELECT count(*) FROM vocab)::BIGINT AS n_features,
       (SELECT sum(len({toks('text', False)})) FROM docs)::BIGINT AS n_tokens,
       {len(STOP)}::BIGINT AS n_stopwords,
       {len(config.custom_words())}::BIGINT AS n_dictionary,
       ((SELECT count(*) FROM docs) - (SELECT count(DISTINCT doc_id) FROM d_post))::BIGINT AS n_docs_without_features"""


def q_feature_sample() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}
SELECT term, rank FROM (SELECT term, row_number() OVER (ORDER BY md5(term), term) AS rank FROM vocab) WHERE rank <= 20"""


def q_snippet() -> str:
    return """SELECT doc_id, source,
  CASE WHEN length(coalesce(text, '')) > 80 THEN substr(coalesce(text, ''), 1, 80) || '...' ELSE coalesce(text, '') END AS snippet
FROM documents"""


def q_column_order() -> str:
    return f"""SELECT (dense_rank() OVER (ORDER BY lang) - 1)::BIGINT AS cluster, text,
  array_to_string({toks('text')}, ' ') AS clean_text, source, doc_id, lang, n_chars FROM documents"""


def q_tfidf_threshold() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()},
full_t AS (SELECT q.query_id, d.doc_id, coalesce(c.score, 0.0) AS score FROM queries q CROSS JOIN docs d
           LEFT JOIN cos c ON c.query_id = q.query_id AND c.doc_id = d.doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM full_t)
        WHERE rank <= 3 AND score > 0.05)
SELECT q.query_id, t.doc_id, t.score, t.rank, t.doc_id IS NULL AS no_result FROM queries q LEFT JOIN top t USING (query_id)"""


def q_duplicate_report() -> str:
    return """SELECT doc_id, first_doc_id, group_size FROM (
  SELECT doc_id, min(doc_id) OVER w AS first_doc_id, count(*) OVER w AS group_size
  FROM documents WINDOW w AS (PARTITION BY text)) WHERE group_size > 1"""


def q_duplicate_listing() -> str:
    return """SELECT text, doc_id, label, first_doc_id, group_size FROM (
  SELECT text, doc_id, lang AS label, min(doc_id) OVER w AS first_doc_id, count(*) OVER w AS group_size
  FROM documents WINDOW w AS (PARTITION BY text)) WHERE group_size > 1 ORDER BY text NULLS LAST, doc_id"""


def q_dedup_exact() -> str:
    return """SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


def q_dedup_stats() -> str:
    return """WITH g AS (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n,
                       row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
SELECT count(*)::BIGINT AS n_before, count(*) FILTER (WHERE n > 1)::BIGINT AS n_duplicate_rows,
       count(*) FILTER (WHERE rn = 1)::BIGINT AS n_after FROM g"""


def _rstrip(col: str) -> str:
    return f"regexp_replace({col}, {lit(WS_CLASS + '+$')}, '')"


def _patch_ctes() -> tuple[str, int]:
    ctes = ["p0 AS (SELECT doc_id, text AS t0 FROM documents)"]
    for i, (_, key, sent) in enumerate(sorted(config.PATCH_EDITS), start=1):
        prev = f"t{i - 1}"
        m = f"coalesce(contains({prev}, {lit(key)}), false)"
        done = f"coalesce(contains({prev}, {lit(sent)}), false)"
        ctes.append(
            f"p{i} AS (SELECT *, {m} AS m{i}, ({m} AND NOT {done}) AS f{i}, "
            f"CASE WHEN {m} AND NOT {done} THEN {_rstrip(prev)} || {lit(sent)} ELSE {prev} END AS t{i} FROM p{i - 1})"
        )
    return ", ".join(ctes), len(config.PATCH_EDITS)


def q_patch_rows() -> str:
    ctes, n = _patch_ctes()
    applied = " + ".join(f"f{i}::INT" for i in range(1, n + 1))
    return f"""WITH {ctes}
SELECT doc_id, t{n} AS text, ({applied})::BIGINT AS n_edits FROM p{n} WHERE ({applied}) > 0"""


def q_patch_report() -> str:
    ctes, n = _patch_ctes()
    parts = []
    for i, (seq, key, _) in enumerate(sorted(config.PATCH_EDITS), start=1):
        parts.append(f"SELECT {seq}::BIGINT AS seq, {lit(key)} AS key, count(*) FILTER (WHERE m{i})::BIGINT AS matched, "
                     f"count(*) FILTER (WHERE f{i})::BIGINT AS patched FROM p{n}")
    body = " UNION ALL ".join(parts)
    return f"""WITH {ctes}, c AS ({body})
SELECT seq, key, matched, patched,
  CASE WHEN matched = 0 THEN 'missing' WHEN matched > 1 THEN 'multi' ELSE 'ok' END AS status FROM c"""


def q_append_if_absent() -> str:
    vals = ", ".join(f"({i}, {lit(m)}, {lit(t)}, {lit(src)}, {lit(lab)})" for i, (m, t, src, lab) in enumerate(config.APPEND_ROWS))
    return f"""WITH RECURSIVE new_rows(pos, marker, text, source, label) AS (VALUES {vals}),
fresh AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM new_rows n
          WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, n.marker))),
steps AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, []::INT[] AS places
  UNION ALL
  SELECT f.k, CASE WHEN len(list_filter(s.taken, lambda t: contains(t, f.marker))) = 0 THEN list_append(s.taken, f.text) ELSE s.taken END,
         CASE WHEN len(list_filter(s.taken, lambda t: contains(t, f.marker))) = 0 THEN list_append(s.places, f.pos) ELSE s.places END
  FROM steps s JOIN fresh f ON f.k = s.k + 1),
final AS (SELECT places FROM steps ORDER BY k DESC LIMIT 1),
absent AS (SELECT fresh.* FROM fresh, final WHERE list_contains(final.places, fresh.pos)),
mx AS (SELECT coalesce(max(doc_id), -1) AS m FROM documents)
SELECT doc_id, text, source, lang AS label FROM documents
UNION ALL
SELECT (mx.m + row_number() OVER (ORDER BY pos))::BIGINT AS doc_id, text, source, label FROM absent, mx"""


def q_version_history() -> str:
    """Counts of each version; markers are looked for in the patched texts, appended rows one after the other."""
    ctes, n = _patch_ctes()
    vals = ", ".join(f"({i}, {lit(m)}, {lit(t)})" for i, (m, t, *_) in enumerate(config.APPEND_ROWS))
    stats = "count(*)::BIGINT AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, coalesce(sum(doc_id), 0)::BIGINT AS sum_ids"
    return f"""WITH RECURSIVE {ctes},
kept AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
patched AS (SELECT doc_id, t{n} AS text FROM p{n} SEMI JOIN kept USING (doc_id)),
new_rows(pos, marker, text) AS (VALUES {vals}),
fresh AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM new_rows n WHERE NOT EXISTS (SELECT 1 FROM patched d WHERE contains(d.text, n.marker))),
steps AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken
  UNION ALL
  SELECT f.k, CASE WHEN len(list_filter(s.taken, lambda t: contains(t, f.marker))) = 0 THEN list_append(s.taken, f.text) ELSE s.taken END
  FROM steps s JOIN fresh f ON f.k = s.k + 1),
last AS (SELECT taken FROM steps ORDER BY k DESC LIMIT 1),
added AS (SELECT (SELECT coalesce(max(doc_id), -1) FROM patched) + generate_subscripts(taken, 1) AS doc_id, unnest(taken) AS text FROM last),
appended AS (SELECT doc_id, text FROM patched UNION ALL SELECT doc_id, text FROM added)
SELECT 'write' AS operation, {stats} FROM documents UNION ALL SELECT 'dedup', {stats} FROM kept
UNION ALL SELECT 'patch', {stats} FROM patched UNION ALL SELECT 'append', {stats} FROM appended"""


EV = """ev AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cm AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT label AS cluster, i, avg(x) AS m FROM ev GROUP BY ALL) GROUP BY cluster),
cn AS (SELECT cluster, list_transform(c, lambda v: v / nrm) AS c FROM (
       SELECT cluster, c, sqrt(list_sum(list_transform(c, lambda w: w * w))) AS nrm FROM cm))"""

NEAR2 = """near AS (SELECT * FROM (SELECT e.vec_id, c.cluster, round(list_distance(e.embedding::DOUBLE[], c.c), 6) AS dist,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.c), 6), c.cluster) AS rank
           FROM embeddings e CROSS JOIN cm c) WHERE rank <= 2)"""


def q_dense_topk() -> str:
    return f"""WITH {EV},
sc AS (SELECT c.cluster::BIGINT AS query_id, e.vec_id AS doc_id, round(list_dot_product(c.c, e.embedding::DOUBLE[]), 6) AS score
       FROM cn c CROSS JOIN embeddings e)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5"""


def q_embed_hash() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {hash_ctes()}
SELECT doc_id, b::BIGINT AS dim, round(v, 6) AS value FROM d_vec"""


def q_nearest_clusters() -> str:
    return f"WITH {EV}, {NEAR2} SELECT vec_id, cluster, dist, rank FROM near"


def q_cluster_pruned_search() -> str:
    return f"""WITH {EV}, {NEAR2},
searched AS (SELECT vec_id AS query_id, string_agg(cluster::VARCHAR, ',' ORDER BY rank) AS clusters_searched FROM near GROUP BY 1),
sc AS (SELECT n.vec_id AS query_id, d.vec_id AS doc_id, d.label AS article_cluster,
              round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
       FROM near n JOIN embeddings q ON q.vec_id = n.vec_id JOIN embeddings d ON d.label = n.cluster),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
        WHERE rank <= 3 AND score > 0.05)
SELECT t.query_id, s.clusters_searched, t.doc_id, t.article_cluster, t.score, t.rank FROM top t JOIN searched s USING (query_id)"""


def q_cluster_sizes() -> str:
    return """SELECT g.c::INTEGER AS cluster, count(e.vec_id)::BIGINT AS size
FROM (SELECT unnest(generate_series(0, (SELECT max(label) FROM embeddings))) AS c) g
LEFT JOIN embeddings e ON e.label = g.c GROUP BY g.c"""


def _cent_terms() -> str:
    return f"""{DOCS}, {QUERIES}, {tfidf_ctes()},
g AS (SELECT doc_id, label AS cluster FROM docs), sz AS (SELECT cluster, count(*) AS n FROM g GROUP BY 1),
cent AS (SELECT cluster, term, round(sum(weight) / n, 6) AS weight FROM d_post JOIN g USING (doc_id) JOIN sz USING (cluster)
         GROUP BY cluster, term, n),
ctop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM cent)
         WHERE rank <= 5)"""


def q_cluster_top_terms() -> str:
    return f"WITH {_cent_terms()} SELECT cluster, term, weight, rank FROM ctop"


def q_cluster_report() -> str:
    return f"""WITH {_cent_terms()}
SELECT s.cluster, s.n::BIGINT AS size, coalesce(t.top_terms, '') AS top_terms FROM sz s
LEFT JOIN (SELECT cluster, string_agg(term, ',' ORDER BY rank) AS top_terms FROM ctop GROUP BY 1) t USING (cluster)"""


def weighted_top(k: int, alpha: float = 0.5) -> str:
    return f"""
st AS (SELECT query_id, min(tfidf) AS lo_t, max(tfidf) AS hi_t, min(emb) AS lo_e, max(emb) AS hi_e FROM full_s GROUP BY 1),
fw AS (SELECT f.*, round({alpha} * ((tfidf - lo_t) / (hi_t - lo_t + 1e-9)) + {1 - alpha} * ((emb - lo_e) / (hi_e - lo_e + 1e-9)), 6) AS score
       FROM full_s f JOIN st USING (query_id)),
w_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fw)
          WHERE rank <= {k})"""


def q_minmax_fusion() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {weighted_top(10)}
SELECT query_id, doc_id, score, tfidf, emb, rank FROM w_top"""


def q_hybrid_weighted() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {weighted_top(3)}
SELECT w.query_id, w.doc_id, w.score, w.tfidf, w.emb, w.rank, d.label FROM w_top w JOIN docs d USING (doc_id)"""


def ws_set(col: str) -> str:
    return (f"list_sort(list_distinct(list_filter(string_split_regex(coalesce({col}, ''), {lit(WS_CLASS + '+')}), "
            f"lambda x: length(x) > 0)))")


def lcs_sql(x: str, y: str) -> str:
    """LCS length by nested list_reduce (row-by-row dynamic programming)."""
    return (f"(CASE WHEN length({y}) = 0 OR length({x}) = 0 THEN 0 ELSE list_reduce(string_split({x}, ''), "
            f"lambda prev, ca: list_reduce(generate_series(1, length({y})), "
            f"lambda cur, j: list_append(cur, CASE WHEN ca = {y}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), "
            f"list_transform(generate_series(0, length({y})), lambda z: 0))[length({y}) + 1] END)")


def token_set_ratio_ctes(pairs: str) -> str:
    """pairs CTE must expose (qt, dt); yields tsr(qt, dt, score)."""
    return f"""
ts_sets AS (SELECT qt, dt, {ws_set('lower(qt)')} AS sa, {ws_set('lower(dt)')} AS sb FROM {pairs}),
ts_parts AS (SELECT *, list_intersect(sa, sb) AS I,
                    list_sort(list_filter(sa, lambda x: NOT list_contains(sb, x))) AS D1,
                    list_sort(list_filter(sb, lambda x: NOT list_contains(sa, x))) AS D2 FROM ts_sets),
ts_len AS (SELECT *, array_to_string(D1, ' ') AS j1, array_to_string(D2, ' ') AS j2,
                  (CASE WHEN len(I) = 0 THEN 0 ELSE length(array_to_string(I, ' ')) END)::DOUBLE AS s,
                  (CASE WHEN len(D1) = 0 THEN 0 ELSE length(array_to_string(D1, ' ')) END)::DOUBLE AS la,
                  (CASE WHEN len(D2) = 0 THEN 0 ELSE length(array_to_string(D2, ' ')) END)::DOUBLE AS lb FROM ts_parts),
ts_l AS (SELECT *, {lcs_sql('j1', 'j2')}::DOUBLE AS lcs, (CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS h FROM ts_len),
ts_r AS (SELECT *, CASE WHEN (s + h + la) + (s + h + lb) > 0 THEN 100.0 * (1.0 - (la + lb - 2.0 * lcs) / ((s + h + la) + (s + h + lb))) ELSE 100.0 END AS r0,
                   100.0 * (1.0 - (1.0 + la) / (s + (s + h + la))) AS r1, 100.0 * (1.0 - (1.0 + lb) / (s + (s + h + lb))) AS r2 FROM ts_l),
tsr AS (SELECT qt, dt, round(CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0
                             WHEN len(I) > 0 AND (len(D1) = 0 OR len(D2) = 0) THEN 100.0
                             WHEN s > 0 THEN greatest(r0, r1, r2) ELSE r0 END, 6) AS score FROM ts_r)"""


def q_fuzzy_topk() -> str:
    return f"""WITH q AS (SELECT min(p_partkey) AS query_id, p_name AS qt FROM part GROUP BY p_name),
fz_pairs AS (SELECT qt, dt FROM (SELECT DISTINCT qt FROM q) CROSS JOIN (SELECT DISTINCT p_name AS dt FROM part)),
{token_set_ratio_ctes('fz_pairs')},
sc AS (SELECT q.query_id, p.p_partkey AS doc_id, t.score FROM q JOIN tsr t ON t.qt = q.qt JOIN part p ON p.p_name = t.dt)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5"""


REL = f"""rel AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
                WHERE {not_blank('b.text')})"""


def q_relevance_pairs() -> str:
    return f"WITH {REL} SELECT query_id AS item_id, doc_id FROM rel"


def _stage_tops() -> str:
    return f"""{DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {ranked_rrf(10)}, {REL},
t_top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tfidf DESC, doc_id) AS rank FROM full_s
          QUALIFY rank <= 10),
e_top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY emb DESC, doc_id) AS rank FROM full_s
          QUALIFY rank <= 10)"""


def _judge(top: str, k: int) -> str:
    return f"""SELECT q.query_id, CASE WHEN q.query_id NOT IN (SELECT query_id FROM rel) THEN NULL
  WHEN EXISTS (SELECT 1 FROM {top} t JOIN rel r ON r.query_id = t.query_id AND r.doc_id = t.doc_id
               WHERE t.query_id = q.query_id AND t.rank <= {k}) THEN 1 ELSE 0 END AS judge FROM queries q"""


def q_recall_at_k() -> str:
    parts = []
    for stage, top in (("tfidf", "t_top"), ("dense", "e_top"), ("hybrid_rrf", "rrf_top")):
        for k in (1, 3, 10):
            parts.append(f"""SELECT '{stage}' AS stage, {k}::BIGINT AS k, count(judge)::BIGINT AS judged,
  coalesce(sum(judge), 0)::BIGINT AS hits, count(*) FILTER (WHERE judge IS NULL)::BIGINT AS skipped,
  CASE WHEN count(judge) > 0 THEN sum(judge)::DOUBLE / count(judge) END AS recall,
  CASE WHEN count(judge) > 0 THEN printf('%.1f%%', sum(judge)::DOUBLE / count(judge) * 100.0) END AS recall_pct
FROM ({_judge(top, k)})""")
    return f"WITH {_stage_tops()} " + " UNION ALL ".join(parts)


def _judged3() -> str:
    return f"""{DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {ranked_rrf(3)}, {REL},
jd AS ({_judge('rrf_top', 3)})"""


def q_eval_misses() -> str:
    return f"WITH {_judged3()} SELECT j.query_id, q.text FROM jd j JOIN queries q USING (query_id) WHERE judge = 0"


def q_judged_export() -> str:
    w = config.JUDGE_WORDS_FIXED
    return f"""WITH {_judged3()}
SELECT j.query_id, q.text, CASE WHEN judge = 1 THEN {lit(w[1])} WHEN judge = 0 THEN {lit(w[0])} ELSE {lit(w[None])} END AS judge
FROM jd j JOIN queries q USING (query_id)"""


_CATEGORY = "cat AS (SELECT rel.query_id, arg_min(d.lang, rel.doc_id) AS category FROM rel JOIN documents d ON d.doc_id = rel.doc_id GROUP BY rel.query_id)"


def q_judging_sheet() -> str:
    return f"""WITH {_judged3()}, {_CATEGORY}
SELECT q.query_id, q.text, CASE WHEN cat.category IS NULL THEN '' ELSE 'category: ' || cat.category END AS reference,
  r.rank, d.lang AS label, round(r.score, 3) AS confidence, d.text AS content
FROM queries q LEFT JOIN cat USING (query_id) LEFT JOIN rrf_top r USING (query_id) LEFT JOIN documents d ON d.doc_id = r.doc_id"""


def q_verdict_export() -> str:
    w = config.JUDGE_WORDS_FIXED
    return f"""WITH {_judged3()}, {_CATEGORY}
SELECT q.query_id, q.text, cat.category, CASE WHEN judge = 1 THEN {lit(w[1])} WHEN judge = 0 THEN {lit(w[0])} ELSE {lit(w[None])} END AS judge
FROM queries q JOIN jd USING (query_id) LEFT JOIN cat USING (query_id)"""


def feat_toks(col: str) -> str:
    return f"list_filter({toks(col)}, lambda x: length(x) >= 2)"


def bigrams_sql(t: str) -> str:
    return f"list_transform(generate_series(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def q_rerank_search() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()}, {hash_ctes()}, {full_scores()}, {ranked_rrf(20)},
cand AS (SELECT query_id, doc_id, tfidf, emb, rank AS rank1 FROM rrf_top),
qf0 AS (SELECT query_id, {feat_toks('text')} AS t FROM queries),
qf AS (SELECT query_id, list_distinct(t) AS qt, list_distinct({bigrams_sql('t')}) AS qb FROM qf0),
df0 AS (SELECT doc_id, {feat_toks('text')} AS t FROM docs WHERE doc_id IN (SELECT doc_id FROM cand)),
dfe AS (SELECT doc_id, list_distinct(t) AS dt, list_distinct({bigrams_sql('t')}) AS db FROM df0),
feat AS (SELECT c.*, CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, dt))::DOUBLE / len(qt) END AS f_cov,
                CASE WHEN len(qb) = 0 THEN 0.0 ELSE len(list_intersect(qb, db))::DOUBLE / len(qb) END AS f_bi
         FROM cand c JOIN qf USING (query_id) JOIN dfe USING (doc_id)),
sc AS (SELECT *, round(1.0 / (1.0 + exp(-(-4.0 + 3.0 * f_cov + 4.0 * f_bi + 2.0 * tfidf + 1.0 * emb))), 6) AS score FROM feat),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1) AS rank FROM sc QUALIFY rank <= 3)
SELECT r.query_id, r.doc_id, r.score, r.rank1, r.rank, d.label FROM rr r JOIN docs d USING (doc_id)"""


def q_index_roundtrip() -> str:
    return f"""WITH {DOCS}, {QUERIES}, {tfidf_ctes()},
pd AS (SELECT doc_id, count(*)::BIGINT AS n_features, round(sum(weight * weight), 6) AS norm2, sum(tf)::BIGINT AS n_feature_tokens
       FROM d_post GROUP BY doc_id)
SELECT d.doc_id, d.source, d.label, coalesce(p.n_features, 0)::BIGINT AS n_features, coalesce(p.norm2, 0.0) AS norm2,
       coalesce(p.n_feature_tokens, 0)::BIGINT AS n_feature_tokens FROM docs d LEFT JOIN pd p USING (doc_id)"""


def q_stream_search() -> str:
    """The stream's answer must equal the batch answer over the same user turns."""
    body = q_rerank_search().replace(QUERIES, USER_TURNS)
    body = body.replace("SELECT r.query_id, r.doc_id, r.score, r.rank1, r.rank, d.label FROM rr r JOIN docs d USING (doc_id)",
                        "SELECT query_id, doc_id, score, rank1, rank FROM rr")
    return body


def all_sql() -> dict[str, str]:
    out = {}
    for name, fn in globals().items():
        if name.startswith("q_") and callable(fn):
            out[name[2:]] = fn()
    return out
