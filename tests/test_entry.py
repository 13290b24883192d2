import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

ROWS_ONLY = {"embed_word2vec", "cluster_fit", "rerank_learned", "blended_search"}
FAST_KEYS = ["tfidf_topk", "clean_text", "vocab_df", "doc_top_terms", "duplicate_report", "patch_report",
             "append_if_absent", "version_history", "patch_rows", "column_order", "dense_topk", "nearest_clusters", "cluster_report", "relevance_pairs", "hybrid_rrf"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"]
    assert df.count() >= 0


def test_every_key_has_oracle_or_is_rows_only():
    from quarry.plans import catalog
    import oracle_sql

    qs, sqls = catalog.REGISTRY, oracle_sql.all_sql()
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(qs) - set(sqls) == ROWS_ONLY


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(n(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_sf0001(spark, key):
    con = duckdb.connect()
    for t in ["documents", "benchmark", "embeddings", "part", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[key](spark, SF001)
    rel = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, rel.fetchall())
