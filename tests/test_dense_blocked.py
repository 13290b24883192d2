"""The blocked dense product (no broadcast of the query matrix) equals the broadcast kernel."""
import numpy as np
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.operators import dense_block as DB
from quarry.operators import fusion as FU
from quarry.plans import hybrid as H
from quarry.sources import corpus as C
from conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_blocked_equals_broadcast(spark, index001, monkeypatch):
    qs = C.read_benchmark_queries(spark, SF001)
    cfg = SearchConfig()
    want_dense = _rows(H.dense_search(index001, qs, cfg, k=5), ["query_id", "doc_id", "score", "rank"])
    want_rrf = _rows(H.rrf_search(index001, qs, cfg, k=5), ["query_id", "doc_id", "score", "rank_tfidf", "rank_emb"])
    want_w = _rows(H.weighted_search(index001, qs, cfg, k=3), ["query_id", "doc_id", "score"])

    # force the blocked path with small blocks: several query and document blocks, several chunks per group
    monkeypatch.setattr(DB, "MAX_QUERY_CELLS", 0)
    monkeypatch.setattr(DB, "QUERY_BLOCK_ROWS", 7)
    monkeypatch.setattr(DB, "DOC_BLOCK_ROWS", 60)
    monkeypatch.setattr(DB, "DOC_CHUNK_ROWS", 16)
    assert DB.query_matrix(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")) is None

    assert _rows(H.dense_search(index001, qs, cfg, k=5), ["query_id", "doc_id", "score", "rank"]) == want_dense
    assert _rows(H.rrf_search(index001, qs, cfg, k=5),
                 ["query_id", "doc_id", "score", "rank_tfidf", "rank_emb"]) == want_rrf
    assert _rows(H.weighted_search(index001, qs, cfg, k=3), ["query_id", "doc_id", "score"]) == want_w


def test_blocked_pairs_every_pair(spark, index001, monkeypatch):
    monkeypatch.setattr(DB, "QUERY_BLOCK_ROWS", 3)
    monkeypatch.setattr(DB, "DOC_BLOCK_ROWS", 50)
    monkeypatch.setattr(DB, "DOC_CHUNK_ROWS", 8)
    # queries from the same frame as the documents (documents against documents)
    qv = index001.doc_vec.filter(F.col("doc_id") % 37 == 0).withColumnRenamed("doc_id", "query_id")
    n_q = qv.count()
    got = DB.blocked_pairs(index001.doc_vec, qv, index001.n_docs, n_q)
    assert got.count() == n_q * index001.n_docs
    assert got.select("query_id", "doc_id").distinct().count() == n_q * index001.n_docs


def test_dense_ranks_are_counted_where_the_vectors_lie(spark):
    """Slot counts give the same ranks as rows joined to the sorted keys, ties and negative scores included."""
    rng = np.random.default_rng(5)
    vec = rng.integers(-2, 3, (700, 4)) / 3.0           # many equal scores
    docs = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(vec)], "doc_id long, embedding array<double>").repartition(3)
    q = rng.integers(-2, 3, (5, 4)) / 7.0
    qm = (np.arange(5) + 10, q, 4)
    scores = {(j + 10, i * 3): round(float(vec[i] @ q[j]), 6) + 0.0 for j in range(5) for i in range(700)}
    keys = [(j + 10, int(i) * 3, scores[j + 10, int(i) * 3]) for j in range(4) for i in rng.choice(700, 30, replace=False)]
    keys_df = spark.createDataFrame(keys, "query_id long, doc_id long, score double")
    slots = DB.rank_slots(docs, qm, keys_df, 6)
    got = {(r.query_id, r.doc_id): r.ahead for r in FU.ahead_of_slots(slots, keys_df).collect()}
    assert got == {(i, d): sum((-x, e) < (-s, d) for (j, e), x in scores.items() if j == i) for i, d, s in keys}
    assert slots.count() <= 3 * 4 * 30                   # bounded by the keys, not by the documents


def test_products_are_the_same_in_tiles():
    rng = np.random.default_rng(6)
    d, q = rng.normal(size=(600, 9)), rng.normal(size=(300, 9))
    want = np.zeros((600, 300))
    for j in range(9):
        want += np.outer(d[:, j], q[:, j])
    assert (DB._products(d, q) == want).all()
