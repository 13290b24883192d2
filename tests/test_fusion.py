import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fusion as FU


def test_rrf_depth_bound_is_exact():
    for k in (1, 3, 10, 20):
        n = FU.rrf_depth(k)
        # an unseen document (rank > n everywhere) scores below every top-k document of engine 1
        assert 2.0 / (60 + n + 1) < 1.0 / (60 + k) - 1e-6


def _brute_ahead(rows, key):
    q, d, s = key
    return sum(1 for (q2, d2, s2) in rows if q2 == q and (s2 > s or (s2 == s and d2 < d)))


@pytest.mark.parametrize("seed", [1, 2])
def test_count_ahead_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(q, d, float(rnd.randint(0, 6))) for q in range(3) for d in range(40)]
    keys = [r for r in rows if rnd.random() < 0.3] + [(0, 999, 2.5), (1, 998, 0.0)]   # some keys not in rows
    rdf = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    kdf = spark.createDataFrame(keys, "query_id long, doc_id long, score double")
    got = {(r.query_id, r.doc_id): r.ahead for r in FU.count_ahead(rdf, kdf, 64, 1000).collect()}
    for k in keys:
        assert got[(k[0], k[1])] == _brute_ahead(rows, k)


def test_rrf_fuse_full_lists_equals_reference_formula(spark):
    ranks = [(0, d, r1, r2) for d, r1, r2 in [(1, 1, 3), (2, 2, 1), (3, 3, 2)]]
    a = spark.createDataFrame([(q, d, r1) for q, d, r1, _ in ranks], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(q, d, r2) for q, d, _, r2 in ranks], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in FU.rrf_fuse([a, b]).collect()}
    for _, d, r1, r2 in ranks:
        assert got[d] == round(1 / (60 + r1) + 1 / (60 + r2), 6)


def test_hybrid_rrf_exact_equals_full_ranking(spark, index001):
    """Depth-bounded candidates + counted ranks == ranking every document (sf0.001)."""
    from pyspark.sql import Window

    from quarry.plans import hybrid as H
    from quarry.sources import corpus as C
    from conftest import SF001

    qs = C.read_benchmark_queries(spark, SF001)
    got = sorted(tuple(r) for r in H.rrf_search(index001, qs, k=5).select("query_id", "doc_id", "score", "rank").collect())
    e = H.engines(index001, qs)
    full = e.dense().withColumnRenamed("score", "emb").join(
        e.sparse.withColumnRenamed("score", "tfidf"), ["query_id", "doc_id"], "left").fillna(0.0, subset=["tfidf"])
    w_t = Window.partitionBy("query_id").orderBy(F.col("tfidf").desc(), "doc_id")
    w_e = Window.partitionBy("query_id").orderBy(F.col("emb").desc(), "doc_id")
    fused = full.select("query_id", "doc_id", F.round(1.0 / (60 + F.row_number().over(w_t)) + 1.0 / (60 + F.row_number().over(w_e)), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    want = sorted(tuple(r) for r in fused.select("*", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 5").collect())
    assert got == want


def test_minmax_in_unit_interval(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7), (0, 0.3), (1, 0.5), (1, 0.5)], "q long, x double")
    st = df.groupBy("q").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    vals = [r.m for r in df.join(st, "q").select(FU.minmax(F.col("x"), F.col("lo"), F.col("hi")).alias("m")).collect()]
    assert all(0.0 <= v <= 1.0 for v in vals)
    assert min(vals) == 0.0
