"""Scores, top-k, rank counts and extremes inside document blocks against the shuffle join."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import block_postings as BP
from quarry.operators import fusion as FU
from quarry.plans import hybrid as H
from quarry.plans import search as S
from quarry.sources.corpus import read_benchmark_queries


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(BP, "BLOCK_DOCS", 7)
    monkeypatch.setattr(BP, "CELLS", 30)   # several groups of queries a block


def data(spark, seed=3, docs=120, terms=25, queries=12):
    r = random.Random(seed)
    weights = [0.125, 0.25, 0.3, 0.7]
    rows = {(t, d): r.choice(weights) for d in range(docs) for t in r.sample(range(terms), r.randrange(1, 5))}
    rows |= {(3, d): 0.25 for d in range(40, 90)}   # many equal documents
    post = spark.createDataFrame([(t, 1000 + 3 * d, w) for (t, d), w in rows.items()], "term_index int, doc_id long, weight double")
    qw = spark.createDataFrame([(q, t, r.choice(weights)) for q in range(queries) for t in r.sample(range(terms + 3), 3)], "query_id long, term_index int, weight double")
    return post, qw


def scores(post, qw):
    joined = post.join(qw.withColumnRenamed("weight", "w"), "term_index")
    return {(r.query_id, r.doc_id): r.s for r in joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("s")).collect()}


def test_blocks_hold_every_posting_once(spark, small_blocks):
    post, _ = data(spark)
    got = []
    for b in BP.build_blocks(post, 3).collect():
        assert len(b.docs) <= 7 and b.docs == sorted(b.docs)
        term = np.repeat(b.terms, b.sizes)
        got += [(int(t), b.docs[a], w) for t, a, w in zip(term, b.at, b.weights)]
        assert b.peaks == [max(w for x, w in zip(term, b.weights) if x == t) for t in b.terms]
    assert sorted(got) == sorted(tuple(r) for r in post.collect())


def test_kernels(spark, small_blocks):
    post, qw = data(spark)
    want, q = scores(post, qw), BP.query_terms(qw)
    blocks = BP.build_blocks(post, 3).cache()
    for n in (1, 4, 200):
        got = {(r.query_id, r.doc_id): r.raw for r in BP.top_n(blocks, q, n).collect()}
        for i in range(12):
            best = sorted((-round(s, 9), d) for (k, d), s in want.items() if k == i)[:n]
            have = sorted((-round(s, 9), d) for (k, d), s in got.items() if k == i)
            assert have[: len(best)] == best
    pairs = random.Random(1).sample(sorted(want), 60) + [(0, 5), (99, 1000), (1, 10**9)]
    got = {(r.query_id, r.doc_id): r.raw for r in BP.pair_scores(blocks, q, spark.createDataFrame(pairs, "query_id long, doc_id long")).collect()}
    assert {k: round(v, 9) for k, v in got.items() if v > 0} == {k: round(want[k], 9) for k in pairs if k in want}

    rounded = spark.createDataFrame([(i, d, round(s, 6)) for (i, d), s in want.items()], "query_id long, doc_id long, score double")
    keys = spark.createDataFrame([(i, d, round(want.get((i, d), 0.0), 6)) for i, d in pairs], "query_id long, doc_id long, score double")
    plus, zero = keys.filter("score > 0"), keys.filter("score = 0").select("query_id", "doc_id")
    slots = BP.rank_slots(blocks, q, keys, 6).groupBy("query_id", "kind", "slot").agg(F.sum("n").alias("n"))
    for x, y in zip(FU.finish_rank_counts(slots, plus, zero), FU.sparse_rank_counts(rounded, plus, zero, 100, 1000)):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))

    ext = BP.extremes(blocks, q, 6).groupBy("query_id").agg(F.max("hi"), F.min("lo"), F.sum("n")).collect()
    by = {i: [s for (k, _), s in want.items() if k == i] for i in range(12)}
    assert sorted((r[0], round(r[1], 6), round(r[2], 6), r[3]) for r in ext) == [(i, round(max(v), 6), round(min(v), 6), len(v)) for i, v in by.items() if v]


def test_task_sends_few_rows(spark):
    """A task's output is bounded by queries x n, equal scores included."""
    post = spark.createDataFrame([(1, d, 0.5) for d in range(5000)] + [(2, d, 0.1 + d * 1e-5) for d in range(5000)], "term_index int, doc_id long, weight double").cache()
    q = BP.query_terms(spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (2, 1, 0.5)], "query_id long, term_index int, weight double"))
    out = BP.top_n(BP.build_blocks(post, 4), q, 10)
    assert out.count() <= 2 * 4 * 11
    assert sorted(r.doc_id for r in out.filter("query_id = 1").orderBy(F.desc("raw"), "doc_id").limit(10).collect()) == list(range(10))


def test_blocks_are_skipped(spark):
    """With a good document found, blocks that can't reach it are not scored."""
    q = BP.QueryTerms(np.array([1]), np.array([5]), np.array([1.0]))
    post = spark.createDataFrame([(5, d, 1.0 if d < 10 else 0.1) for d in range(5000)], "term_index int, doc_id long, weight double")
    batches = BP.build_blocks(post, 1).toArrow().to_batches()
    floor, seen = np.zeros(1), 0
    for _, docs, s in BP._parts(iter(batches), q, floor):
        seen += len(docs)
        floor[0] = max(floor[0], np.sort(s[0])[-10])
    assert seen == BP.BLOCK_DOCS


def test_rounding_is_sparks(spark):
    r = random.Random(4)
    x = [r.random() for _ in range(2000)] + [k / 10**7 for k in r.sample(range(10**7), 2000)] + [0.0, 1e-7, 5e-7, 0.9999995, 0.1234565]
    got = BP.round_half_up(np.array(x), 6).tolist()
    spark_rounds = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert got == spark_rounds == [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x]


def test_search_equals_the_shuffle_join(spark, index001, monkeypatch):
    qs = read_benchmark_queries(spark, SF001)
    rows = lambda df: sorted(map(tuple, df.collect()))
    near = [rows(S.tfidf_search(index001, qs, k=5)), rows(H.rrf_search(index001, qs, k=4)), rows(H.weighted_search(index001, qs, k=4, start_depth=8))]
    monkeypatch.setattr(BP, "MAX_QUERY_TERMS", 0)
    assert near == [rows(S.tfidf_search(index001, qs, k=5)), rows(H.rrf_search(index001, qs, k=4)), rows(H.weighted_search(index001, qs, k=4, start_depth=8))]


def test_no_pairs_are_shuffled(spark, index001):
    qs = read_benchmark_queries(spark, SF001)
    plan = S.tfidf_search(index001, qs, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "blocks" in plan and "SortMergeJoin" not in plan.split("MapInArrow")[-1]
