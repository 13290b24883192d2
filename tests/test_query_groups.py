"""Large query sets go through exact RRF in groups whose candidates the block kernels can hold."""

from conftest import SF001
from quarry.operators import block_postings as BP
from quarry.plans import hybrid as H
from quarry.sources.corpus import read_benchmark_queries


def test_groups_give_the_same_ranks(spark, index001, monkeypatch):
    qs = read_benchmark_queries(spark, SF001).limit(12)
    cols = ["query_id", "doc_id", "score", "rank_tfidf", "rank_emb", "rank"]
    want = sorted(H.rrf_search(index001, qs, k=3).select(cols).collect())
    sizes = []
    plain = H.candidates
    monkeypatch.setattr(H, "candidates", lambda e, depth, **kw: sizes.append(e.n_queries) or plain(e, depth, **kw))
    monkeypatch.setattr(BP, "MAX_QUERY_TERMS", 900)   # 6 queries of 2 x 66 candidates
    got = sorted(H.rrf_search(index001, qs, k=3).select(cols).collect())
    assert got == want
    assert len(sizes) > 1 and sum(sizes) == qs.count() and max(sizes) < sum(sizes)   # one group of all queries before
