from pyspark.sql import functions as F

from conftest import SF001


def test_stream_equals_batch(spark, index001):
    from quarry.plans import catalog
    from quarry.plans import hybrid as H
    from quarry.sources import corpus as C

    streamed = sorted(tuple(r) for r in catalog.stream_search(spark, SF001).collect())
    turns = C.read_user_turns(spark, SF001)
    batch = H.two_stage_search(index001, turns, k=3, candidate_k=20).select("query_id", "doc_id", "score", "rank1", "rank")
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len(streamed) > 0
