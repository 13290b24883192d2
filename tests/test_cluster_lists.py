"""Cluster-pruned search over stored lists against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster_lists as CLL
from quarry.operators import clusters as CL
from quarry.operators import dense_block as DB
from quarry.session import path_exists, scratch_path
from quarry.sources.index_io import IndexNotFoundError

DIMS = 3


def vectors(n, seed):
    r = random.Random(seed)
    return [(i, 0 if r.random() < 0.6 else r.randrange(1, 6), [r.choice([0.1, 0.5, -0.4, 1.0]) + r.choice([0.0, r.random()]) for _ in range(DIMS)]) for i in range(n)]


def brute(queries, docs, cents, n_clusters, k, threshold):
    out = []
    for q, v in queries:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, c)) ** 0.5, 6), cl) for cl, c in cents)[:n_clusters]
        chosen = [cl for _, cl in near]
        scored = sorted((-round(sum(a * b for a, b in zip(v, e)), 6), d, cl) for d, cl, e in docs if cl in chosen)[:k]
        out += [(q, ",".join(map(str, chosen)), d, cl, -s, i + 1) for i, (s, d, cl) in enumerate(scored) if -s > threshold]
    return sorted(out)


@pytest.fixture(scope="module")
def saved(spark):
    rows = vectors(400, 1) + [(1000 + i, 2, [0.5, 0.5, 0.5]) for i in range(60)]   # equal scores
    frame = spark.createDataFrame(rows, "doc_id long, cluster int, embedding array<double>")
    path = scratch_path(spark, "lists")
    CLL.save_lists(frame, path, rows_a_file=50)
    return rows, frame, path


def test_lists_keep_every_row(spark, saved):
    rows, _, path = saved
    lists = CLL.load_lists(spark, path)
    assert sorted((r.doc_id, r.cluster, list(r.embedding)) for r in lists.collect()) == sorted(rows)
    assert len(lists.filter("cluster = 0").inputFiles()) > 3   # a large cluster lies in several files
    with pytest.raises(IndexNotFoundError):
        CLL.load_lists(spark, path + "-none")
    assert path_exists(spark, f"{path}/cluster=0")


@pytest.mark.parametrize("cells", [DB.MAX_QUERY_CELLS, 0])
def test_search_equals_brute_force(spark, saved, monkeypatch, cells):
    monkeypatch.setattr(DB, "MAX_QUERY_CELLS", cells)
    monkeypatch.setattr(DB, "QUERY_BLOCK_ROWS", 4)
    monkeypatch.setattr(DB, "DOC_BLOCK_ROWS", 40)
    rows, frame, path = saved
    cents = CL.label_centroids(frame.select(F.col("cluster").alias("label"), "embedding"))
    qs = [(i, e) for i, _, e in vectors(15, 2)]
    queries = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    centres = [(r.cluster, list(r.embedding)) for r in cents.collect()]
    for docs in (CLL.load_lists(spark, path), frame):
        got = CL.cluster_pruned_search(queries, docs, cents, 2, 4, 0.05)
        assert sorted(tuple(r[c] for c in ("query_id", "clusters_searched", "doc_id", "article_cluster", "score", "rank")) for r in got.collect()) == brute(qs, rows, centres, 2, 4, 0.05)
    assert CL.cluster_pruned_search(queries.limit(0), frame, cents, 2, 4, 0.05).count() == 0


def test_only_chosen_folders_are_read(spark, saved):
    _, frame, path = saved
    near = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "query_id long, cluster int, rank int")
    near.write.parquet(near_path := scratch_path(spark, "near"))
    chosen = CLL.chosen_lists(CLL.load_lists(spark, path), spark.read.parquet(near_path))
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString()
    assert {r.cluster for r in chosen.select("cluster").distinct().collect()} == {3, 4}
