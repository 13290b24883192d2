"""Inverted lists by cluster: vectors stored by cluster, searched by pruned scans and a block kernel.

``save_lists`` writes vectors partitioned by cluster, a large cluster in several files. A search
joins the lists with the clusters that its queries have chosen, so the scan's dynamic partition
pruning opens only those folders. Scores are products of blocks (documents x the queries that
chose their cluster) in numpy; at most about k rows per query and task leave it. Query sets over
``dense_block.MAX_QUERY_CELLS`` are not broadcast: a cogroup per (cluster, query block, document
block) runs the same kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dense_block as DB
from quarry.operators.block_postings import CELLS, MARGIN, best_rows
from quarry.plans.sizing import bounded_broadcast
from quarry.session import path_exists
from quarry.sources.index_io import IndexNotFoundError

MAX_CLUSTERS = 100_000
ROWS_A_FILE = 1_000_000
FOUND = "query_id long, doc_id long, cluster int, raw double"


def save_lists(docs: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Write (doc_id, cluster, embedding) by cluster; a cluster of any size is dealt to files of bounded size."""
    parts = docs.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / rows_a_file).cast("int").alias("parts"))
    dealt = docs.join(bounded_broadcast(parts, MAX_CLUSTERS), "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    dealt.repartition("cluster", "part").select("doc_id", "embedding", F.col("cluster").cast("int").alias("cluster")).write.partitionBy("cluster").parquet(path)


def load_lists(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise IndexNotFoundError(f"no cluster lists at {path}; save them first")
    return spark.read.schema("doc_id long, embedding array<double>, cluster int").parquet(path)


def chosen_lists(lists: DataFrame, near: DataFrame) -> DataFrame:
    """The lists of the clusters in ``near``; its rank filter is what dynamic partition pruning acts on."""
    return lists.join(bounded_broadcast(near.filter("rank >= 1").select("cluster").distinct(), MAX_CLUSTERS), "cluster", "left_semi")


class _Pool:
    """The k best rows of each query seen so far."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]   # query, doc, raw, cluster

    def add(self, query: np.ndarray, doc: np.ndarray, cluster: int, scores: np.ndarray) -> None:
        """``scores``: documents x queries of one cluster."""
        i, j = np.nonzero(scores >= self.floor[query][None, :] - MARGIN)
        new = (query[j], doc[i], scores[i, j], np.full(len(i), cluster))
        rows = [np.r_[a, b] for a, b in zip(self.rows, new)]
        if len(rows[0]):
            keep = best_rows(rows[0], rows[1], rows[2], self.k, self.floor)
            rows = [c[keep] for c in rows]
        self.rows = rows

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        query, doc, raw, cluster = self.rows
        return pd.DataFrame({"query_id": ids[query], "doc_id": doc, "cluster": cluster.astype(np.int32), "raw": raw})


def _score_into(pool: _Pool, vectors: pd.Series, doc: np.ndarray, cluster: int, query: np.ndarray, matrix: np.ndarray) -> None:
    step = max(1, CELLS // max(1, len(query)))
    for i in range(0, len(doc), step):
        pool.add(query, doc[i : i + step], cluster, DB._scores(vectors.iloc[i : i + step], matrix))


def _broadcast_search(lists: DataFrame, rows: pd.DataFrame, k: int) -> DataFrame:
    ids = np.unique(rows["query_id"].to_numpy(np.int64))
    by_cluster = {int(c): (np.searchsorted(ids, g["query_id"].to_numpy(np.int64)), np.stack(g["embedding"].to_numpy()).astype(np.float64))
                  for c, g in rows.groupby("cluster")}
    bc = lists.sparkSession.sparkContext.broadcast((ids, by_cluster))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, by_cluster = bc.value
        pool = _Pool(len(ids), k)
        for pdf in batches:
            for c, g in pdf.groupby("cluster"):
                if int(c) in by_cluster:
                    _score_into(pool, g["embedding"], g["doc_id"].to_numpy(np.int64), int(c), *by_cluster[int(c)])
        yield pool.frame(ids)

    return lists.select("doc_id", "cluster", "embedding").mapInPandas(run, FOUND)


def _blocked_search(lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The same by a cogroup per (cluster, query block, document block); every group is of bounded size."""
    def blocks(df, rows, name):
        return df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    count = blocks(wanted, DB.QUERY_BLOCK_ROWS, "n_qb").join(blocks(lists, DB.DOC_BLOCK_ROWS, "n_db"), "cluster")
    count = bounded_broadcast(count, MAX_CLUSTERS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = wanted.join(count, "cluster").select("cluster", F.pmod(F.xxhash64("query_id"), F.col("n_qb")).cast("int").alias("qb"), every("n_db").alias("db"),
                                             "query_id", F.col("embedding").alias("qvec"))
    d = lists.join(count, "cluster").select("cluster", F.pmod(F.xxhash64("doc_id"), F.col("n_db")).cast("int").alias("db"), every("n_qb").alias("qb"), "doc_id", "embedding")

    def run(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(queries["query_id"].to_numpy(np.int64))
        pool = _Pool(len(ids), k)
        if len(ids) and len(docs):
            _score_into(pool, docs["embedding"], docs["doc_id"].to_numpy(np.int64), int(docs["cluster"].iloc[0]),
                        np.searchsorted(ids, queries["query_id"].to_numpy(np.int64)), np.stack(queries["qvec"].to_numpy()).astype(np.float64))
        return pool.frame(ids)

    return d.groupBy("cluster", "qb", "db").cogroup(q.groupBy("cluster", "qb", "db")).applyInPandas(run, FOUND)


def search_lists(lists: DataFrame, near: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, cluster, raw): a superset of each query's k best documents in its clusters.

    ``lists`` (doc_id, cluster, embedding), ``near`` (query_id, cluster, rank), ``queries`` (query_id, embedding).
    """
    lists = chosen_lists(lists, near)
    wanted = near.select("query_id", F.col("cluster").cast("int").alias("cluster")).join(queries.select("query_id", "embedding"), "query_id")
    size = wanted.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    if size <= DB.MAX_QUERY_CELLS:
        return _broadcast_search(lists, wanted.toPandas(), k)   # bounded above
    return _blocked_search(lists, wanted, k)
