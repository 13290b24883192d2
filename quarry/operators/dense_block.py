"""Block kernel for the dense engine: document-vector partitions x a broadcast query matrix.

Scoring every (query, document) pair with a higher-order-function dot product
runs interpreted lambdas per element; here each Arrow batch of document
vectors is multiplied with the query matrix in numpy. The products are
accumulated one dimension at a time (``S += outer(D[:, j], Q[:, j])``), the same
IEEE operations in the same order as ``aggregate(zip_with(...))`` in the JVM,
so raw scores are bit-identical to the expression path, and rounding and tie
ordering stay in the JVM (``F.round``, ``row_number``).

* ``pair_scores`` -- every pair, optionally dropping rows that cannot matter
  (raw score below a per-query floor minus a margin);
* ``topn_superset`` -- per batch, each query's top-n by raw score plus all rows
  within a margin of the n-th, a superset of the exact rounded top-n;
* ``rank_slots`` -- per task, how many documents fall between neighbouring rank keys of a query.

The query matrix travels as a broadcast variable after a size check. Larger
query sets take ``blocked_pairs``: queries and documents are hashed into
blocks, each document block is replicated to every query block (and each
query block to every document block), and a cogroup per (query block,
document block) runs the same kernel on document chunks -- a distributed
block product with bounded memory per group and nothing passing through the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.block_postings import key_slots, round_half_up

MAX_QUERY_CELLS = 16_000_000    # |queries| x dims doubles shipped to every task (128 MB)
CELLS = 2_000_000               # documents x queries scored at a time
TILE = 256
MARGIN = 1e-6                   # far above float noise, below the 6-digit rounding step


def query_matrix(qv: DataFrame, max_cells: int | None = None):
    """(ids, matrix, dims) of the query vectors, or None when too large to broadcast."""
    max_cells = MAX_QUERY_CELLS if max_cells is None else max_cells
    stats = qv.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).collect()[0]
    n, d = int(stats["n"]), int(stats["d"] or 0)
    if n == 0 or n * max(d, 1) > max_cells:
        return None
    rows = qv.select("query_id", "embedding").collect()   # bounded above
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    mat = np.array([list(r["embedding"]) for r in rows], dtype=np.float64)
    return ids, mat, d


def _scores(emb: pd.Series, q: np.ndarray) -> np.ndarray:
    return _products(np.stack(emb.to_numpy()).astype(np.float64, copy=False), q)


def _products(dm: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Document x query products; a tile that fits the CPU's cache goes through all dimensions."""
    s = np.zeros((dm.shape[0], q.shape[0]), dtype=np.float64)
    left, right = np.ascontiguousarray(dm.T), np.ascontiguousarray(q.T)
    for a in range(0, dm.shape[0], TILE):
        for b in range(0, q.shape[0], TILE):
            tile = np.zeros_like(s[a:a + TILE, b:b + TILE])
            step = np.empty_like(tile)
            for j in range(q.shape[1]):
                np.multiply.outer(left[j, a:a + TILE], right[j, b:b + TILE], out=step)
                tile += step
            s[a:a + TILE, b:b + TILE] = tile
    return s


def _query_parts(emb: pd.Series, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of a batch for as many queries at a time as ``CELLS`` allows."""
    dm = np.stack(emb.to_numpy()).astype(np.float64, copy=False)
    step = max(1, CELLS // len(dm))
    for i in range(0, len(q), step):
        yield slice(i, i + step), _products(dm, q[i:i + step])


def pair_scores(doc_vec: DataFrame, qm, floors: dict[int, float] | None = None) -> DataFrame:
    """(query_id, doc_id, raw) for every pair whose raw score >= floor(query) - MARGIN."""
    ids, mat, _ = qm
    bc = doc_vec.sparkSession.sparkContext.broadcast((ids, mat, floors))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, fl = bc.value
        floor_arr = None if fl is None else np.array([fl.get(int(x), -np.inf) for x in qids]) - MARGIN
        for pdf in batches:
            if pdf.empty:
                continue
            s = _scores(pdf["embedding"], q)
            docs = pdf["doc_id"].to_numpy()
            if floor_arr is None:
                r, c = np.indices(s.shape)
                r, c = r.ravel(), c.ravel()
            else:
                r, c = np.nonzero(s >= floor_arr[None, :])
            yield pd.DataFrame({"query_id": qids[c], "doc_id": docs[r], "raw": s[r, c]})

    return doc_vec.select("doc_id", "embedding").mapInPandas(fn, "query_id long, doc_id long, raw double")


def topn_superset(doc_vec: DataFrame, qm, n: int) -> DataFrame:
    """(query_id, doc_id, raw): per batch, rows within MARGIN of each query's n-th best raw score."""
    ids, mat, _ = qm
    bc = doc_vec.sparkSession.sparkContext.broadcast((ids, mat))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            docs = pdf["doc_id"].to_numpy()
            for mine, s in _query_parts(pdf["embedding"], q):
                if s.shape[0] > n:
                    nth = -np.partition(-s, n - 1, axis=0)[n - 1]      # n-th largest per query
                    r, c = np.nonzero(s >= (nth - MARGIN)[None, :])
                else:
                    r, c = np.indices(s.shape)
                    r, c = r.ravel(), c.ravel()
                yield pd.DataFrame({"query_id": qids[mine][c], "doc_id": docs[r], "raw": s[r, c]})

    return doc_vec.select("doc_id", "embedding").mapInPandas(fn, "query_id long, doc_id long, raw double")


def rank_slots(doc_vec: DataFrame, qm, keys: DataFrame, digits: int) -> DataFrame:
    """(query_id, slot, n) per task: documents by the number of rank keys before or at them (``fusion.ahead_of_slots``).

    ``keys`` (query_id, doc_id, score) are for the caller to bound. Documents behind every key of a query are left out.
    """
    by_query = {}
    for i, r in keys.select("query_id", "doc_id", "score").toPandas().groupby("query_id"):
        r = r.sort_values(["score", "doc_id"], ascending=[False, True])
        by_query[int(i)] = (r["score"].to_numpy(np.float64), r["doc_id"].to_numpy(np.int64))
    ids, mat, _ = qm
    bc = doc_vec.sparkSession.sparkContext.broadcast((ids, mat, by_query))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, by_query = bc.value
        counts = {}
        for pdf in batches:
            if pdf.empty:
                continue
            docs = pdf["doc_id"].to_numpy()
            for mine, s in _query_parts(pdf["embedding"], q):
                for i, raw in zip(qids[mine].tolist(), s.T):
                    if i not in by_query:
                        continue
                    key_score, key_doc = by_query[i]
                    some = np.flatnonzero(raw >= key_score[-1] - MARGIN)
                    new = np.bincount(key_slots(round_half_up(raw[some], digits), docs[some], key_score, key_doc), minlength=len(key_doc) + 1)
                    counts[i] = counts[i] + new if i in counts else new
        rows = [(i, slot, n) for i, c in counts.items() for slot, n in enumerate(c[:-1].tolist()) if n]
        yield pd.DataFrame(rows, columns=["query_id", "slot", "n"]).astype("int64")

    return doc_vec.select("doc_id", "embedding").mapInPandas(fn, "query_id long, slot int, n long")


def minmax_partials(doc_vec: DataFrame, qm) -> DataFrame:
    """(query_id, lo, hi): raw score range of each query over each batch of documents.

    Min-max fusion needs only each query's extreme scores over the corpus, so
    a batch emits one row per query instead of one per pair; the caller
    finishes with min / max per query (rounding is monotone, so rounding the
    extremes equals the extremes of rounded scores).
    """
    ids, mat, _ = qm
    bc = doc_vec.sparkSession.sparkContext.broadcast((ids, mat))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            s = _scores(pdf["embedding"], q)
            yield pd.DataFrame({"query_id": qids, "lo": s.min(axis=0), "hi": s.max(axis=0)})

    return doc_vec.select("doc_id", "embedding").mapInPandas(fn, "query_id long, lo double, hi double")


QUERY_BLOCK_ROWS = 8_192        # queries per block in the blocked product
DOC_BLOCK_ROWS = 262_144        # documents per block (their vectors stay in one group)
DOC_CHUNK_ROWS = 2_048          # score matrix per step: chunk x query block doubles


def _keep(s: np.ndarray, n: int | None, floor_arr: np.ndarray | None):
    """Row/column indices kept from a (docs x queries) score matrix."""
    if n is not None and s.shape[0] > n:
        nth = -np.partition(-s, n - 1, axis=0)[n - 1]
        return np.nonzero(s >= (nth - MARGIN)[None, :])
    if floor_arr is not None:
        return np.nonzero(s >= floor_arr[None, :])
    r, c = np.indices(s.shape)
    return r.ravel(), c.ravel()


def blocked_pairs(doc_vec: DataFrame, qv: DataFrame, n_docs: int, n_queries: int, n: int | None = None,
                  floors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, raw) like ``pair_scores`` / ``topn_superset`` without broadcasting the queries.

    ``n``: keep, per query and document chunk, the rows within MARGIN of the
    chunk's n-th best (a superset of the exact top-n). ``floors`` (query_id,
    floor): keep rows with raw >= floor - MARGIN. Neither: every pair.
    """
    qb_n = max(1, math.ceil(n_queries / QUERY_BLOCK_ROWS))
    db_n = max(1, math.ceil(n_docs / DOC_BLOCK_ROWS))
    q = qv.select("query_id", "embedding")
    if floors is not None:
        q = q.join(floors.select("query_id", "floor"), "query_id")
    else:
        q = q.withColumn("floor", F.lit(None).cast("double"))
    # fresh aliases: both sides may come from one frame (documents against documents)
    q = q.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("floor").alias("floor"),
                 F.pmod(F.xxhash64("query_id"), F.lit(qb_n)).cast("int").alias("qb"),
                 F.explode(F.sequence(F.lit(0), F.lit(db_n - 1))).alias("db"))
    d = doc_vec.select(F.col("doc_id").alias("doc_id"), F.col("embedding").alias("dvec"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(db_n)).cast("int").alias("db"),
                       F.explode(F.sequence(F.lit(0), F.lit(qb_n - 1))).alias("qb"))

    has_floor, chunk_rows = floors is not None, DOC_CHUNK_ROWS

    def fn(dpdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if dpdf.empty or qpdf.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "raw": []}).astype(
                {"query_id": "int64", "doc_id": "int64", "raw": "float64"})
        qids = qpdf["query_id"].to_numpy()
        qm = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64, copy=False)
        floor_arr = qpdf["floor"].to_numpy(dtype=np.float64) - MARGIN if has_floor else None
        out = []
        for lo in range(0, len(dpdf), chunk_rows):
            chunk = dpdf.iloc[lo:lo + chunk_rows]
            s = _scores(chunk["dvec"], qm)
            r, c = _keep(s, n, floor_arr)
            out.append(pd.DataFrame({"query_id": qids[c], "doc_id": chunk["doc_id"].to_numpy()[r], "raw": s[r, c]}))
        return pd.concat(out, ignore_index=True)

    return d.groupBy("qb", "db").cogroup(q.groupBy("qb", "db")).applyInPandas(
        fn, "query_id long, doc_id long, raw double")
