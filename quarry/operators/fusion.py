"""Score fusion: reciprocal rank fusion and weighted min-max fusion, exact over the whole corpus.

The reference ranks *every* document in every engine and fuses whole arrays.
Materialising |queries| x |documents| ranks with one sort per query would put a
whole query into one task, so instead:

* **Depth bound (RRF).** A document outside the top ``N`` of every engine has a
  fused score of at most ``E / (k_rrf + N + 1)``; each of the top ``k`` documents
  of engine 1 scores more than ``1 / (k_rrf + k)``. With
  ``N >= E * (k_rrf + k) - k_rrf - 1`` (plus a rounding margin) the fused top-k is
  inside the union of the per-engine top-N lists: exact, not a cap.
* **Exact ranks by counting (no sort).** The rank of a candidate is
  1 + the number of documents ahead of it. Per query the candidate keys are
  sorted into one small array; every scored row finds, by a binary search
  done by binary lifting (one projection per halving step, log2(m) comparisons), how many
  keys are ahead of it; a ``groupBy(query, slot).count()`` and a prefix sum over
  the slots give all candidate ranks in one distributed pass.
* **Threshold loop (weighted).** Min-max fusion is monotone in both scores, so
  Fagin's threshold test decides whether the top-N lists already contain the
  exact top-k; otherwise N grows. Each round is a fixed number of jobs and one
  boolean reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import MINMAX_EPS_FIXED, RRF_K_FIXED
from quarry.plans.sizing import bounded_broadcast
from quarry.session import written

_INF = float("inf")


def rrf_depth(k: int, engines: int = 2, rrf_k: int = RRF_K_FIXED, digits: int = 6) -> int:
    """Smallest per-engine list depth whose union provably holds the fused top-k."""
    margin = 2 * 10.0 ** (-digits)
    target = 1.0 / (rrf_k + k) - margin
    if target <= 0:
        raise ValueError("rounding margin too large for this k")
    n = math.ceil(engines / target - (rrf_k + 1))
    return max(n, k)


# ---------------------------------------------------------------------------
# rank counting
# ---------------------------------------------------------------------------

def sorted_keys(keys: DataFrame) -> DataFrame:
    """(query_id, ks) where ks = candidate keys sorted best-first as struct(ns = -score, d = doc_id)."""
    return keys.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("ns"), F.col("doc_id").alias("d")))).alias("ks")
    )


def add_slot(df: DataFrame, ks: str, row_key_col: Column, max_keys: int, out: str) -> DataFrame:
    """Add ``out`` = number of keys ahead of, or equal to, the row, by binary lifting over the sorted keys.

    Keys are ascending (struct(ns = -score, d = doc_id) compares lexicographically,
    or plain doc ids), so "key <= row" holds for a prefix of the array. One
    projection per halving step (log2(max_keys) + 1 of them, each a single
    ``get`` and comparison) finds the prefix length. ``F.get`` past the end of a
    shorter array (or on a NULL array) is NULL and reads as "not ahead", so one
    chain serves queries with any number of keys up to ``max_keys``.
    """
    df = df.withColumn("_rk", row_key_col).withColumn(out, F.lit(0))
    for e in range(max(max_keys, 1).bit_length() - 1, -1, -1):
        step = 1 << e
        ahead = F.coalesce(F.get(F.col(ks), F.col(out) + F.lit(step - 1)) <= F.col("_rk"), F.lit(False))
        df = df.withColumn(out, F.when(ahead, F.col(out) + F.lit(step)).otherwise(F.col(out)))
    return df.drop("_rk")


def row_key(score: Column, doc: Column) -> Column:
    return F.struct((-score).alias("ns"), doc.alias("d"))


def count_ahead(rows: DataFrame, keys: DataFrame, max_keys: int, max_broadcast_rows: int,
                rows_carry_keys: bool = False, n_queries: int | None = None) -> DataFrame:
    """For each key (query_id, doc_id, score): ``ahead`` = number of rows ranked strictly before it.

    Order is ``score DESC, doc_id ASC``; a row equal to the key is not counted.
    ``rows`` (query_id, doc_id, score) may be large; keys are few per query.
    If ``rows_carry_keys`` the rows already hold the ``ks`` column. ``n_queries``,
    when known, bounds the key table (one row per query) without a counting job.
    """
    ks = sorted_keys(keys)
    if rows_carry_keys:
        joined = rows
    else:
        joined = rows.join(bounded_broadcast(ks, max_broadcast_rows, n_queries), "query_id")
    keyed = add_slot(joined.select("query_id", "ks", "score", "doc_id"), "ks",
                     row_key(F.col("score"), F.col("doc_id")), max_keys, "slot")
    slots = keyed.groupBy("query_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    # position of every key in its query's sorted array
    pos = ks.select("query_id", F.posexplode("ks").alias("slot", "k")).select(
        "query_id", "slot", F.col("k.d").alias("doc_id")
    )
    per_slot = pos.join(slots, ["query_id", "slot"], "left").fillna(0, subset=["n"])
    w = Window.partitionBy("query_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return per_slot.select("query_id", "doc_id", F.sum("n").over(w).cast("long").alias("ahead"))


def _prefix_counts(pos: DataFrame, slots: DataFrame) -> DataFrame:
    """(query_id, slot, doc_id) key positions + (query_id, slot, n) row counts -> (query_id, doc_id, ahead)."""
    per_slot = pos.join(slots, ["query_id", "slot"], "left").fillna(0, subset=["n"])
    w = Window.partitionBy("query_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return per_slot.select("query_id", "doc_id", F.sum("n").over(w).cast("long").alias("ahead"))


def ahead_of_slots(slots: DataFrame, keys: DataFrame) -> DataFrame:
    """``count_ahead`` from partial slot counts (query_id, slot, n): slot = keys before or at a row."""
    pos = sorted_keys(keys).select("query_id", F.posexplode("ks").alias("slot", "k")).select("query_id", "slot", F.col("k.d").alias("doc_id"))
    return _prefix_counts(pos, slots.groupBy("query_id", "slot").agg(F.sum("n").alias("n")))


def sparse_rank_counts(rows: DataFrame, keys_pos: DataFrame, keys_zero: DataFrame, max_keys: int,
                       max_broadcast_rows: int, n_queries: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over the positive-score rows (query_id, doc_id, score) for three counts.

    * ``ahead`` of each positive key (query_id, doc_id, score): rows ranked strictly before it;
    * ``before`` of each zero-score key (query_id, doc_id): positive rows with a smaller doc_id;
    * ``P`` per query: the number of positive rows.

    Every row gets both binary-search slots (struct keys by rank, doc ids in
    ascending order) and is counted once per kind in a partial aggregate.
    The small slot-count table is written once; the three frames are read from it.
    Returns (ahead, before, P).
    """
    ks, ds = sorted_keys(keys_pos), _sorted_ids(keys_zero)
    kq = written(ks.join(ds, "query_id", "full"), "rank-keys")   # one row per query
    joined = rows.join(bounded_broadcast(kq, max_broadcast_rows, n_queries), "query_id", "left")   # 1 row / query
    joined = add_slot(joined, "ks", row_key(F.col("score"), F.col("doc_id")), max_keys, "_s0")
    joined = add_slot(joined, "ds", F.col("doc_id"), max_keys, "_s1")
    slots = joined.select(
        "query_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("_s0").alias("slot")),
            F.struct(F.lit(1).alias("kind"), F.col("_s1").alias("slot")),
        )).alias("e"),
    ).groupBy("query_id", F.col("e.kind").alias("kind"), F.col("e.slot").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"))
    return finish_rank_counts(slots, keys_pos, keys_zero)


def _sorted_ids(keys: DataFrame) -> DataFrame:
    return keys.groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("ds"))


def finish_rank_counts(slots: DataFrame, keys_pos: DataFrame, keys_zero: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ahead, before, P) of ``sparse_rank_counts`` from its slot counts (query_id, kind, slot, n)."""
    ks, ds = sorted_keys(keys_pos), _sorted_ids(keys_zero)
    slots = written(slots, "slots")    # small (<= 2 (max_keys + 1) rows per query), read three times
    pos_k = ks.select("query_id", F.posexplode("ks").alias("slot", "k")).select(
        "query_id", "slot", F.col("k.d").alias("doc_id"))
    pos_z = ds.select("query_id", F.posexplode("ds").alias("slot", "doc_id"))
    ahead = _prefix_counts(pos_k, slots.filter(F.col("kind") == 0).drop("kind"))
    before = _prefix_counts(pos_z, slots.filter(F.col("kind") == 1).drop("kind")).withColumnRenamed("ahead", "before")
    n_pos = slots.filter(F.col("kind") == 0).groupBy("query_id").agg(F.sum("n").cast("long").alias("P"))
    return ahead, before, n_pos


# ---------------------------------------------------------------------------
# generic fusion of ranked lists (any number of engines)
# ---------------------------------------------------------------------------

def rrf_fuse(ranked: Sequence[DataFrame], rrf_k: int = RRF_K_FIXED, digits: int = 6) -> DataFrame:
    """sum over engines of 1 / (rrf_k + rank); ``ranked`` frames hold (query_id, doc_id, rank), rank 1-based.

    Given complete rankings this is the reference's fusion; given top-N lists it
    is the usual list-depth RRF. Fusion is a union + one aggregate (no join).
    """
    parts = [r.select("query_id", "doc_id", (1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("c")) for r in ranked]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("query_id", "doc_id").agg(F.round(F.sum("c"), digits).alias("score"))


def minmax(col: Column, lo: Column, hi: Column, eps: float = MINMAX_EPS_FIXED) -> Column:
    """(x - lo) / (hi - lo + eps); a constant input maps to 0."""
    return (col - lo) / (hi - lo + F.lit(eps))
