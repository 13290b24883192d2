"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. One pass over the texts: word 4-gram sets, their MinHash signature (16 bits kept of each
   value) and a digest of the word sequence. Copies share a digest and collapse by aggregation.
2. Bands of the signature are bucket keys. Every member is paired with its bucket's smallest id;
   no bucket is expanded into all pairs.
3. A pair's signatures are compared batch by batch. After n compared values with m equal ones the
   similarity has posterior Beta(m+1, n-m+1); the pair goes when the posterior probability of
   reaching the threshold is under ``miss``.
4. Survivors are verified on their full sets; links give connected components.
5. A bucket whose other members already share one component holds no further news. In the rest,
   members of different components are compared with each other by the same kernel, a bucket
   being dealt in blocks of bounded size, so that no link between different texts is lost to the
   choice of centres.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T
from quarry.llm.components import components
from quarry.plans.sizing import bounded_broadcast
from quarry.session import written

#: ids (8 bytes each) that may be broadcast to pick texts; more of them take a shuffle join
MOST_BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class NearDedup:
    """``percent``: the least Jaccard similarity of a link, in hundredths.

    48 bands of 6 values find a pair at 0.8 but for a chance of (1 - 0.8^6)^48 < 1e-6.
    """

    shingle: int = 4
    percent: int = 80
    bands: int = 48
    rows: int = 6
    batch: int = 48
    miss: float = 1e-7
    block: int = 256
    seed: int = 20240229

    @property
    def values(self) -> int:
        return self.bands * self.rows


def least_matches(batch: int, total: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared values n, fewest equal ones that stay) after each batch.

    P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m), summed exactly.
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                             + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _coefficients(cfg: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    a = rng.integers(0, 2**32, cfg.values, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, cfg.values, dtype=np.uint32)


def shingle_sets(column, cfg: NearDedup):
    """Per document: (sorted distinct 64-bit shingles, the hashes of its words), part of a batch at a time."""
    data, offsets = T.utf8(column)
    k = cfg.shingle
    for i, j in T.slices(offsets, 1 << 23):
        w = T.Words(T.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], T.NOT_SPACE)
        h = w.hashes()
        s = T.windows(h, k)
        for d in range(j - i):
            lo, hi = w.first[d], w.first[d + 1]
            if hi - lo >= k:
                yield np.unique(s[lo : hi - k + 1]), h[lo:hi]
            elif hi > lo:
                yield T.windows(h[lo:hi], hi - lo) ^ np.uint64(hi - lo), h[lo:hi]
            else:
                yield np.zeros(0, np.uint64), h[:0]


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (a[:, None] * x[None, i : i + 4096] + b[:, None]).min(axis=1))
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype("<u2").tobytes()


def signatures(docs: DataFrame, cfg: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (null without words), sig (null without words)."""
    a, b = _coefficients(cfg)

    def run(batches):
        for batch in batches:
            n, digest, sig = [], [], []
            for s, h in shingle_sets(batch.column(1), cfg):
                n.append(len(s))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(_signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _likely(pairs: DataFrame, sig: DataFrame, cfg: NearDedup) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out the threshold."""
    steps = least_matches(cfg.batch, cfg.values, cfg.percent / 100, cfg.miss)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, cfg.values) for c in (2, 3))
            live, equal, was = np.arange(len(x)), np.zeros(len(x), np.int32), 0
            for n, least in steps:
                equal[live] += (x[live, was:n] == y[live, was:n]).sum(axis=1, dtype=np.int32)
                live, was = live[equal[live] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], names=["a", "b"])

    side = lambda c: sig.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, cfg: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """doc_id, full: the sorted distinct shingles of the wanted ids. The ids are broadcast while they are few."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s, _ in shingle_sets(batch.column(1), cfg)], pa.binary())],
                names=["doc_id", "full"])

    ids = written(ids.distinct(), "ids")
    wanted = rows.join(bounded_broadcast(ids, MOST_BROADCAST_IDS), "doc_id").select("doc_id", "text")
    return written(wanted.mapInArrow(sets, "doc_id long, full binary"), "sets")


def _linked(x: bytes, y: bytes, cfg: NearDedup) -> bool:
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return len(both) > 0 and 100 * shared >= cfg.percent * (len(both) - shared)


def _links(pairs: DataFrame, full: DataFrame, cfg: NearDedup) -> DataFrame:
    """Pairs that reach the threshold on their full shingle sets."""

    def verify(batches):
        for batch in batches:
            mask = pa.array([_linked(x, y, cfg) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    side = lambda c: full.select(F.col("doc_id").alias(c), F.col("full").alias(f"full_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "full_a", "full_b").mapInArrow(verify, "a long, b long")


def _blocks(members: DataFrame, sig: DataFrame, full: DataFrame, cfg: NearDedup) -> DataFrame:
    """Links across components within each bucket, in blocks of bounded size.

    members: key, rep, label. A bucket of g members is dealt to ceil(g / block) parts by id, and
    each pair of parts is one unit of at most two parts. A unit compares signatures of members of
    different components, then verifies likely pairs on full sets, the likeliest first; a pair
    whose components the unit has already joined needs no test, so a unit returns fewer links
    than it has members.
    """
    steps = least_matches(cfg.batch, cfg.values, cfg.percent / 100, cfg.miss)
    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("parts"))
    dealt = members.join(size, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "label")
    what = sig.join(full.withColumnRenamed("doc_id", "rep"), "rep")
    filled = units.join(what, "rep").groupBy("key", "i", "j").agg(
        F.collect_list(F.struct("part", "rep", "label", "sig", "full")).alias("m"))

    def unit(i, j, m):
        part, rep, label = (np.asarray(m.field(c)) for c in ("part", "rep", "label"))
        s = np.frombuffer(b"".join(m.field("sig").to_pylist()), "<u2").reshape(-1, cfg.values)
        sets, right = m.field("full").to_pylist(), np.flatnonzero(part == j)
        likely = []
        for x in np.flatnonzero(part == i):
            y = right[(label[right] != label[x]) & ((rep[right] > rep[x]) | (i != j))]
            equal, was = np.zeros(len(y), np.int32), 0
            for n, least in steps:
                if not len(y):
                    break
                equal += (s[y, was:n] == s[x, was:n]).sum(axis=1, dtype=np.int32)
                stay = equal >= least
                y, equal, was = y[stay], equal[stay], n
            likely += [(-e, int(x), v) for e, v in zip(equal.tolist(), y.tolist())]
        up: dict = {}

        def root(c):
            while c in up:
                c = up[c]
            return c

        for _, x, y in sorted(likely):
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q and _linked(sets[x], sets[y], cfg):
                up[max(p, q)] = min(p, q)
                yield int(rep[x]), int(rep[y])

    def run(batches):
        for batch in batches:
            found = [e for r in range(batch.num_rows)
                     for e in unit(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].values)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return filled.select("i", "j", "m").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a document's set holds its distinct
    ``shingle``-word runs, or its whole sequence when it has fewer words. Documents without words
    (null, empty or blank text) have an empty set and are linked with nothing. Rows that share a
    doc_id count as one document and are linked. A row without doc_id is linked with nothing:
    component_id null, kept true. Other columns of ``docs`` are not read. An empty table gives
    an empty table.
    """
    feats = written(signatures(docs, cfg, id_col, text_col), "signatures")
    usable = feats.filter("doc_id is not null and digest is not null")
    classes = written(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(
        "digest", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig")), "classes")
    sig = classes.select("rep", "sig")
    width = 2 * cfg.rows
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(cfg.bands)]))
    banded = classes.select("rep", band.alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1").drop("n")
    members = written(banded.join(shared, "key").filter("rep <> centre"), "members")

    stars = members.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    likely = written(_likely(stars, sig, cfg), "likely")
    sets = lambda ids: _full_sets(ids, docs, cfg, id_col, text_col)
    first = written(_links(likely, sets(likely.select(F.explode(F.array("a", "b")).alias("doc_id"))), cfg), "links")
    label = components(first)

    named = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rest = written(named.join(open_, "key"), "open")
    links = first.unionByName(_blocks(rest, sig, sets(rest.select(F.col("rep").alias("doc_id"))), cfg))
    # copies hang on their class's smallest id, so they join its component without taking part in the rounds
    home = usable.join(classes.select("digest", "rep"), "digest").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    home = written(home, "home")
    tied = home.filter("rep <> other")  # a doc_id on several texts ties their classes
    if not tied.isEmpty():
        every = usable.join(tied.select("doc_id"), "doc_id").join(classes.select("digest", F.col("rep").alias("r")), "digest")
        links = links.unionByName(every.join(home, "doc_id").select(F.col("rep").alias("a"), F.col("r").alias("b")).filter("a <> b"))
    reps = components(written(links, "links"))
    in_class = home.select("doc_id", "rep")
    placed = (feats.select("doc_id", "n_shingles").join(in_class, "doc_id", "left")
              .withColumn("rep", F.coalesce("rep", "doc_id"))
              .join(reps.select(F.col("node").alias("rep"), "label"), "rep", "left")
              .withColumn("component_id", F.coalesce("label", "rep")))
    return placed.select("doc_id", "n_shingles", "component_id",
                         (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))
