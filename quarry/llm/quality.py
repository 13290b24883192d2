"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words are runs of letters and digits or runs of other signs, hashed to ``buckets`` rows. Each row
has a sparse random index vector; its context vector is the sum of the index vectors of the words
around its occurrences in the whole corpus, so the vectors need no vocabulary and no labels. A
document pools the vectors of all its words. The network is fitted with numpy on a bounded sample
of labelled documents, and a temperature fitted on held-back ones calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T
from quarry.plans.sizing import bounded_broadcast
from quarry.session import written

#: 0 white space, 1 letters, digits and all outside ASCII, 2 other signs
KINDS = np.where(T.ALNUM, 1, 2).astype(np.uint8)
KINDS[~T.NOT_SPACE] = 0


@dataclass(frozen=True)
class QualityModel:
    """``sample`` bounds the labelled documents that the network is fitted on."""

    buckets: int = 1 << 14
    dims: int = 32
    signs: int = 4
    reach: int = 2
    sample: int = 20_000
    hidden: int = 32
    epochs: int = 60
    seed: int = 7

    @property
    def features(self) -> int:
        return 4 * self.dims + 4


def index_vectors(cfg: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places and signs of its index vector's non-zero values."""
    rng = np.random.default_rng(cfg.seed)
    place = np.argsort(rng.random((cfg.buckets, cfg.dims)), axis=1)[:, : cfg.signs]
    return place, rng.choice(np.array([-1, 1]), (cfg.buckets, cfg.signs))


def _dense_index(cfg: QualityModel) -> np.ndarray:
    place, sign = index_vectors(cfg)
    index = np.zeros((cfg.buckets, cfg.dims), np.float32)
    np.add.at(index, (np.arange(cfg.buckets)[:, None], place), sign / np.sqrt(cfg.signs))
    return index


def _parts(column, cfg: QualityModel):
    """(first document, last, first word of each, bucket of each word) of parts of a batch."""
    data, offsets = T.utf8(column)
    for i, j in T.slices(offsets, 1 << 21):
        w = T.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], KINDS)
        yield i, j, w.first, (w.hashes() & np.uint64(cfg.buckets - 1)).astype(np.int64), w.doc()


def context_vectors(docs: DataFrame, cfg: QualityModel = QualityModel(), text_col: str = "text") -> np.ndarray:
    """buckets x dims sums over every text, of unit length. Tasks send one row of sums per bucket they have met."""
    place, sign = index_vectors(cfg)
    cells = cfg.buckets * cfg.dims

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, _, b, doc in _parts(batch.column(0), cfg):
                for gap in range(1, cfg.reach + 1):
                    near = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(doc) > gap else np.zeros(0, np.int64)
                    for mid, other in ((b[near], b[near + gap]), (b[near + gap], b[near])):
                        for s in range(cfg.signs):
                            total += np.bincount(mid * cfg.dims + place[other, s], weights=sign[other, s], minlength=cells).astype(np.int64)
        total = total.reshape(cfg.buckets, cfg.dims)
        met = np.flatnonzero(total.any(axis=1))
        cols = [pa.array(total[met, d]) for d in range(cfg.dims)]
        yield pa.RecordBatch.from_arrays([pa.array(met), *cols], names=["bucket", *(f"d{d}" for d in range(cfg.dims))])

    names = [f"d{d}" for d in range(cfg.dims)]
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    table = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most ``buckets`` rows
    out = np.zeros((cfg.buckets, cfg.dims), np.float32)
    at = table.column("bucket").to_numpy()
    out[at] = np.stack([table.column(n).to_numpy() for n in names], axis=1).reshape(-1, cfg.dims)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _pooled(first: np.ndarray, b: np.ndarray, doc: np.ndarray, vectors: np.ndarray, index: np.ndarray, cfg: QualityModel) -> np.ndarray:
    """Per document: mean and spread of its context vectors, mean and spread of its index vectors, how alike neighbours are, length."""
    n_docs, size = len(first) - 1, np.diff(first)
    out = np.zeros((n_docs, cfg.features), np.float32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    starts, count = first[:-1][full], size[full][:, None].astype(np.float32)
    at = 0
    for table in (vectors, index):
        v = table[b]
        mean = np.add.reduceat(v, starts, axis=0) / count
        out[full, at : at + cfg.dims] = mean
        spread = np.add.reduceat(v * v, starts, axis=0) / count - mean * mean
        out[full, at + cfg.dims : at + 2 * cfg.dims] = np.sqrt(np.maximum(spread, 0))
        for gap in (1,):
            alike = np.zeros(len(b), np.float32)
            alike[:-gap] = np.einsum("ij,ij->i", v[:-gap], v[gap:]) * (doc[:-gap] == doc[gap:])
            out[full, 4 * cfg.dims + (table is index)] = (np.add.reduceat(alike, starts) / count[:, 0])
        at += 2 * cfg.dims
    out[full, -2] = np.linalg.norm(out[full, 2 * cfg.dims : 3 * cfg.dims], axis=1) * np.sqrt(count[:, 0])
    out[full, -1] = np.log1p(count[:, 0])
    return out


def pooled_features(docs: DataFrame, vectors: np.ndarray, cfg: QualityModel = QualityModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, features (array of float): the pooled vectors of each row's whole text; zeros without words."""
    index = _dense_index(cfg)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, index))  # 2 x buckets x dims floats

    def run(batches):
        v, ix = shared.value
        for batch in batches:
            for i, j, first, b, doc in _parts(batch.column(1), cfg):
                flat = pa.array(_pooled(first, b, doc, v, ix, cfg).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * cfg.features), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, features array<float>")


class Network:
    """Two layers (tanh, then a logit), inputs standardised, output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cfg: QualityModel = QualityModel()):
        """Fit on rows x with labels y in {0, 1}; every fifth row is held back for the temperature.

        Without rows, or with one label only, every score is the (smoothed) share of label 1.
        """
        rng = np.random.default_rng(cfg.seed)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.weights = None
        if len(y) < 10 or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        held = np.arange(len(y)) % 5 == 4
        a, t = z[~held], y[~held].astype(np.float64)
        w1, b1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], cfg.hidden)), np.zeros(cfg.hidden)
        w2, b2 = rng.normal(0, 1 / np.sqrt(cfg.hidden), cfg.hidden), np.zeros(1)
        params = [w1, b1, w2, b2]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(t))
            for k in range(0, len(order), 256):
                rows = order[k : k + 256]
                h = np.tanh(a[rows] @ w1 + b1)
                p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))
                d = (p - t[rows]) / len(rows)
                back = np.outer(d, w2) * (1 - h * h)
                grads = [a[rows].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum(keepdims=True)]
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.weights = params
        self.temperature = 1.0
        logits, truth = self.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 16, 97)
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / g)) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def bounded_sample(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those of smallest id hash: the same rows whatever the partitioning."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)


def fit(features: DataFrame, labels: DataFrame, cfg: QualityModel = QualityModel(), label_col: str = "quality") -> Network:
    """Fit on the rows of ``features`` with a label 0 or 1 (repeated and conflicting labels all count)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = bounded_sample(features.join(bounded_broadcast(known), "doc_id"), cfg.sample).toArrow()  # at most ``sample`` rows
    x = np.asarray(rows.column("features").combine_chunks().values if rows.num_rows else [], np.float64).reshape(-1, cfg.features)
    return Network(x, np.asarray(rows.column("y"), np.int64), cfg)


def score(features: DataFrame, network: Network) -> DataFrame:
    """doc_id, score (probability of label 1), predicted (1 if score >= 0.5)."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            p = network.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.select("doc_id", "features").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, cfg: QualityModel = QualityModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted 1, all columns; the model is fitted as by ``classify`` and applied to the rows in place."""
    vectors = context_vectors(docs, cfg, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(bounded_broadcast(known), "doc_id")
    network = fit(written(pooled_features(labelled, vectors, cfg, "doc_id", "text"), "features"), labels, cfg)
    index, at = _dense_index(cfg), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, index, network))

    def run(batches):
        v, ix, net = shared.value
        for batch in batches:
            for i, j, first, b, doc in _parts(batch.column(at), cfg):
                good = net.scores(_pooled(first, b, doc, v, ix, cfg).astype(np.float64)) >= 0.5
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, cfg: QualityModel = QualityModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``.

    Only ``text_col`` is an input of the score. Null and empty texts have zero features and the
    score the network gives those. Rows without id are scored; labels without id or outside 0 and
    1 are not learned from. An empty table gives an empty table.
    """
    vectors = context_vectors(docs, cfg, text_col)
    features = written(pooled_features(docs, vectors, cfg, id_col, text_col), "features")
    return score(features, fit(features, labels, cfg))
