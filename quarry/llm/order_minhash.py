"""Order MinHash fingerprints.

A text's k-mers (k code points) are numbered by occurrence, so a repeated k-mer counts anew. The
hashed (k-mer, occurrence) pairs fall into ``bins`` by their low bits, which plays the part of
independent permutations at the price of one hash. Each bin keeps its ``kept`` smallest pairs,
puts them back into text order, and hashes that tuple: moved or edited passages change tuples
even where the set of k-mers stays.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.textbuf import mix
from quarry.session import written

_BASE = np.uint64(0x100000001B3)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class OrderMinHash:
    """``bins`` is a power of two; k is a power of two of at least 2."""

    k: int = 4
    bins: int = 64
    kept: int = 2
    sample: int = 10


def _kmers(cp: np.ndarray, k: int) -> np.ndarray:
    h = mix(cp.astype(np.uint64) + np.uint64(1))
    if len(h) < k:
        out = np.uint64(len(h))
        for x in h:
            out = (out * _BASE) ^ x
        return mix(np.array([out], np.uint64))
    span, base = 1, _BASE
    while span < k:
        h = h[:-span] * base + h[span:]
        base, span = base * base, 2 * span
    return mix(h)


def sketch(text: str, cfg: OrderMinHash = OrderMinHash()) -> np.ndarray:
    """``bins`` 16-bit values; 0 marks a bin that no k-mer falls into. The empty text is all 0."""
    out = np.zeros(cfg.bins, np.uint16)
    if not text:
        return out
    with np.errstate(over="ignore"):
        h = _kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), cfg.k)
        n = len(h)
        bits = np.uint64(n.bit_length())
        order = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
        order.sort()
        place = order & ((np.uint64(1) << bits) - np.uint64(1))
        group = order >> bits
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        nth = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        g = mix(group * _FOLD + nth.astype(np.uint64))

        shift = np.uint64(cfg.bins.bit_length() - 1)
        value = g >> shift
        few = np.arange(n)
        if n > 2 * cfg.sample * cfg.bins:  # the smallest of each bin are among the small values, unless a bin lacks them
            few = np.flatnonzero(value < np.uint64(int((1 << 64 - int(shift)) * (cfg.sample * cfg.bins / n))))
            if np.bincount((g[few] & np.uint64(cfg.bins - 1)).astype(np.int64), minlength=cfg.bins).min() < cfg.kept:
                few = np.arange(n)
        g, place = g[few], place[few].astype(np.int64)
        by = np.argsort((g << (np.uint64(64) - shift)) | (g >> shift))
        b = (g[by] & np.uint64(cfg.bins - 1)).astype(np.int64)
        at = np.arange(len(b)) - np.searchsorted(b, b)
        low = by[at < cfg.kept]
        b = b[at < cfg.kept]
        text_order = np.lexsort((place[low], b))
        low, b = low[text_order], b[text_order]
        at = np.arange(len(b)) - np.searchsorted(b, b)
        acc = np.zeros(cfg.bins, np.uint64)
        for r in range(cfg.kept):
            here = b[at == r]
            acc[here] = mix(acc[here] * _FOLD + g[low[at == r]])
        here = np.unique(b)
        out[here] = (acc[here] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal bins among those that either text fills; 1 for two empty texts."""
    filled = (x != 0) | (y != 0)
    n = int(filled.sum())
    return float(((x == y) & filled).sum() / n) if n else 1.0


def fingerprints(docs: DataFrame, cfg: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (hex): one row per row; null text reads as empty."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([sketch(t, cfg).astype(">u2").tobytes().hex() for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_ROW = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def _row(doc, text: str, own: np.ndarray, after: str, next_fp: np.ndarray, cfg: OrderMinHash) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    fp = sketch(edited, cfg)
    return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u2").tobytes(),
            fp.astype(">u2").tobytes(), likeness(own, fp), likeness(own, next_fp))


def edit_sensitivity(docs: DataFrame, cfg: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against its edited text and the next row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) of
    the first of the next row, in order of doc_id (null first), ties by text; after the last row
    comes the first, and a single row follows itself. Null text reads as empty. An empty table
    gives an empty table.

    Rows are range-partitioned by doc_id, so a row and the next one nearly always meet in one
    task. Each task also returns its first and last row; these, one pair per task, are joined in
    a second step.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()),
                        ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ends = pa.schema([*fields, ("task", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("tail_id", pa.int64())])

    def pairs(batches):
        held = first = None
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sketch(text, cfg)
                if held is None:
                    first = text
                else:
                    out.append((*_row(*held, text, own, cfg), None, None, None, None))
                held = (doc, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(ends.names, r)) for r in out], ends)
        if held is not None:
            row = dict.fromkeys(ends.names) | {"task": TaskContext.get().partitionId(), "head": first, "tail": held[1], "tail_id": held[0]}
            yield pa.RecordBatch.from_pylist([row], ends)

    def last(batches):
        for batch in batches:
            out = [_row(doc, text, sketch(text, cfg), after, sketch(after, cfg), cfg)
                   for doc, text, after in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in out], fields)

    step = written(ranged.mapInArrow(pairs, _ROW + ", task long, head string, tail string, tail_id long"), "pairs")
    tasks = step.filter("task is not null")
    one_row_a_task = tasks.select("task").withColumn("first", F.min("task").over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("after", F.lead("task").over(Window.orderBy("task")))
    follows = one_row_a_task.select("task", F.coalesce("after", "first").alias("after"))
    open_ = tasks.select("task", "tail_id", "tail").join(follows, "task").join(
        tasks.select(F.col("task").alias("after"), "head"), "after").select("tail_id", "tail", "head")
    out = step.filter("task is null").select(*fields.names).unionByName(open_.mapInArrow(last, _ROW))
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
                      F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
