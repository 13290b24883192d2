"""SimHash near duplicates by a positional byte index with count filtering.

1. One pass over the texts: a document's fingerprint holds, bit by bit, the majority of the XXH64
   values of its 4-word shingles. Equal fingerprints collapse by aggregation.
2. Fingerprints of 8 bytes that differ in at most ``most_bits`` = 4 bits agree in at least 4
   positional bytes. A list of the index is named by as many positions and the bytes there, so
   each linked pair meets in a list, and a list by chance is short. A list is never expanded
   into all its pairs: its members are paired with its smallest and its largest fingerprint.
3. A pair's shared positional bytes are tallied; pairs that reach the guaranteed least number are
   verified on all bits. Links give connected components.
4. A list whose members share one component holds no further news. In the others, members of
   different components are tallied and verified in blocks of bounded size, dealt by (list,
   part, part); a block returns fewer links than it has members.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T
from quarry.llm.components import components
from quarry.session import written

BYTES = 8
SEED = 42


@dataclass(frozen=True)
class SimHash:
    """``most_bits``: differing bits of a link, under 8; ``block``: members of a list compared in one part."""

    shingle: int = 4
    most_bits: int = 4
    block: int = 4096

    @property
    def least_bytes(self) -> int:
        """Positional bytes that linked fingerprints share at least."""
        return BYTES - self.most_bits


def _joined(words: T.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a batch with one space behind each, and where each starts and ends there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[end] = False
    at = np.zeros(len(words.data) + 1, np.int32)
    at[words.start] += 1
    at[words.end] -= 1  # may be the start of the next document's first word
    out[inside] = words.data[np.cumsum(at[:-1], dtype=np.int32) > 0]
    return out.tobytes(), start, end


def _majority(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Bits set in over half of each document's values; values of a document stand together."""
    ones = np.zeros((n_docs, 64), np.int64)
    for i in range(0, len(values), 1 << 18):
        v, d = values[i : i + (1 << 18)], doc[i : i + (1 << 18)]
        bits = np.unpackbits(v.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones[d[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    most = 2 * ones > np.bincount(doc, minlength=n_docs)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint_batch(column, cfg: SimHash) -> np.ndarray:
    """Fingerprints (uint64) of an Arrow text column, a bounded part of the batch at a time."""
    data, offsets = T.utf8(column)
    out = [np.zeros(0, np.uint64)]
    for i, j in T.slices(offsets, 1 << 22):
        w = T.Words(T.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], T.NOT_SPACE)
        text, start, end = _joined(w)
        n = np.diff(w.first)
        doc = w.doc()
        runs = np.arange(len(w)) + cfg.shingle <= w.first[1:][doc]  # a whole shingle starts here
        short = (np.arange(len(w)) == w.first[:-1][doc]) & (n[doc] < cfg.shingle)
        first = np.flatnonzero(runs | short)
        last = np.minimum(first + cfg.shingle, w.first[1:][doc[first]]) - 1
        digest = xxhash.xxh64_intdigest
        values = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())), np.uint64, len(first))
        out.append(_majority(values, doc[first], j - i))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, cfg: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; 0 for texts without words (null, empty, blank)."""

    def run(batches):
        for batch in batches:
            fp = fingerprint_batch(batch.column(1), cfg).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def posting_keys(fp, cfg: SimHash):
    """One key per list that holds the fingerprint: positions (as a number) and the bytes there."""
    masks = [_mask(p) for p in combinations(range(BYTES), cfg.least_bytes)]
    return F.array(*[F.struct(F.lit(i).alias("at"), fp.bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])


def shared_bytes(x, y):
    """Tally of equal positional bytes of two fingerprints."""
    both = x.bitwiseXOR(y)
    same = [F.when(both.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(BYTES)]
    return sum(same[1:], same[0])


def _verified(pairs: DataFrame, cfg: SimHash) -> DataFrame:
    """Links among pairs (a, b) of fingerprints: count filter first, all bits then."""
    a, b = F.col("a"), F.col("b")
    tallied = pairs.filter(shared_bytes(a, b) >= cfg.least_bytes)
    return tallied.filter(F.bit_count(a.bitwiseXOR(b)) <= cfg.most_bits).distinct()


def _block_links(members: DataFrame, cfg: SimHash) -> DataFrame:
    """Links across components within each list, in blocks of two parts at most.

    members: at, bytes, fp, label. A block holds (fp, label), 16 bytes a member.
    """
    size = members.groupBy("at", "bytes").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("parts"))
    dealt = members.join(size.hint("merge"), ["at", "bytes"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "at", "bytes", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "label")

    def unit(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part, label = table.column("part").to_numpy(), table.column("label").to_numpy()
        fp = table.column("fp").to_numpy()
        bits = fp.view(np.uint64)
        up: dict = {}

        def root(c):
            while c in up:
                c = up[c]
            return c

        found, right = [], np.flatnonzero(part == j)
        for x in np.flatnonzero(part == i):
            differ = bits[right] ^ bits[x]
            shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            likely = np.flatnonzero((shared >= cfg.least_bytes) & (label[right] != label[x]))
            for y in right[likely[np.bitwise_count(differ[likely]) <= cfg.most_bits]]:
                p, q = root(int(label[x])), root(int(label[y]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((int(fp[x]), int(fp[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return units.groupBy("at", "bytes", "i", "j").applyInArrow(unit, "a long, b long")


def _ties(usable: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of rows that share a doc_id."""
    least = usable.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b <> most").select("doc_id", "b")
    return usable.join(least, "doc_id").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, cfg: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without white space, A-Z lower-cased; a document's shingles are its
    ``shingle``-word runs with repeats, or its whole sequence when it has fewer words. Documents
    without words (null, empty or blank text) have the fingerprint zero and are linked like any
    other. Rows that share a doc_id count as one document, so their fingerprints are linked. A row
    without doc_id is linked with nothing: component_id null. Other columns of ``docs`` are not
    read. An empty table gives an empty table.
    """
    prints = written(fingerprints(docs, cfg, id_col, text_col), "fingerprints")
    usable = prints.filter("doc_id is not null")
    classes = written(usable.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "classes")
    keyed = classes.select("fp", F.explode(posting_keys(F.col("fp"), cfg)).alias("key")).select("fp", "key.*")
    lists = keyed.groupBy("at", "bytes").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    # merged, here and below: Spark sizes lists as the table before the explode, and would broadcast many times its bound
    members = written(keyed.join(lists.hint("merge"), ["at", "bytes"]), "members")
    stars = members.select(F.col("fp").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter("a <> b")
    links = written(_verified(stars, cfg).unionByName(_ties(usable)), "links")
    label = components(links)

    named = members.select("at", "bytes", "fp").join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = named.groupBy("at", "bytes").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("at", "bytes")
    rest = written(named.join(open_.hint("merge"), ["at", "bytes"]), "open")
    if not rest.isEmpty():
        label = components(written(links.unionByName(_block_links(rest, cfg)), "links"))
    named = written(classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    smallest = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    placed = prints.join(named.join(smallest, "label").select("fp", "component_id"), "fp", "left")
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), BYTES * 2, "0")).alias("fingerprint"),
                         F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
