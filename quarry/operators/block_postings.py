"""Postings dealt by document blocks: tf-idf scores, skipping, top-k and rank counts inside the partition.

A block is one row: the postings of up to ``BLOCK_DOCS`` documents that follow each other by doc_id, as
arrays by term, with each term's largest weight in the block. A row is never split between
tasks, so a task holds every posting of its documents and finishes their scores itself; what
leaves it is bounded by the queries (k rows, the wanted pairs, slot counts), never by
queries x documents:

* ``top_n``: a query skips a block whose bound, the sum of query weight x largest weight, can't
  reach the query's n-th best score so far in the task;
* ``pair_scores``: scores of wanted (query, document) pairs;
* ``rank_slots``: per query, how many scored documents fall between neighbouring rank keys;
* ``extremes``: per query, largest and smallest positive score and the number of positive ones.

The query side is a broadcast of at most ``MAX_QUERY_TERMS`` (query, term, weight) rows; larger
query sets take the shuffle join of ``tfidf.cosine_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DOCS = 1024
MAX_QUERY_TERMS = 2_000_000      # 20 bytes each in a task
CELLS = 4_000_000                # queries x documents scored at a time in a task
MARGIN = 1e-6                    # above float noise, not above the 6-digit rounding step
BLOCK_SCHEMA = ("terms array<int>, sizes array<int>, peaks array<double>, "
                "docs array<long>, at array<int>, tfs array<long>, weights array<double>")
FORWARD_DOCS = 8192              # documents and postings after which a forward row is closed
FORWARD_POSTINGS = 400_000
FORWARD_SLICE = 256              # documents counted at a time
FORWARD_SCHEMA = "block long, docs array<long>, words array<string>, sizes array<int>, at array<int>, tfs array<int>"


def list_row(columns: list) -> list[pa.Array]:
    """One row of lists: (values, type) by column."""
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in columns]


def pack(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, tf: np.ndarray, unit: bool) -> pa.RecordBatch:
    """The block of these postings."""
    order = np.lexsort((doc, term))
    doc, term, weight, tf = doc[order], term[order], weight[order], tf[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    docs, at = np.unique(doc, return_inverse=True)
    if unit:
        weight = weight / np.sqrt(np.bincount(at, weight * weight))[at]
    return pa.RecordBatch.from_arrays(
        list_row([(term[starts], pa.int32()), (np.diff(np.r_[starts, len(term)]), pa.int32()), (np.maximum.reduceat(weight, starts), pa.float64()),
                  (docs, pa.int64()), (at, pa.int32()), (tf, pa.int64()), (weight, pa.float64())]),
        names=["terms", "sizes", "peaks", "docs", "at", "tfs", "weights"])


def build_blocks(postings: DataFrame, partitions: int, unit: bool = False) -> DataFrame:
    """postings (doc_id, term_index, weight, optionally tf) -> one row per block; one shuffle, by ranges of doc_id.

    ``unit``: weights are divided by their document's L2 norm, which a task has at hand.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n_docs, last = [], 0, None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.r_[cols[0][0] != last, cols[0][1:] != cols[0][:-1]])   # rows where a new document begins
            at = 0
            for i in starts[(BLOCK_DOCS - n_docs) :: BLOCK_DOCS].tolist():   # rows where a new block begins
                open_.append([c[at:i] for c in cols])
                yield pack(*(np.concatenate(c) for c in zip(*open_)), unit)
                open_, at = [], i
            open_.append([c[at:] for c in cols])
            n_docs = (n_docs + len(starts) - 1) % BLOCK_DOCS + 1 if n_docs + len(starts) else 0
            last = cols[0][-1]
        if open_:
            yield pack(*(np.concatenate(c) for c in zip(*open_)), unit)

    tf = F.col("tf").cast("long") if "tf" in postings.columns else F.lit(1).cast("long").alias("tf")
    rows = postings.select("doc_id", F.col("term_index").cast("int").alias("term_index"), "weight", tf)
    return rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "term_index").mapInArrow(run, BLOCK_SCHEMA)


def forward_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, toks), documents together and in order within a partition -> rows of up to ``FORWARD_POSTINGS`` postings
    or ``FORWARD_DOCS`` documents: their ids, distinct words and, by word, the number of postings, then the postings'
    document places and term counts.

    Words are strings once a row only, so what has to be looked up or counted by word is far less than the postings.
    """
    def close(block: int, parts: list) -> pa.RecordBatch:
        doc, word, tf = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        shift = np.cumsum([0] + [len(p[4]) for p in parts[:-1]])
        base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        names = pa.concat_arrays([p[4] for p in parts]).dictionary_encode()
        code = names.indices.to_numpy().astype(np.int64)
        word = code[word + np.repeat(shift, [len(p[2]) for p in parts])]
        at = place[doc + np.repeat(base, [len(p[1]) for p in parts])]
        order = np.lexsort((at, word))
        sizes = np.bincount(word, minlength=len(names.dictionary))
        used = sizes > 0
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64())] + list_row([(ids, pa.int64()), (names.dictionary.filter(pa.array(used)), pa.string()), (sizes[used], pa.int32()),
                                                       (at[order], pa.int32()), (tf[order], pa.int32())]),
            names=["block", "docs", "words", "sizes", "at", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        parts, n_docs, n_rows, last = [], 0, 0, None
        for whole in batches:
            for batch in (whole.slice(i, FORWARD_SLICE) for i in range(0, whole.num_rows, FORWARD_SLICE)):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                # a block ends between documents only: rows with one id stay together
                if (n_docs >= FORWARD_DOCS or n_rows >= FORWARD_POSTINGS) and ids[0] != last:
                    yield close(block, parts)
                    block, parts, n_docs, n_rows = block + 1, [], 0, 0
                flat = batch.column("toks").flatten().dictionary_encode()
                row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(batch.column("toks")), 0).to_numpy())
                width = max(1, len(flat.dictionary))
                key, tf = np.unique(row * width + flat.indices.to_numpy(), return_counts=True)
                doc, word = np.divmod(key, width)
                parts.append((ids, doc, word, tf, flat.dictionary))
                n_docs, n_rows, last = n_docs + len(ids), n_rows + len(key), ids[-1]
        if parts:
            yield close(block, parts)

    return docs.select("doc_id", "toks").mapInArrow(run, FORWARD_SCHEMA)


def blocks_of_forward(forward: DataFrame) -> DataFrame:
    """Blocks of unit weights from rows of ``forward_blocks`` with ``found``, an array of (pos, term_index, idf) of the
    words that are terms; no shuffle. Each block keeps its terms' words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                get = lambda n: cols[n][r].values.to_numpy(zero_copy_only=False)
                found = cols["found"][r].values
                pos, index, idf = (found.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "term_index", "idf"))
                sizes, docs = get("sizes"), get("docs")
                term_of, idf_of = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes))
                term_of[pos], idf_of[pos] = index, idf
                word = np.repeat(np.arange(len(sizes)), sizes)
                kept = term_of[word] >= 0
                word, at, tf = word[kept], get("at")[kept], get("tfs")[kept].astype(np.int64)
                by_term = np.argsort(index)
                with_terms = np.unique(at)    # documents without a term take no place
                part = (np.searchsorted(with_terms, at) // BLOCK_DOCS).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part))
                for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    mine = order[lo:hi]
                    w = word[mine]
                    block = pack(docs[at[mine]], term_of[w], tf[mine] * idf_of[w], tf[mine], True)
                    places = by_term[np.searchsorted(index[by_term], block.column("terms")[0].values.to_numpy())]
                    words = cols["words"][r].values.take(pa.array(pos[places]))
                    yield pa.RecordBatch.from_arrays(block.columns + list_row([(words, pa.string())]), names=block.schema.names + ["words"])

    return forward.select("docs", "words", "sizes", "at", "tfs", "found").mapInArrow(run, BLOCK_SCHEMA + ", words array<string>")


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """([term,] term_index, doc_id, tf, weight): the postings of the blocks, without a shuffle; ``term`` if they keep words."""
    names = ["term_index", "doc_id", "tf", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                get = lambda n: cols[n][r].values.to_numpy(zero_copy_only=False)
                rows = [pa.array(np.repeat(get("terms"), get("sizes")), pa.int32()), pa.array(get("docs")[get("at")], pa.int64()), cols["tfs"][r].values, cols["weights"][r].values]
                if "words" not in cols:
                    yield pa.RecordBatch.from_arrays(rows, names=names)
                    continue
                words = cols["words"][r].values.take(pa.array(np.repeat(np.arange(len(get("sizes"))), get("sizes"))))
                yield pa.RecordBatch.from_arrays([words] + rows, names=["term"] + names)

    schema = "term_index int, doc_id long, tf long, weight double"
    return blocks.mapInArrow(run, "term string, " + schema if "words" in blocks.columns else schema)


class QueryTerms:
    """Query weights by term: rows ``ptr[i]:ptr[i + 1]`` of ``query`` (numbers of ``ids``) and ``weight`` are of ``terms[i]``."""

    def __init__(self, query_id: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.ids, number = np.unique(query_id, return_inverse=True)
        order = np.lexsort((number, term))
        self.terms, first = np.unique(term[order], return_index=True)
        self.ptr = np.r_[first, len(term)]
        self.query, self.weight = number[order], weight[order]


def query_terms(qw: DataFrame, known_rows: int | None = None) -> QueryTerms | None:
    """The broadcastable query side of (query_id, term_index, weight), or None when it is too large."""
    n = known_rows if known_rows is not None else qw.limit(MAX_QUERY_TERMS + 1).count()
    if n > MAX_QUERY_TERMS:
        return None
    rows = qw.select("query_id", "term_index", "weight").toPandas()   # bounded above
    return QueryTerms(rows["query_id"].to_numpy(np.int64), rows["term_index"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64))


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Spark's ``round`` of doubles: half up on the shortest decimal form."""
    scale = 10.0 ** digits
    out = np.rint(x * scale) / scale
    fraction = np.abs(x * scale - np.floor(x * scale) - 0.5)
    for i in zip(*np.nonzero(fraction < 1e-4)):   # near a half the decimal form decides
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _parts(batches: Iterator[pa.RecordBatch], q: QueryTerms, floor: np.ndarray | None):
    """Per block and group of queries: (query numbers, their documents, scores queries x documents).

    Queries without a term in the block, or whose bound there is under ``floor`` (read anew for
    each block), are left out.
    """
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        for r in range(batch.num_rows):
            get = lambda n: cols[n][r].values.to_numpy(zero_copy_only=False)
            terms, peaks = get("terms"), get("peaks")
            where = np.minimum(np.searchsorted(q.terms, terms), max(len(q.terms) - 1, 0))
            mine = np.flatnonzero(q.terms[where] == terms) if len(q.terms) else np.zeros(0, np.int64)
            if not len(mine):
                continue
            where = where[mine]
            n_rows = q.ptr[where + 1] - q.ptr[where]
            row = np.repeat(q.ptr[where] - np.r_[0, np.cumsum(n_rows)[:-1]], n_rows) + np.arange(n_rows.sum())
            bound = np.bincount(q.query[row], q.weight[row] * np.repeat(peaks[mine], n_rows), len(q.ids))
            active = np.flatnonzero((bound > 0) & (bound >= floor - MARGIN if floor is not None else True))
            if not len(active):
                continue
            docs, at, weights = get("docs"), get("at"), get("weights")
            sizes = get("sizes")
            start = np.cumsum(sizes) - sizes
            step = max(1, CELLS // len(docs))
            for i in range(0, len(active), step):
                group = active[i : i + step]
                place = np.full(len(q.ids), -1)
                place[group] = np.arange(len(group))
                scores = np.zeros((len(group), len(docs)))
                for t, w in zip(mine.tolist(), where.tolist()):
                    to = place[q.query[q.ptr[w] : q.ptr[w + 1]]]
                    has = to >= 0
                    if has.any():
                        d = slice(start[t], start[t] + sizes[t])
                        scores[to[has][:, None], at[d][None, :]] += q.weight[q.ptr[w] : q.ptr[w + 1]][has][:, None] * weights[d][None, :]
                yield group, docs, scores


def best_rows(query: np.ndarray, doc: np.ndarray, raw: np.ndarray, n: int, floor: np.ndarray) -> np.ndarray:
    """Rows that may be among each query's n best by rounded score and doc_id; raises ``floor`` to the n-th best.

    Rows within the margin of the n-th best stay, of equal scores the n smallest doc_ids.
    """
    order = np.lexsort((doc, -raw, query))
    query, raw = query[order], raw[order]
    new = np.r_[True, query[1:] != query[:-1]]
    rank = np.arange(len(query)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    nth = rank == n - 1
    floor[query[nth]] = np.maximum(floor[query[nth]], raw[nth])
    equal = np.r_[True, (query[1:] != query[:-1]) | (np.abs(raw[1:] - raw[:-1]) > 1e-12)]
    copies = np.arange(len(query)) - np.flatnonzero(equal)[np.cumsum(equal) - 1]
    return order[(rank < n) | ((raw >= floor[query] - MARGIN) & (copies < n))]


def top_n(blocks: DataFrame, q: QueryTerms, n: int) -> DataFrame:
    """(query_id, doc_id, raw): per task, a superset of each query's n best positive documents, about n rows."""
    bc = blocks.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = bc.value
        floor = np.zeros(len(q.ids))
        pool = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for group, docs, scores in _parts(batches, q, floor):
            i, j = np.nonzero((scores > 0) & (scores >= floor[group][:, None] - MARGIN))
            pool = [np.r_[old, new] for old, new in zip(pool, (group[i], docs[j], scores[i, j]))]
            if len(pool[0]):
                keep = best_rows(*pool, n, floor)
                pool = [c[keep] for c in pool]
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[pool[0]], pa.int64()), pa.array(pool[1], pa.int64()), pa.array(pool[2], pa.float64())],
                                         names=["query_id", "doc_id", "raw"])

    return blocks.mapInArrow(run, "query_id long, doc_id long, raw double")


def pair_scores(blocks: DataFrame, q: QueryTerms, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw) of the wanted pairs with a positive score; ``pairs`` (query_id, doc_id) is for the caller to bound."""
    rows = pairs.select("query_id", "doc_id").toPandas()
    wanted = rows[rows["query_id"].isin(q.ids)]
    query, doc = np.searchsorted(q.ids, wanted["query_id"].to_numpy(np.int64)), wanted["doc_id"].to_numpy(np.int64)
    order = np.lexsort((query, doc))
    bc = blocks.sparkSession.sparkContext.broadcast((q, query[order], doc[order]))

    def run(batches):
        q, query, doc = bc.value
        for group, docs, scores in _parts(batches, q, None):
            lo, hi = np.searchsorted(doc, docs[0]), np.searchsorted(doc, docs[-1], "right")
            place = np.full(len(q.ids), -1)
            place[group] = np.arange(len(group))
            j = np.minimum(np.searchsorted(docs, doc[lo:hi]), len(docs) - 1)
            i = place[query[lo:hi]]
            has = (i >= 0) & (docs[j] == doc[lo:hi])
            raw = scores[i[has], j[has]]
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[query[lo:hi][has]], pa.int64()), pa.array(doc[lo:hi][has], pa.int64()), pa.array(raw, pa.float64())],
                                             names=["query_id", "doc_id", "raw"])

    return blocks.mapInArrow(run, "query_id long, doc_id long, raw double")


def key_slots(score: np.ndarray, doc: np.ndarray, key_score: np.ndarray, key_doc: np.ndarray) -> np.ndarray:
    """Number of keys that stand before or at each row; keys are sorted by score descending, then doc."""
    lo, hi = (np.searchsorted(-key_score, -score, side) for side in ("left", "right"))
    out = lo.copy()
    for i in np.flatnonzero(lo < hi):
        out[i] += np.searchsorted(key_doc[lo[i] : hi[i]], doc[i], "right")
    return out


def rank_slots(blocks: DataFrame, q: QueryTerms, keys: DataFrame, digits: int) -> DataFrame:
    """(query_id, kind, slot, n) per task: documents of positive rounded score by the number of keys before or at them.

    ``keys`` (query_id, doc_id, score): those of positive score are rank keys (kind 0: score
    descending, then doc_id), those of score 0 are doc_id keys (kind 1). The caller bounds them.
    """
    rows = keys.select("query_id", "doc_id", "score").toPandas()
    by_query = {}
    for i, r in rows.groupby("query_id"):
        ranked, zero = r[r["score"] > 0].sort_values(["score", "doc_id"], ascending=[False, True]), r[r["score"] == 0]
        by_query[int(i)] = (ranked["score"].to_numpy(np.float64), ranked["doc_id"].to_numpy(np.int64), np.sort(zero["doc_id"].to_numpy(np.int64)))
    bc = blocks.sparkSession.sparkContext.broadcast((q, by_query))
    none = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        q, by_query = bc.value
        counts: dict = {}
        for group, docs, scores in _parts(batches, q, None):
            rounded = round_half_up(scores, digits)
            for g, row in zip(group.tolist(), rounded):
                scored = row > 0
                key_score, key_doc, zero = by_query.get(int(q.ids[g]), none)
                for kind, slots, n in ((0, key_slots(row[scored], docs[scored], key_score, key_doc), len(key_doc)),
                                       (1, np.searchsorted(zero, docs[scored], "right"), len(zero))):
                    new = np.bincount(slots, minlength=n + 1)
                    counts[g, kind] = counts[g, kind] + new if (g, kind) in counts else new
        out = [(int(q.ids[g]), kind, int(s), int(c[s])) for (g, kind), c in counts.items() for s in np.flatnonzero(c)]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["query_id", "kind", "slot", "n"])

    return blocks.mapInArrow(run, "query_id long, kind int, slot int, n long")


def extremes(blocks: DataFrame, q: QueryTerms, digits: int) -> DataFrame:
    """(query_id, hi, lo, n) per task: largest, smallest and number of positive rounded scores."""
    bc = blocks.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = bc.value
        hi, lo, n = np.zeros(len(q.ids)), np.full(len(q.ids), np.inf), np.zeros(len(q.ids), np.int64)
        for group, _, scores in _parts(batches, q, None):
            rounded = round_half_up(scores, digits)
            hi[group] = np.maximum(hi[group], rounded.max(axis=1))
            lo[group] = np.minimum(lo[group], np.where(rounded > 0, rounded, np.inf).min(axis=1))
            n[group] += (rounded > 0).sum(axis=1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[some], pa.int64()), pa.array(hi[some]), pa.array(lo[some]), pa.array(n[some])], names=["query_id", "hi", "lo", "n"])

    return blocks.mapInArrow(run, "query_id long, hi double, lo double, n long")
