"""Repetition inside documents by suffix arrays, and the counts of the base quality rules.

A batch's documents share one suffix array over words, built by prefix doubling: at each step
only suffixes that still tie are sorted again, and suffixes of different documents never tie. The
ranks kept from each step give the longest common prefix of neighbours by binary descent, without
a sequential pass. A suffix's longer neighbour prefix is the longest repeat that starts there; it
is a maximal one unless the suffix before it has a repeat longer by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """A text fails if repeats of ``least`` words or more cover over ``covered`` of its words, or one is longer than ``longest``."""

    least: int = 10
    covered: float = 0.3
    longest: int = 120
    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20


def _longest_repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that its document has elsewhere too."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = np.repeat(first[1:], np.diff(first))
    key = T.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rank = np.empty(n, np.int64)
    active, levels, span = np.arange(n), [], 1
    base = np.zeros(n, np.int64)
    while True:
        by = np.lexsort((key, base)) if span > 1 else np.argsort(key, kind="stable")
        active, key, base = active[by], key[by], base[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (base[1:] != base[:-1])])
        group = np.concatenate([[True], base[1:] != base[:-1]])
        at = np.arange(len(active))
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = base + head - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(np.int32))
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        if not len(active):
            break
        ahead = active + span
        inside = ahead < stop[active]
        key = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        base = rank[active]
        span *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[tied], b[tied]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < stop[a]) & (y < stop[b])
        same = ok & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)]) & (x != y)
        common[same] += 1 << level
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated_windows(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words that stand in a k-word window found twice or more in their document."""
    n = len(h)
    if n < k:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    w = T.windows(h, k)
    at = np.flatnonzero(doc[: len(w)] == doc[k - 1 :])
    if not len(at):
        return np.zeros(n, bool)
    key = T.mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = by[np.append(same, False) | np.insert(same, 0, False)]
    return _covered(at[twice], np.full(len(twice), k), n)


def _dup_lines(text: str | None) -> int:
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _spans(repeat: np.ndarray, first: np.ndarray, least: int):
    """Starts and lengths of the maximal repeats of ``least`` words or more."""
    long = repeat >= least
    tail = np.zeros(len(repeat), bool)
    tail[1:] = repeat[:-1] == repeat[1:] + 1
    tail[first[:-1][first[:-1] < len(repeat)]] = False
    start = np.flatnonzero(long & ~tail)
    return start, repeat[start]


def quality_rules(docs: DataFrame, cfg: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words,
    longest_repeat, spans (array of [start, end) word ranges of the united repeats), kept.

    Null, empty and blank texts have no words: all counts 0, base_failed true. Rows are judged one
    by one, so repeated rows and ids give repeated results and a null id stays null. Other
    columns are not read.
    """
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            texts = batch.column(1)
            for i, j in T.slices(offsets, 1 << 22):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = T.Words(part, off, T.NOT_SPACE)
                h, n_words = w.hashes(), np.diff(w.first)
                chars = _per_doc(T.NOT_SPACE[part] & ((part & 0xC0) != 0x80), off)
                again = _per_doc(_repeated_windows(h, w.first, cfg.window), w.first)
                repeat = _longest_repeats(h, w.first)
                start, length = _spans(repeat, w.first, cfg.least)
                cover = _covered(start, length, len(h))
                covered = _per_doc(cover, w.first)
                edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                cuts = w.first[1:-1]
                inner = cuts[(cuts > 0) & (cuts < len(h))]
                split = inner[cover[inner] & cover[inner - 1]] if len(inner) else inner
                split = np.unique(split)
                lo, hi = np.sort(np.concatenate([lo, split])), np.sort(np.concatenate([hi, split]))
                bounds = np.searchsorted(lo, w.first)
                spans = [[[int(x - w.first[d]), int(y - w.first[d])] for x, y in zip(lo[bounds[d] : bounds[d + 1]], hi[bounds[d] : bounds[d + 1]])]
                         for d in range(j - i)]
                longest = np.zeros(j - i, np.int64)
                if len(repeat):
                    full = np.flatnonzero(n_words)
                    longest[full] = np.maximum.reduceat(repeat, w.first[:-1][full])
                failed = (n_words < cfg.min_words) | (100 * again > cfg.max_repeat_percent * n_words)
                kept = ~failed & (covered <= cfg.covered * n_words) & (longest <= cfg.longest)
                cols = [n_words, chars, _per_doc(symbol[part], off),
                        np.array([_dup_lines(t) for t in texts.slice(i, j - i).to_pylist()], np.int64), again]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(failed),
                     pa.array(covered.astype(np.int64)), pa.array(longest), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "covered_words", "longest_repeat", "spans", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                "base_failed boolean, covered_words long, longest_repeat long, spans array<array<long>>, kept boolean")
