"""Toxicity through a noisy channel.

Spans that look disguised (digits or signs beside letters, letters repeated, three or more letters
spaced out) are decoded: each sign opens a set of letters it may stand for, separators may vanish, a
run of equal letters may mean one or two, and Viterbi picks the letters that a character trigram
model finds likeliest. The model mixes trigram counts over the whole corpus with the spelling of the
learned words. Neighbouring words that together spell a learned word are joined, unless each of
them is an ordinary word. Plain and restored words are then scored together.

The lexicon is learned from labelled documents: words, and beginnings that several words share, that
toxic documents have far more often than others; a ridge logistic regression weighs them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T
from quarry.llm.quality import bounded_sample
from quarry.plans.sizing import bounded_broadcast
from quarry.session import written

#: letters that a sign may stand for, besides itself if it is a letter
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "*": "aeiou"}
EDGES = "!|+(*"
SIGNS = "".join(LEET)
FOLD = dict(zip("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"))
GAPS = frozenset(" .-_*~'·,​")

_LEET_BYTES = np.zeros(256, bool)
_LEET_BYTES[list(b"0123456789@$!|+(*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_UNIT = T.ALNUM | _LEET_BYTES
#: 28 character classes of the model: 0 any separator, 1-26 letters, 27 all others
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = _CLASS[0x30:0x3A] = 27
_GAP_BYTES = np.zeros(256, bool)
_GAP_BYTES[[ord(c) for c in GAPS if c < "\x80"]] = True
_WIDE_GAPS = [np.frombuffer(c.encode(), np.uint8) for c in sorted(GAPS) if c >= "\x80"]


@dataclass(frozen=True)
class ToxicityModel:
    """``sample`` bounds the labelled documents that the lexicon is learned from, ``candidates`` the words,
    and the word beginnings, that are weighed. ``surprise`` is the least z-score of a candidate."""

    sample: int = 20_000
    candidates: int = 600
    support: int = 4
    surprise: float = 3.0
    shortest: int = 4
    longest: int = 8
    ridge: float = 0.2
    threshold: float = 0.3


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """28 x 28 x 28 counts of character classes over every text; one row a task and trigram is summed in Spark."""

    def run(batches):
        total = np.zeros(28**3, np.int64)
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            for i, j in T.slices(offsets, 1 << 22):
                c = _CLASS[data[offsets[i] : offsets[j]]]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["trigram", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    out = np.zeros(28**3)
    for r in sums.collect():  # at most 28^3 rows
        out[r["trigram"]] = r["n"]
    return out.reshape(28, 28, 28)


def _char_class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else (0 if ch == " " else 27)


def _single(word: str) -> str:
    """The word with runs of one letter shortened to one."""
    return "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])


class Decoder:
    """Viterbi over the letters that a disguised span may stand for."""

    def __init__(self, counts: np.ndarray, words: list[str], ordinary: frozenset[str] = frozenset()):
        """``ordinary``: pieces of ``words`` that are words in their own right."""
        own = np.zeros((28, 28, 28))
        for w in words:
            c = [0, 0, *(_char_class(x) for x in w), 0]
            for a, b, d in zip(c, c[1:], c[2:]):
                own[a, b, d] += 1
        smooth = lambda n: (n + 0.01) / (n.sum(axis=2, keepdims=True) + 0.28)
        self.log = np.log(0.5 * smooth(counts) + 0.5 * smooth(own)).tolist()
        self.spelt = {_single(w): w for w in words}
        self.words, self.ordinary = frozenset(words), ordinary
        self.heads = {w[:k] for w in words for k in range(1, len(w))}
        inner = {w[a:b] for w in words for a in range(1, len(w)) for b in range(a + 1, len(w) + 1)}
        self.pieces = [np.sort(_hash_of(sorted(x))) for x in (self.heads, inner)] if self.heads else None
        self.known: dict[tuple[str, bool], str] = {}

    def decode(self, span: str, spaced: bool) -> str:
        """The restored lower-case word; ``spaced`` lets separators vanish."""
        key = (span, spaced)
        if key not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            text = self._viterbi(span.strip(EDGES), spaced)
            self.known[key] = self.spelt.get(_single(text), text)
        return self.known[key]

    def restored(self, span: str, spaced: bool) -> str | None:
        """The restored word, None if nothing is disguised.

        Marks at a word's edge are letters only where that spells a learned word; a learned word between digits or signs counts too.
        """
        if not spaced and span.strip(EDGES) != span:
            whole = self.spelt.get(_single(self._whole(span)))
            if whole is not None:
                return whole
            if not _looks_disguised(span.strip(EDGES)):
                return None
        text = self.decode(span, spaced)
        if not spaced and text not in self.words and (bare := self.spelt.get(_single(span.strip(SIGNS).lower()))):
            return bare
        return text

    def _whole(self, span: str) -> str:
        key = (span, None)
        if key not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[key] = self._viterbi(span, False)
        return self.known[key]

    def joined(self, w: T.Words, gap: np.ndarray):
        """(first word, last, learned word) of neighbouring words that spell it together, not all of them ordinary words.

        ``gap``: whether only separators that may vanish stand between a word and the next.
        """
        if self.pieces is None or len(w) < 2:
            return
        own = w.hashes()
        head, inner = (x[np.minimum(np.searchsorted(x, own), len(x) - 1)] == own for x in self.pieces)
        raw, last = w.data.tobytes(), -1
        for i in np.flatnonzero(head[:-1] & inner[1:] & gap).tolist():
            if i <= last:
                continue
            text, k, plain = "", i, True
            while k < len(w) and (k == i or (inner[k] and gap[k - 1])):
                piece = raw[w.start[k] : w.end[k]].decode("utf-8", "replace")
                text, plain = text + piece, plain and piece in self.ordinary
                if k > i and text in self.words and not plain:
                    yield i, k, text
                    last = k
                if text not in self.heads:
                    break
                k += 1

    def _viterbi(self, span: str, spaced: bool) -> str:
        lattice, s = [], [FOLD.get(c, c) for c in span.lower()]
        i = 0
        while i < len(s):
            c, run = s[i], 1
            while i + run < len(s) and s[i + run] == c:
                run += 1
            if spaced and c in GAPS:
                i += run
                continue
            letters = LEET.get(c, c)
            price = -0.7 if c in LEET else 0.0
            edges = [(x, price) for x in letters] + [(x + x, price) for x in letters if run > 1]
            lattice.append(edges)
            i += run
        best = {(0, 0): (0.0, "")}
        for edges in lattice:
            after: dict = {}
            for (a, b), (cost, text) in best.items():
                for letters, price in edges:
                    p, q, total = a, b, cost + price
                    for x in letters:
                        k = _char_class(x)
                        total += self.log[p][q][k]
                        p, q = q, k
                    if (p, q) not in after or after[p, q][0] < total:
                        after[p, q] = (total, text + letters)
            best = after
        return max(((cost + self.log[a][b][0], text) for (a, b), (cost, text) in best.items()), default=(0, ""))[1]


_DISGUISE = re.compile(r"[A-Za-z][0-9@$!|+(*]|[0-9@$!|+(*][A-Za-z]|([A-Za-z])\1\1", re.IGNORECASE)


def _looks_disguised(word: str) -> bool:
    return _DISGUISE.search(word) is not None


def _plain_gaps(data: np.ndarray) -> np.ndarray:
    """The bytes with separators outside ASCII as spaces, as many as they have bytes."""
    out = data
    for code in _WIDE_GAPS:
        n = len(code)
        first = data[: max(len(data) - n + 1, 0)] == code[0]
        for k in range(1, n):
            first &= data[k : len(data) - n + 1 + k] == code[k]
        spots = np.flatnonzero(first)
        if len(spots):
            out = out.copy() if out is data else out
            out[spots[:, None] + np.arange(n)] = 0x20
    return out


def _steps(data: np.ndarray, w: T.Words) -> np.ndarray:
    """Characters between each word and the next, of the text before ``_plain_gaps``."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return chars[w.start[1:]] - chars[w.end[:-1]]


def _disguised(data: np.ndarray, offsets: np.ndarray, seen: np.ndarray | None = None):
    """(document, first byte, last, spaced) of the spans to decode in a part of a batch; ``seen``: its bytes before ``_plain_gaps``."""
    out = []
    w = T.Words(data, offsets, _UNIT.astype(np.uint8))
    if not len(w):
        return out
    n = len(data)
    letter, leet = _LETTER[data], _LEET_BYTES[data]
    odd = np.zeros(n + 1, bool)
    odd[: n - 1] = (leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:])
    lower = T.LOWER[data]
    if n > 2:
        odd[: n - 2] |= (lower[:-2] == lower[1:-1]) & (lower[1:-1] == lower[2:]) & letter[:-2]
    total = np.concatenate([[0], np.cumsum(odd[:n], dtype=np.int64)])
    some_letter = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    doc = w.doc()
    hit = np.flatnonzero((total[w.end] > total[w.start]) & (some_letter[w.end] > some_letter[w.start]))
    out += [(int(doc[i]), int(w.start[i]), int(w.end[i]), False) for i in hit]
    # three or more single signs with at most two characters between them; three with a letter among them
    single = (w.end - w.start) == 1
    tied = np.zeros(len(w) + 1, bool)
    tied[1:-1] = single[1:] & single[:-1] & (_steps(data if seen is None else seen, w) <= 2) & (doc[1:] == doc[:-1])
    edge = np.flatnonzero(tied[1:] != tied[:-1])
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= 3 or (b - a == 2 and some_letter[w.end[b]] > some_letter[w.start[a]]):
            out.append((int(doc[a]), int(w.start[a]), int(w.end[b]), True))
    return sorted(out)


def _restored(column, decoder: Decoder):
    """Per part of a batch: (first document, last, plain words, [(document, start, end, spaced, restored)])."""
    data, offsets = T.utf8(column)
    for i, j in T.slices(offsets, 1 << 21):
        seen, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        part = _plain_gaps(seen)
        plain = T.Words(T.LOWER[part], off, T.ALNUM)
        spans = [(d, s, e, spaced, decoder.restored(part[s:e].tobytes().decode("utf-8", "replace"), spaced)) for d, s, e, spaced in _disguised(part, off, seen)]
        spans = [x for x in spans if x[4] is not None]
        if decoder.words and len(plain) > 1:
            doc = plain.doc()
            solid = np.concatenate([[0], np.cumsum(~_GAP_BYTES[part], dtype=np.int64)])
            gap = (_steps(seen, plain) <= 2) & (solid[plain.start[1:]] == solid[plain.end[:-1]]) & (doc[1:] == doc[:-1])
            by_doc: dict = defaultdict(list)
            for x in spans:
                by_doc[x[0]].append(x)
            for a, b, word in decoder.joined(plain, gap):
                d, s, e = int(doc[a]), int(plain.start[a]), int(plain.end[b])
                if not any(x[1] <= s and e <= x[2] and word in x[4] for x in by_doc[d]):  # not decoded already
                    spans.append((d, s, e, False, word))
            spans.sort(key=lambda x: x[:3])
        yield i, j, plain, spans


def _hash_of(words: list[str]) -> np.ndarray:
    return T.Words(*T.utf8(pa.array(words, pa.string())), np.ones(256, np.uint8)).hashes()


_PIECE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _surprising(counts: DataFrame, key: str, n1: int, n0: int, cfg: ToxicityModel) -> list[str]:
    """The ``candidates`` keys that label 1 has most surprisingly often, from columns c1 (documents with label 1) and c (all)."""
    c1, c0 = F.col("c1") + 0.5, F.col("c") - F.col("c1") + 0.5
    lift = F.log(c1 / (n1 + 1.0)) - F.log(c0 / (n0 + 1.0))
    z = counts.filter(F.col("c1") >= cfg.support).withColumn("z", lift / F.sqrt(1 / c1 + 1 / c0)).filter((F.col("z") >= cfg.surprise) & (lift > 1))
    return sorted(r[key] for r in z.orderBy(F.desc("z"), key).limit(cfg.candidates).select(key).collect())


def _features(sample: DataFrame, decoder: Decoder, cfg: ToxicityModel) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The sample's (row, word, y), and features, (row, feature) pairs and labels.

    A feature is a word; ``beg*``, a longer word that begins so; or ``beg**``, two such words.
    Every word's and beginning's frequency by label is counted in Spark; only the chosen ones and
    the sampled documents that have them come to the driver.
    """

    def run(batches):
        for batch in batches:
            row, word, label = [], [], []
            for i, j, plain, spans in _restored(batch.column(1), decoder):
                texts = [set() for _ in range(j - i)]
                raw = plain.data.tobytes()
                for d, s, e in zip(plain.doc().tolist(), plain.start.tolist(), plain.end.tolist()):
                    texts[d].add(raw[s:e].decode("utf-8", "replace"))
                for d, _, _, _, text in spans:
                    texts[d].update(_PIECE.findall(text))
                ids, ys = batch.column(0).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_pylist()
                for k, y, words in zip(ids, ys, texts):
                    row += [k] * len(words)
                    label += [y] * len(words)
                    word += sorted(words)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.string()), pa.array(label, pa.int32())], names=["row", "word", "y"])

    found = written(sample.select("row", "text", "y").mapInArrow(run, "row long, word string, y int"), "labelled-words")
    ys = {r["row"]: r["y"] for r in sample.select("row", "y").collect()}  # at most ``sample`` rows
    n1 = sum(ys.values())
    n0 = len(ys) - n1
    by_word = found.groupBy("word").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c"))
    words = _surprising(by_word, "word", n1, n0, cfg)
    begin = F.explode(F.transform(F.sequence(F.lit(cfg.shortest), F.least(F.lit(cfg.longest), F.length("word") - 1)), lambda n: F.col("word").substr(F.lit(1), n)))
    longer = F.length("word") > cfg.shortest
    by_begin = by_word.filter(longer).select(begin.alias("begin"), "c1", "c").groupBy("begin").agg(
        F.sum("c1").alias("c1"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 2")
    begins = _surprising(by_begin, "begin", n1, n0, cfg)
    hits = [(r["row"], r["word"]) for r in found.filter(F.col("word").isin(words)).select("row", "word").collect()]  # sample x candidates at most
    families = found.filter(longer).select("row", begin.alias("begin")).filter(F.col("begin").isin(begins)).groupBy("row", "begin").count()
    for r in families.collect():  # sample x candidates at most
        hits += [(r["row"], r["begin"] + "*")] + [(r["row"], r["begin"] + "**")] * (r["count"] > 1)
    names = sorted({f for _, f in hits})
    number, order = {f: i for i, f in enumerate(names)}, {k: i for i, k in enumerate(sorted(ys))}
    pairs = np.array(sorted((order[k], number[f]) for k, f in hits), np.int64).reshape(-1, 2)
    return found, names, pairs[:, 0], pairs[:, 1], np.array([ys[k] for k in sorted(ys)], np.float64)


def _ordinary(found: DataFrame, words: list[str], cfg: ToxicityModel) -> frozenset[str]:
    """Pieces of ``words`` that stand as words in ``support`` documents of label 0 at least."""
    pieces = sorted({w[a:b] for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a < len(w)})
    table = found.sparkSession.createDataFrame([(p,) for p in pieces], "word string")  # bounded by the lexicon
    counts = found.filter("y = 0").join(bounded_broadcast(table, known_rows=len(pieces)), "word").groupBy("word").count()
    return frozenset(r["word"] for r in counts.filter(F.col("count") >= cfg.support).collect())


class Lexicon:
    """Weights of words and beginnings: a ridge logistic regression, by Adam steps over all pairs at once."""

    def __init__(self, names: list[str], row: np.ndarray, feature: np.ndarray, y: np.ndarray, cfg: ToxicityModel):
        n1 = float(y.sum())
        self.bias = math.log((n1 + 1) / (len(y) - n1 + 1)) if len(y) else -3.0
        w = np.zeros(len(names))
        m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for step in range(1, 801 if len(names) and 0 < n1 < len(y) else 0):
            total = self.bias + np.bincount(row, weights=w[feature], minlength=len(y))
            error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - y
            g = np.append(np.bincount(feature, weights=error[row], minlength=len(names)) + cfg.ridge * w, error.sum()) / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, self.bias = w - move[:-1], self.bias - float(move[-1])
        used = {f: float(x) for f, x in zip(names, w) if abs(x) > 0.02}
        self.words = {f: x for f, x in used.items() if not f.endswith("*")}
        self.begins = {b: (used.get(b + "*", 0.0), used.get(b + "**", 0.0)) for b in {f.rstrip("*") for f in used if f.endswith("*")}}

    @property
    def spelling(self) -> list[str]:
        """The words that speak for label 1."""
        return sorted(f for f, x in self.words.items() if x > 0.3)

    def probability(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityModel = ToxicityModel(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> tuple[Decoder, Lexicon]:
    """Character model over all of ``docs``, lexicon from a bounded sample of those with a label 0 or 1."""
    counts = trigram_counts(docs, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = bounded_sample(rows.select("doc_id").join(bounded_broadcast(known), "doc_id"), cfg.sample)
    sample = rows.join(bounded_broadcast(chosen, known_rows=cfg.sample), "doc_id").withColumn("row", F.monotonically_increasing_id())
    sample = written(sample.select("row", "text", "y"), "labelled")
    found, *features = _features(sample, Decoder(counts, []), cfg)
    lexicon = Lexicon(*features, cfg)
    return Decoder(counts, lexicon.spelling, _ordinary(found, lexicon.spelling, cfg)), lexicon


def score(docs: DataFrame, decoder: Decoder, lexicon: Lexicon, cfg: ToxicityModel = ToxicityModel(), id_col: str = "doc_id",
          text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, score, predicted, hits (words and beginnings of the lexicon that it has), n_restored; ``with_text`` adds the restored text.

    One row per row. Null and empty texts score as texts without lexicon words; null ids stay null.
    """
    model = docs.sparkSession.sparkContext.broadcast((decoder, lexicon))  # 28^3 numbers and at most ``candidates`` words

    def run(batches):
        dec, lex = model.value
        words = sorted(lex.words)
        h = _hash_of(words)
        by = np.argsort(h)
        h, words = h[by], [words[k] for k in by]
        starts = np.unique(np.array([int.from_bytes(b.encode()[:4], "little") for b in lex.begins], np.uint32))
        lengths = sorted({len(b) for b in lex.begins})

        def begins_of(word):
            return {word[:n] for n in lengths if n < len(word) and word[:n] in lex.begins}

        for batch in batches:
            for i, j, plain, spans in _restored(batch.column(1), dec):
                found = [set() for _ in range(j - i)]
                family: dict = defaultdict(set)
                again: dict = defaultdict(list)
                if len(h) and len(plain):
                    own = plain.hashes()
                    at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                    hit = np.flatnonzero(h[at] == own)
                    for d, k in zip(plain.doc()[hit].tolist(), at[hit].tolist()):
                        found[d].add(words[k])
                if len(starts) and len(plain):
                    padded = np.concatenate([plain.data, np.zeros(4, np.uint8)])
                    four = np.lib.stride_tricks.as_strided(padded[:4].view(np.uint32), (len(plain.data),), (1,))[plain.start]
                    hit = np.flatnonzero((plain.end - plain.start > 4) & np.isin(four, starts))
                    raw, doc = plain.data.tobytes(), plain.doc()
                    for d, s, e in zip(doc[hit].tolist(), plain.start[hit].tolist(), plain.end[hit].tolist()):
                        word = raw[s:e].decode("utf-8", "replace")
                        for b in begins_of(word):
                            family[d, b].add(word)
                for d, s, e, spaced, text in spans:
                    again[d].append((s, e, text))
                    for word in (text, *_PIECE.findall(text)):
                        if word in lex.words:
                            found[d].add(word)
                        for b in begins_of(word):
                            family[d, b].add(word)
                    if spaced:  # several words may be run together
                        found[d].update(w for w in dec.spelt.values() if w in text)
                total = np.array([sum(lex.words[w] for w in sorted(f)) for f in found])
                for (d, b), kinds in sorted((k, len(x)) for k, x in family.items()):
                    total[d] += lex.begins[b][0] + lex.begins[b][1] * (kinds > 1)
                    found[d].add(b + "*")
                p = lex.probability(total)
                names = [sorted(f) for f in found]
                cols = [batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= cfg.threshold).astype(np.int32)),
                        pa.array(names, pa.list_(pa.string())), pa.array([len(again[d]) for d in range(j - i)], pa.int64())]
                if with_text:
                    out, base = [], plain.offsets
                    for d, text in enumerate(batch.column(1).slice(i, j - i).to_pylist()):
                        raw, parts, last = (text or "").encode(), [], 0
                        for s, e, word in again[d]:
                            s, e = s - base[d], e - base[d]
                            if s >= last:
                                parts += [raw[last:s], word.encode()]
                                last = e
                        out.append(b"".join([*parts, raw[last:]]).decode("utf-8", "replace"))
                    cols.append(pa.array(out))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "hits", "n_restored", *(["restored"] * with_text)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, hits array<string>, n_restored long" + ", restored string" * with_text)


def classify(docs: DataFrame, labels: DataFrame, cfg: ToxicityModel = ToxicityModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``; see ``score``. Only ``text_col`` is an input of the score."""
    decoder, lexicon = fit(docs, labels, cfg, id_col, text_col)
    return score(docs, decoder, lexicon, cfg, id_col, text_col)
