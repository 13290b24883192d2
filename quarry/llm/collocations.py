"""Phrase collocations by weighted acyclic automata.

1. Each shard (a bounded part of a batch) counts its n-grams on integer codes in sorted order and
   builds count transducers from them incrementally: arcs carry a word and the count of the
   phrase they end, states with equal arcs are shared, and each n-gram goes to the range of its
   prefix (language and first three words).
2. A range's transducers are united by summing weights; phrases below the threshold go.
3. A phrase is no more frequent than its parts, so pairs are counted of frequent words only, and
   longer phrases only where all their pairs are frequent. The frequent ones reach the tasks as a
   bit table of fixed size: a false hit costs work, none is ever missed. Before pairs and longer
   phrases are counted, their occurrences are summed by hash slot: a phrase in a slot under the
   threshold is not frequent, so only those in the other slots get into transducers.
4. A range's transducer composed with the automaton of the parts asked there gives their counts.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textbuf as T
from quarry.session import written

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_PIECE_ENDS
_IN_WORD[[0x20, 0x09]] = False
#: a range is named by the language and so many first words
PREFIX_WORDS = 3


@dataclass(frozen=True)
class Collocations:
    """``range_words``: corpus words per prefix range; ``bits``: log2 of the bit table's size; ``part``: bytes of a shard."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    no_lang: str = "und"
    range_words: int = 1_500_000
    bits: int = 27
    part: int = 1 << 24


class Transducer:
    """Acyclic automaton of keys (tuples of byte strings): each key's last arc carries its weight.

    ``states`` is a list of arc lists (symbol, weight, target); state 0 has no arcs, the last is the start.
    """

    def __init__(self, symbols: list[bytes], states: list):
        self.symbols, self.states = symbols, states

    @classmethod
    def build(cls, symbols: list[bytes], rows: Iterable, weights: Iterable[int], shared: Iterable[int]) -> Transducer:
        """From keys of symbol numbers in ascending order; a state is shared or numbered as soon as no later key can change it.

        ``shared``: how many symbols a key has in common with the one before.
        """
        register: dict[tuple, int] = {(): 0}
        path, pending, arcs = [], [], [[]]  # of the last key, but for its last symbol
        size, tail, tail_weight = 0, None, 0
        for key, weight, same in zip(rows, weights, shared):
            if size and same == size:  # goes on where the last key ended
                path.append(tail)
                pending.append(tail_weight)
                arcs.append([])
            elif size:
                arcs[-1].append((tail, tail_weight, 0))
                while len(path) > same:
                    state = tuple(arcs.pop())
                    arcs[-1].append((path.pop(), pending.pop(), register.setdefault(state, len(register))))
            size = len(key)
            for symbol in key[len(path) : -1]:
                path.append(symbol)
                pending.append(0)
                arcs.append([])
            tail, tail_weight = key[-1], weight
        if size:
            arcs[-1].append((tail, tail_weight, 0))
        while path:
            state = tuple(arcs.pop())
            arcs[-1].append((path.pop(), pending.pop(), register.setdefault(state, len(register))))
        return cls(symbols, [*register, tuple(arcs[0])])

    @classmethod
    def of(cls, counts: dict) -> Transducer:
        symbols = sorted({s for key in counts for s in key})
        number = {s: i for i, s in enumerate(symbols)}
        keys = sorted(counts)
        shared = (next((i for i, (x, y) in enumerate(zip(k, was)) if x != y), min(len(k), len(was))) for k, was in zip(keys, [(), *keys]))
        return cls.build(symbols, ([number[s] for s in k] for k in keys), (counts[k] for k in keys), shared)

    def pack(self) -> bytes:
        arcs = np.fromiter(chain.from_iterable(chain.from_iterable(self.states)), np.int64).reshape(-1, 3)
        used = np.unique(arcs[:, 0])
        names = [self.symbols[i] for i in used]
        columns = [np.fromiter(map(len, names), np.int64, len(names)), np.fromiter(map(len, self.states), np.int64, len(self.states)),
                   np.searchsorted(used, arcs[:, 0]), arcs[:, 1], arcs[:, 2]]
        small = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
        head = struct.pack("<5Q5c", *map(len, small), *(c.dtype.char.encode() for c in small))
        return zlib.compress(head + b"".join(c.tobytes() for c in small) + b"".join(names), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Transducer:
        raw = zlib.decompress(packed)
        fields, at, columns = struct.unpack_from("<5Q5c", raw), struct.calcsize("<5Q5c"), []
        for n, kind in zip(fields[:5], fields[5:]):
            columns.append(np.frombuffer(raw, np.dtype(kind.decode()), n, at).tolist())
            at += n * np.dtype(kind.decode()).itemsize
        symbols, states = [], []
        for n in columns[0]:
            symbols.append(raw[at : at + n])
            at += n
        arcs, i = list(zip(*columns[2:])), 0
        for n in columns[1]:
            states.append(arcs[i : i + n])
            i += n
        return cls(symbols, states)

    def items(self) -> Iterator[tuple[tuple, int]]:
        """(key, weight), keys ascending."""
        stack = [((), self.states[-1])]
        while stack:
            prefix, arcs = stack.pop()
            for symbol, weight, target in reversed(arcs):
                key = (*prefix, self.symbols[symbol])
                if self.states[target]:
                    stack.append((key, self.states[target]))
                if weight:
                    yield key, weight

    def compose(self, asked: Transducer) -> Iterator[tuple[tuple, int]]:
        """(key, this weight) of the keys that ``asked`` also has; both are walked together."""
        number = {s: i for i, s in enumerate(self.symbols)}
        to = [number.get(s) for s in asked.symbols]
        stack = [((), asked.states[-1], self.states[-1])]
        while stack:
            prefix, ours, theirs = stack.pop()
            found = {symbol: (weight, target) for symbol, weight, target in theirs}
            for symbol, wanted, target in ours:
                if to[symbol] in found:
                    weight, other = found[to[symbol]]
                    key = (*prefix, asked.symbols[symbol])
                    if wanted and weight:
                        yield key, weight
                    stack.append((key, asked.states[target], self.states[other]))


def _hashes(strings) -> np.ndarray:
    """A hash per byte string of an Arrow array or list."""
    array = pa.array(strings, pa.large_binary()) if isinstance(strings, list) else strings
    if not len(array):
        return np.zeros(0, np.uint64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64, len(array) + 1, array.offset * 8)
    w = T.Words.__new__(T.Words)
    w.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    w.start, w.end = offsets[:-1], offsets[1:]
    return w.hashes()


def _ascending(strings) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings in ascending order, and the rank of each."""
    order = pc.sort_indices(strings)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return strings.take(order).to_pylist(), rank


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash per row of hashes."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = T.mix(out * np.uint64(3) + c)
    return out


class _Shard:
    """Words of a part of a batch as numbers: ``word`` and ``lang`` of each word."""

    def __init__(self, lang, text):
        data, offsets = T.utf8(text)
        data = T.LOWER[data]
        w = T.Words(data, offsets, _IN_WORD)
        ends = np.zeros(len(w) + 1, np.int64)
        np.cumsum(w.end - w.start, out=ends[1:])
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(data[_IN_WORD[data]])]).dictionary_encode()
        self.spelled, self.word = spelled.dictionary, spelled.indices.to_numpy().astype(np.int64)
        coded = lang.cast(pa.large_string()).cast(pa.large_binary()).dictionary_encode()
        self.langs, by_lang = _ascending(coded.dictionary)
        doc = w.doc()
        self.lang = by_lang[coded.indices.to_numpy()][doc]
        piece = np.searchsorted(np.flatnonzero(_PIECE_ENDS[data]), w.start)
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])  # the next word follows within the piece
        self.word_hash, self.lang_hash = _hashes(self.spelled), _hashes(self.langs)

    def keep(self, places: dict[int, np.ndarray]) -> list[bytes]:
        """The words of the n-grams at these places, ascending; from now on ``word`` numbers them (-1: any other)."""
        used = np.zeros(len(self.spelled), bool)
        for n, at in places.items():
            for i in range(n):
                used[self.word[at + i]] = True
        old = np.flatnonzero(used)
        words, rank = _ascending(self.spelled.take(pa.array(old)))
        new = np.full(len(used), -1, np.int64)
        new[old] = rank
        hashes = np.zeros(len(old), np.uint64)
        hashes[rank] = self.word_hash[old]
        self.spelled = pa.array(words, pa.large_binary())
        self.word, self.word_hash, self.n_words = new[self.word], hashes, max(1, len(old))
        return words

    def grams(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams at the given places, ascending, as columns (language, words), and their counts."""
        code, known, columns = self.lang[at], max(1, len(self.langs)), None
        for i in range(n):
            if known * self.n_words >= 1 << 62:  # else one number holds language and words
                distinct, code = np.unique(code, return_inverse=True)
                columns, known = self._apart(distinct, columns, i), len(distinct)
            code, known = code * self.n_words + self.word[at + i], known * self.n_words
        distinct, count = np.unique(code, return_counts=True)
        return np.stack(self._apart(distinct, columns, n)), count

    def _apart(self, codes: np.ndarray, columns: list | None, n: int) -> list[np.ndarray]:
        """Language and n words of each code, whose front is a row of ``columns`` where that is given."""
        tail = []
        for _ in range(n - (len(columns) - 1 if columns else 0)):
            codes, last = np.divmod(codes, self.n_words)
            tail.append(last)
        return ([c[codes] for c in columns] if columns else [codes]) + tail[::-1]

    def slots(self, n: int, at: np.ndarray, bits: int) -> np.ndarray:
        """Bit numbers of the n-grams at the places."""
        return _mixed([self.lang_hash[self.lang[at]], *(self.word_hash[self.word[at + i]] for i in range(n))]) >> np.uint64(64 - bits)

    def hits(self, n: int, at: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
        """Which of the places hold an n-gram whose bit is set."""
        slot = self.slots(n, at, bits)
        return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def pairs(self, tables: list[np.ndarray], bits: int) -> np.ndarray:
        """Places of the pairs of frequent words (first table) that are set in the second, if there is one."""
        every = np.arange(len(self.word))
        good = self.hits(1, every, tables[0], bits) if len(every) else np.zeros(0, bool)
        pair = np.flatnonzero(self.joined & good[1:] & good[:-1])
        return pair[self.hits(2, pair, tables[1], bits)] if tables[1:] else pair

    def longer(self, pair: np.ndarray, longest: int) -> dict[int, np.ndarray]:
        """Places of the longer n-grams of which every pair is among the given ones."""
        run = np.zeros(max(len(self.word), 1), bool)
        run[pair] = True
        out, live = {}, run
        for n in range(3, longest + 1):
            live = live[: len(live) - 1] & run[n - 2 :]
            out[n] = np.flatnonzero(live)
        return out


def _transducers(shard: _Shard, places: dict[int, np.ndarray], ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, packed transducer) of a shard's n-grams."""
    width = max(*places, PREFIX_WORDS) + 1
    symbols = shard.langs + shard.keep(places)
    keys, counts = [], []
    for n, at in places.items():
        columns, count = shard.grams(n, at)
        keys.append(np.concatenate([columns, np.full((width - n - 1, len(count)), -1)]))
        counts.append(count)
    keys, counts = np.concatenate(keys, axis=1), np.concatenate(counts)
    if not len(counts):
        return
    first = [shard.lang_hash[keys[0]], *(np.where(c >= 0, shard.word_hash[c], np.uint64(0)) for c in keys[1 : PREFIX_WORDS + 1])]
    home = (_mixed(first) % np.uint64(ranges)).astype(np.int64)
    # one length of n-grams is in order already
    order = np.lexsort([*keys[::-1], home]) if len(places) > 1 else np.argsort(home, kind="stable")
    keys, counts, home = keys[:, order], counts[order], home[order]
    keys[1:][keys[1:] >= 0] += len(shard.langs)  # a language is the first symbol of its phrases
    size = (keys >= 0).sum(axis=0)
    differ = np.concatenate([keys[:, 1:] != keys[:, :-1], np.ones((1, len(counts) - 1), bool)])
    shared = np.r_[0, np.minimum(differ.argmax(axis=0), np.minimum(size[1:], size[:-1]))]
    ends = np.flatnonzero(np.r_[home[1:] != home[:-1], True]) + 1
    for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        rows = keys[:, i:j].T.tolist()
        if size[i:j].min() < width:
            rows = [r[:n] for r, n in zip(rows, size[i:j].tolist())]
        yield int(home[i]), Transducer.build(symbols, rows, counts[i:j].tolist(), [0, *shared[i + 1 : j].tolist()]).pack()


def _sketches(slots: np.ndarray, bits: int, parts: int, least: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed counts) of a shard's n-grams by slot, for equal parts of the slots; counts stop at ``least``.

    Slots stand as gaps in bytes: 255 goes on to the next byte, anything less ends a gap.
    """
    slots, counts = np.unique(slots, return_counts=True)
    counts = np.minimum(counts, least).astype(np.min_scalar_type(least))
    size = (1 << bits) // parts
    ends = np.searchsorted(slots, np.arange(parts + 1) * size)
    for part, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if i < j:
            gaps = np.diff(slots[i:j].astype(np.int64), prepend=part * size)
            at = np.cumsum(gaps // 255 + 1) - 1
            packed = np.full(at[-1] + 1, 255, np.uint8)
            packed[at] = gaps % 255
            yield part, zlib.compress(struct.pack("<Q", len(packed)) + packed.tobytes() + counts[i:j].tobytes(), 1)


def _slot_counts(packed: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots, from the part's first on, and counts of a sketch."""
    raw = zlib.decompress(packed)
    gaps = np.frombuffer(raw, np.uint8, struct.unpack_from("<Q", raw)[0], 8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255], np.frombuffer(raw, np.min_scalar_type(least), offset=8 + len(gaps))


def _home(keys: list[tuple], ranges: int) -> np.ndarray:
    """The range of each key, as ``_transducers`` deals them."""
    if not keys:
        return np.zeros(0, np.int64)
    columns = []
    for i in range(PREFIX_WORDS + 1):
        has = np.fromiter((len(k) > i for k in keys), bool, len(keys))
        columns.append(np.where(has, _hashes([k[i] if len(k) > i else b"" for k in keys]), np.uint64(0)))
    return (_mixed(columns) % np.uint64(ranges)).astype(np.int64)


def _slots(keys: list[tuple], bits: int) -> np.ndarray:
    """Bit numbers of words and pairs; longer phrases have none and read as 0."""
    out = np.zeros(len(keys), np.int64)
    for n in (1, 2):
        at = [i for i, k in enumerate(keys) if len(k) == n + 1]
        if at:
            out[at] = (_mixed([_hashes([keys[i][j] for i in at]) for j in range(n + 1)]) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def shard_transducers(docs: DataFrame, tables: list, ranges: int, parts: int, cfg: Collocations) -> DataFrame:
    """(range, packed): what a shard counts, given the tables so far; sketches have ranges -1 - part.

    Without tables, words, and all words of a language as the phrase of none; with frequent words, a
    sketch of their pairs; with that too, the pairs it leaves and a sketch of the longer phrases of
    them; with frequent words, frequent pairs and that sketch, the longer phrases it leaves.
    """
    def count(shard: _Shard, found: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        if not found:
            every = [((s,), int(n)) for s, n in zip(shard.langs, np.bincount(shard.lang, minlength=len(shard.langs))) if n]
            yield from zip(_home([k for k, _ in every], ranges).tolist(), (Transducer.of({k: n}).pack() for k, n in every))
            yield from _transducers(shard, {1: np.arange(len(shard.word))}, ranges)
            return
        pair = shard.pairs(found[:2], cfg.bits)
        if len(found) < 3:
            sketched = {2: pair} if len(found) == 1 else shard.longer(pair, cfg.longest)
            slots = [shard.slots(n, at, cfg.bits).astype(np.uint32) for n, at in sketched.items()]
            yield from ((-1 - part, packed) for part, packed in _sketches(np.concatenate(slots), cfg.bits, parts, cfg.least))
            if len(found) == 2:
                yield from _transducers(shard, {2: pair}, ranges)
        else:
            left = {n: at[shard.hits(n, at, found[2], cfg.bits)] for n, at in shard.longer(pair, cfg.longest).items()}
            yield from _transducers(shard, left, ranges)

    def run(batches):
        found = [t.value for t in tables]
        for batch in batches:
            _, offsets = T.utf8(batch.column(1))
            for i, j in T.slices(offsets, cfg.part):
                shard = _Shard(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))
                packed = list(count(shard, found))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())], names=["range", "packed"])

    return docs.mapInArrow(run, "range int, packed binary")


def unite(shards: DataFrame, parts: int, cfg: Collocations) -> DataFrame:
    """(range, packed): the sum of each range's transducers, without phrases under ``least``; of sketches, a bit per slot that reaches it.

    A range has about ``range_words`` words of the corpus at most, so its distinct keys are bounded;
    so are a part's slots, and its sketches are those of a bounded number of shards' worth of slots.
    """
    def run(table: pa.Table) -> pa.Table:
        home = table.column("range")[0].as_py()
        if home < 0:
            sums = np.zeros((1 << cfg.bits) // parts, np.uint32)
            for packed in table.column("packed"):
                slots, counts = _slot_counts(packed.as_py(), cfg.least)
                sums[slots] += counts
            out = [zlib.compress(np.packbits(sums >= cfg.least, bitorder="little").tobytes(), 1)]
        else:
            total: dict = defaultdict(int)
            for packed in table.column("packed"):
                for key, weight in Transducer.unpack(packed.as_py()).items():
                    total[key] += weight
            kept = {k: w for k, w in total.items() if w >= cfg.least}
            out = [Transducer.of(kept).pack()] if kept else []
        return pa.table({"range": pa.array([home] * len(out), pa.int32()), "packed": pa.array(out, pa.binary())})

    return shards.groupBy("range").applyInArrow(run, "range int, packed binary")


def phrases(united: DataFrame, bits: int) -> DataFrame:
    """A row per phrase: lang, phrase (space-joined), words, f, slot."""
    def run(batches):
        for batch in batches:
            for packed in batch.column("packed"):
                rows = list(Transducer.unpack(packed.as_py()).items())
                keys = [k for k, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0].decode() for k in keys], pa.string()), pa.array([b" ".join(k[1:]).decode() for k in keys], pa.string()),
                     pa.array([len(k) - 1 for k in keys], pa.int32()), pa.array([w for _, w in rows], pa.int64()), pa.array(_slots(keys, bits))],
                    names=["lang", "phrase", "words", "f", "slot"])

    return united.mapInArrow(run, "lang string, phrase string, words int, f long, slot long")


def _bit_table(found: DataFrame, bits: int):
    """Broadcast table of 2^bits bits (16 MB at 27), one per slot of ``found``."""
    spark = found.sparkSession
    cells = found.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[cells["cell"].to_numpy(np.int64)] = cells["set"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _sketch_table(united: DataFrame, parts: int, bits: int):
    """Broadcast table of 2^bits bits, set in the slots that the summed sketches leave."""
    table, cells = np.zeros(1 << (bits - 6), np.uint64), (1 << (bits - 6)) // parts
    for home, packed in united.filter("range < 0").collect():
        at = (-1 - home) * cells
        table[at : at + cells] = np.frombuffer(zlib.decompress(packed), np.uint64)
    return united.sparkSession.sparkContext.broadcast(table)


def _part_counts(parts: DataFrame, united: DataFrame, ranges: int) -> DataFrame:
    """lang, part, f of the parts (lang, part) asked for, distinct."""
    def dealt(batches):
        for batch in batches:
            keys = [(s.encode(), *p.encode().split(b" ")) for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            group = pa.array([min(len(k) - 1, PREFIX_WORDS) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([group, pa.array(_home(keys, ranges), pa.int32()), *batch.columns], names=["family", "range", "lang", "part"])

    def look_up(asked: pa.Table, stored: pa.Table) -> pa.Table:
        keys = {(s.encode(), *p.encode().split(b" ")): 1 for s, p in zip(asked.column("lang").to_pylist(), asked.column("part").to_pylist())}
        wanted, out = Transducer.of(keys), []
        for packed in stored.column("packed"):
            out += Transducer.unpack(packed.as_py()).compose(wanted) if keys else []
        return pa.table({"lang": pa.array([k[0].decode() for k, _ in out], pa.string()), "part": pa.array([b" ".join(k[1:]).decode() for k, _ in out], pa.string()),
                         "f": pa.array([f for _, f in out], pa.int64())})

    asked = parts.mapInArrow(dealt, "family int, range int, lang string, part string").groupBy("family", "range")
    return asked.cogroup(united.groupBy("family", "range")).applyInArrow(look_up, "lang string, part string, f long")


def _score(a, n, left, right):
    """floor(1000 * a * n / (left * right)) on decimals of 38 digits: counts may have 15 digits, n 19."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = wide(a * 1000, 18) * wide(n, 19)
    return F.expr("top div bottom"), top, wide(left, 18) * wide(right, 19)


def collocations(docs: DataFrame, cfg: Collocations = Collocations()) -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``docs``: lang, text; A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces
    and those at spaces and tabs into words. Null text is empty; null lang counts as ``no_lang``,
    together with documents that are so marked. Candidates have 2 to ``longest`` words and occur
    ``least`` times (overlaps count). A candidate's score is that of its lowest cut, ties to the
    shortest first part; candidates that stand in a longer one of equal count go. Order: score, a
    descending, phrase by bytes. Repeated rows count as often as they stand; other columns are not
    read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(cfg.no_lang)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffles, length // (6 * cfg.range_words))

    # slots in parts of 64 MB of text or less, so that a part's sketches stay small
    parts = min(1 << (max(32, shuffles, length >> 26) - 1).bit_length(), 1 << (cfg.bits - 6))

    def counted(*tables) -> DataFrame:
        return written(unite(shard_transducers(rows, list(tables), ranges, parts, cfg), parts, cfg), "united")

    def listed(united: DataFrame) -> DataFrame:
        return written(phrases(united.filter("range >= 0"), cfg.bits), "phrases")

    ones = counted()
    words = listed(ones)
    # a language under ``least`` words has no candidates
    totals = words.filter("words = 0").select("lang", F.col("f").alias("n"))
    frequent = _bit_table(words.filter("words = 1"), cfg.bits)
    twos = counted(frequent, _sketch_table(counted(frequent), parts, cfg.bits))
    pairs = listed(twos)
    more = counted(frequent, _bit_table(pairs, cfg.bits), _sketch_table(twos, parts, cfg.bits))
    united = reduce(DataFrame.unionByName, (u.filter("range >= 0").withColumn("family", F.lit(i)) for i, u in enumerate((ones, twos, more), 1)))
    candidates = pairs.unionByName(listed(more)).select("lang", "phrase", "words", F.col("f").alias("a"))

    split = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = written(split.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
                                F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")), "cuts")
    parts = cuts.select("lang", F.col("first").alias("part")).unionByName(cuts.select("lang", F.col("rest").alias("part"))).distinct()
    counts = written(_part_counts(parts, united, ranges), "parts")
    cut = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # a phrase inside a longer one of equal count stands, with equal count, inside one of one word more
    inside = cut.filter("k = words - 1 and l = a").select("lang", F.col("first").alias("phrase")).unionByName(
        cut.filter("k = 1 and words > 2 and r = a").select("lang", F.col("rest").alias("phrase"))).distinct()
    quotient, top, bottom = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    scored = cut.join(totals, "lang").withColumn("top", top).withColumn("bottom", bottom).withColumn("score", quotient)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = lowest.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
