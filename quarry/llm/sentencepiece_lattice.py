"""SentencePiece encoding and decoding as relations.

A first pass over the texts notes the distinct words of each chunk of text. The corpus's distinct
words are exploded into their substrings of bounded length, equi-joined to the piece table, and the
edges grouped by word again; a fold over each word's lattice gives its pieces. The codes go back to
the chunks as a written table, under the word's number in its chunk (by first appearance), and a
second pass, which meets the words in the same order, replaces them by their ids. Texts are never
shuffled, and a task holds the words of one chunk at a time.

Two folds, by the kind of model:

* unigram: Viterbi, the best-scoring path through the lattice.
* bpe: scores are merge ranks, not log-probabilities, and the best-scoring path is another
  segmentation than the model's; the fold replays the merges over the same lattice, best rank
  first, leftmost among equals, and so gives the library's ids. Edges are taken in this order in one
  pass, with the word's cuts as the bits of a long. Should a merge open up an earlier edge (or the word
  have over ``SHORT`` characters), the best merge is looked up anew after each one.

The folds hold a lattice as one row. Words of over ``LONGEST`` characters are few and are folded where
they stand in the second pass, by the same rules in time about linear in their length.

A character without a piece is spelt in byte pieces. Spaces become the mark U+2581, and one is put
in front of a text that isn't empty.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.folders import open_folder
from quarry.session import scratch_path, written

MARK = "▁"
#: A word of more characters is not put into the relations but folded by ``_LongWords``.
LONGEST = 512
#: The cuts of a word of so many characters stand in the bits of a long.
SHORT = 61
#: Ids below twice this are handed over in 16 bits, less this.
NARROW = 1 << 15
HASHED = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
MOST_HASHED_WORDS = 200_000


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: (piece, id, score) rows, the id of byte 0 (None: no byte pieces), and the kind of model."""

    rows: tuple
    byte_base: int | None
    unknown: int
    kind: str

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @property
    def narrow(self) -> bool:
        last = max((i for _, i, _ in self.rows), default=0)
        return max(last, self.unknown, (self.byte_base or 0) + 255) < 2 * NARROW

    def word_pattern(self) -> str:
        """Words never cut a piece: characters that stand side by side in some piece are of one class, and a
        word is marks followed by a run of one class, or a character that no longer piece has. Marks are
        still spaces here, so that plain texts stay strings of one byte a character."""
        up: dict[str, str] = {}

        def root(c):
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for p, _, _ in self.rows:
            own = p.replace(MARK, " ").lstrip(" ")
            for a, b in zip(own, own[1:]):
                up[root(max(a, b))] = root(min(a, b))
            if len(p) > 1 and own:
                root(own[0])
        classes: dict[str, list[int]] = {}
        for c in sorted(up):
            classes.setdefault(root(c), []).append(ord(c))
        runs = []
        for members in classes.values():
            spans: list[list[int]] = []
            for c in members:
                if spans and c == spans[-1][1] + 1:
                    spans[-1][1] = c
                else:
                    spans.append([c, c])
            runs.append("[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b))) * (b > a) for a, b in spans) + "]" + "+" * (len(members) > 1))
        runs.sort(key=len, reverse=True)
        after = "|".join([*runs, "[^ ]"])
        return f" *(?:{after})| +"


def load_pieces(path: str, kind: str = "bpe") -> Pieces:
    """Read a SentencePiece model file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = tuple((m.id_to_piece(i), i, float(m.get_score(i))) for i in range(m.get_piece_size())
                  if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    bytes_ = [i for i in range(m.get_piece_size()) if m.is_byte(i)]
    return Pieces(plain, bytes_[0] if len(bytes_) == 256 else None, m.unk_id(), kind)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id, score, rank (0 for the best score), late (1: two parts make it up of which one may be merged after the whole's turn)."""
    ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    at = {p: ranks[s] for p, _, s in pieces.rows}

    def late(p: str) -> int:
        parts = ((p[:m], p[m:]) for m in range(1, len(p)))
        return int(any(all(len(x) == 1 or x in at for x in two) and any(len(x) > 1 and at[x] >= at[p] for x in two) for two in parts))

    return spark.createDataFrame([(p, i, s, ranks[s], late(p)) for p, i, s in pieces.rows], "piece string, id int, score double, rank int, late int")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: expressions inside a lambda are otherwise repeated where they are used."""
    return F.transform(F.array(value), body)[0]


def _spelt(char: Column, pieces: Pieces) -> Column:
    """Ids of a character without a piece; a space stands for the mark."""
    if pieces.byte_base is None:
        return F.array(F.lit(pieces.unknown))
    return _let(F.hex(F.encode(F.translate(char, " ", MARK), "UTF-8")), lambda code: F.transform(
        F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(code.substr(i, F.lit(2)), 16, 10).cast("int") + pieces.byte_base))


def _spot(start: Column, end: Column) -> Column:
    return start * 1024 + end


def _ids(word: Column, cuts: Column, id_at, pieces: Pieces) -> Column:
    """Ids of the pieces between neighbouring cuts."""
    one = lambda a, b: _let(id_at(_spot(a, b)), lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(_spelt(word.substr(a + 1, b - a), pieces)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: one(cuts[i - 1], cuts[i])))


def _edge(rank: Column, late: Column, start: Column, end: Column, id_: Column) -> Column:
    """rank, late, start, end, id as one long, which sorts by rank and start: 21, 1, 10, 10 and 21 bits."""
    rank, late, start, end = (F.shiftleft(c.cast("long"), n) for c, n in ((rank, 42), (late, 41), (start, 31), (end, 21)))
    return rank.bitwiseOR(late).bitwiseOR(start).bitwiseOR(end).bitwiseOR(id_.cast("long"))


def _bits(edge: Column, shift: int, n: int) -> Column:
    return F.shiftright(edge, shift).bitwiseAND((1 << n) - 1)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _ends_are_cuts(cuts: Column, x: Column) -> Column:
    return cuts.bitwiseAND(x["ends"]) == x["ends"]


def _joins_two(cuts: Column, x: Column) -> Column:
    """Whether the edge spans just two of the parts between the cuts."""
    return _ends_are_cuts(cuts, x) & (F.bit_count(cuts.bitwiseAND(x["inside"])) == 1)


def _one_pass(word: Column, spans: Column) -> Column:
    """Cuts (bits) after the merges; 0 where a merge opens up an edge whose turn is over."""
    late = F.filter(spans, lambda x: _bits(x["edge"], 41, 1) == 1)

    def fold(late: Column) -> Column:
        def step(cuts, x):
            after = cuts.bitwiseAND(F.bitwise_not(x["inside"]))
            merged = _let(after, lambda now: F.when(F.exists(late, lambda y: (y["edge"] < x["edge"]) & _joins_two(now, y)), F.lit(0).cast("long")).otherwise(now))
            return F.when(_joins_two(cuts, x), merged).otherwise(cuts)

        return F.aggregate(F.filter(spans, lambda x: x["inside"] != 0), _bit(F.length(word) + 1) - 1, step)

    return _let(late, fold)


def _merged(word: Column, edges: Column, pieces: Pieces) -> Column:
    """Byte-pair merges. ``edges``: array of longs made by ``_edge``."""

    def spans_of(ordered: Column) -> Column:
        def span(x):
            low, high = _bit(_bits(x, 31, 10).cast("int")), _bit(_bits(x, 21, 10).cast("int"))
            return F.struct(x.alias("edge"), low.bitwiseOR(high).alias("ends"), (high - low - low).alias("inside"))

        return F.transform(ordered, span)

    def by_bits(spans: Column) -> Column:
        def ids(cuts: Column) -> Column:
            used = F.filter(spans, lambda x: _ends_are_cuts(cuts, x) & (cuts.bitwiseAND(x["inside"]) == 0))
            in_text_order = lambda u: F.transform(F.sort_array(F.transform(u, lambda x: _bits(x["edge"], 0, 41))), lambda x: _bits(x, 0, 21).cast("int"))
            # fewer edges than parts: some part is a character to spell; no cuts: the pass did not hold
            return _let(used, lambda u: F.when((cuts != 0) & (F.size(u) == F.bit_count(cuts) - 1), in_text_order(u)))

        return _let(_one_pass(word, spans), ids)

    short = F.when(F.length(word) <= SHORT, _let(spans_of(F.sort_array(edges)), by_bits))
    return F.coalesce(short, _merged_step_by_step(word, edges, pieces))


def _merged_step_by_step(word: Column, edges: Column, pieces: Pieces) -> Column:
    """``_merged`` for any word: the best merge of all neighbours is looked up after each merge."""
    lattice = F.map_from_arrays(F.transform(edges, lambda x: _bits(x, 21, 20).cast("int")), edges)

    def cuts_of(at: Column) -> Column:
        def step(acc, _):
            cuts = acc["cuts"]
            ranked = F.transform(F.sequence(F.lit(1), F.size(cuts) - 2), lambda i: F.shiftright(
                F.try_element_at(at, _spot(cuts[i - 1], cuts[i + 1])), 42) * 1024 + i)  # nulls are not ranked
            stay = F.struct(cuts.alias("cuts"), F.lit(True).alias("done"))
            go = lambda i: F.struct(F.concat(F.slice(cuts, 1, i), F.slice(cuts, i + 2, F.size(cuts))).alias("cuts"), F.lit(False).alias("done"))
            merge = _let(F.array_min(ranked), lambda best: F.when(best.isNull(), stay).otherwise(go(best.bitwiseAND(1023).cast("int"))))
            return F.when(acc["done"] | (F.size(cuts) < 3), stay).otherwise(merge)

        start = F.struct(F.sequence(F.lit(0), F.length(word)).alias("cuts"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda acc: acc["cuts"])

    id_at = lambda at: lambda spot: _bits(F.try_element_at(at, spot), 0, 21).cast("int")
    return _let(lattice, lambda at: _let(cuts_of(at), lambda cuts: _ids(word, cuts, id_at(at), pieces)))


def _viterbi(word: Column, edges: Column, pieces: Pieces) -> Column:
    """Best path. ``edges``: array of (start, end, score, id); the state holds the best way to each position so far."""
    worst = min((s for _, _, s in pieces.rows), default=0.0) - 10.0
    kind = "array<struct<score:double,cuts:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts"))).cast(kind)

    def step(best, e):
        way = lambda s, score: _let(best[s], lambda b: F.struct((b["score"] + score).alias("score"), F.concat(b["cuts"], F.array(e)).alias("cuts")))
        ways = F.transform(F.filter(edges, lambda x: x["end"] == e), lambda x: way(x["start"], x["score"]))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(way(e - 1, F.lit(worst)))))).cast(kind))

    cuts = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step), -1)["cuts"]
    lattice = F.map_from_arrays(F.transform(edges, lambda x: _spot(x["start"], x["end"])), F.transform(edges, lambda x: x["id"]))
    return _let(lattice, lambda at: _let(cuts, lambda c: _ids(word, c, lambda spot: F.try_element_at(at, spot), pieces)))


def encode_words(words: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """Distinct (*keys, word), words of 1 to ``LONGEST`` characters -> (*keys, word, ids).

    Words without any piece are left out: all their characters are spelt.
    """
    table = piece_table(words.sparkSession, pieces)  # bounded by the vocabulary
    n = F.length("word")
    starts = words.select(*keys, "word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    subs = starts.select(*keys, "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))).alias("len"))
    subs = subs.withColumn("piece", F.col("word").substr(F.col("start") + 1, F.col("len"))).withColumn("end", F.col("start") + F.col("len"))
    edges = subs.join(F.broadcast(table), "piece")
    if pieces.kind == "bpe":
        if max((i for _, i, _ in pieces.rows), default=0) >= 1 << 21:
            raise ValueError("ids of byte-pair models have 21 bits")
        edge = _edge(*(F.col(c) for c in ("rank", "late", "start", "end", "id")))
        fold = _merged
    else:
        edge = F.struct("start", "end", "score", "id")
        fold = _viterbi
    # the hash comes first in the sort key, so that sorting compares numbers
    grouped = edges.select(F.xxhash64("word").alias("h"), *keys, "word", edge.alias("edge")).groupBy("h", *keys, "word").agg(F.collect_list("edge").alias("edges"))
    return grouped.select(*keys, "word", fold(F.col("word"), F.col("edges"), pieces).alias("ids"))


def _split_numbers(rows: DataFrame) -> dict[str, int]:
    """Splits by number: small numbers take little room beside every word that is shuffled. One name per file split, no column is read."""
    return {name: i for i, name in enumerate(sorted(r.split for r in rows.select("split").distinct().collect()))}


def _chunks(batches, chunk_bytes: int, numbers: dict[str, int]):
    """(chunk, doc_ids, texts) runs of a split's rows, in order; a chunk ends after ``chunk_bytes`` of text.

    Batches are (doc_id, text, split). Splits are read in the same order each time, so both passes see the same chunks.
    """
    def number(split: str, n: int) -> int:
        if split not in numbers:
            raise RuntimeError("the splits are not those of the first pass")
        chunk = n * len(numbers) + numbers[split]
        if chunk >= 1 << 32:
            raise ValueError("chunks have 32 bits")
        return chunk

    n, size, held = 0, 0, []
    for batch in batches:
        ids, split = batch.column(0), None
        texts = batch.column(1).to_pylist()
        lo = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > chunk_bytes:
                held.append((ids.slice(lo, k + 1 - lo), texts[lo : k + 1]))
                split = batch.column(2)[k].as_py()
                yield number(split, n), held
                n, size, held, lo = n + 1, 0, [], k + 1
        if lo < len(texts):
            held.append((ids.slice(lo), texts[lo:]))
        if len(texts):
            last = batch.column(2)[len(texts) - 1].as_py()
    if held:
        yield number(last, n), held


def _words(text: str, cut: re.Pattern):
    """Words of a text, mark in front; marks are spaces."""
    return cut.findall(" " + text.replace(MARK, " ")) if text else []


def word_codes(rows: DataFrame, pieces: Pieces, path: str, chunk_bytes: int, folders: int, numbers: dict[str, int]) -> None:
    """Write folder, chunk, at, ids (null: spelt) for the distinct words of every chunk of ``rows`` (doc_id, text, split); at: the word's number in its chunk.

    Both are shuffled as one long, the spot, with the chunk in its lower half.
    """
    cut = re.compile(pieces.word_pattern(), re.DOTALL)

    def distinct(batches):
        for chunk, held in _chunks(batches, chunk_bytes, numbers):
            seen = dict.fromkeys(chain.from_iterable(_words(text, cut) for _, texts in held for text in texts))
            words = [w for w in seen if len(w) <= LONGEST]
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int64) << 32 | chunk), pa.array(part, pa.string())], names=["spot", "word"])

    spark = rows.sparkSession
    found = rows.mapInArrow(distinct, "spot long, word string").filter("word is not null").repartition("word")
    # the largest spot makes this side read the columns of the other, so that both share one exchange (as does the filter) and one pass over the texts
    words = found.groupBy("word").agg(F.max("spot").alias("last")).filter("last >= 0").select("word")
    spaced = replace(pieces, rows=tuple((p.replace(MARK, " "), i, score) for p, i, score in pieces.rows))
    coded = encode_words(words, [], spaced)
    ids = F.transform("ids", lambda i: (i - NARROW).cast("short")) if pieces.narrow else F.col("ids")
    coded = coded.select("word", ids.alias("ids"))
    chunk = F.col("spot").bitwiseAND(0xFFFFFFFF)
    folder = F.pmod(chunk, F.lit(folders)).cast("int")
    # coded words are looked up in a hash table per partition: the words of the chunks, ten times as many, need no sorting
    matched = found.join(coded.hint("shuffle_hash"), "word", "left").select("spot", "ids").repartition(folder, chunk)
    dealt = matched.select(folder.alias("folder"), chunk.alias("chunk"), F.shiftright("spot", 32).cast("int").alias("at"), "ids").sortWithinPartitions("folder", "chunk", "at")
    # lattices of up to so many words of a task are gathered in a hash table; beyond that Spark sorts
    was = spark.conf.get(HASHED)
    spark.conf.set(HASHED, str(MOST_HASHED_WORDS))
    try:
        dealt.write.partitionBy("folder").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(HASHED, was)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, round_trip: one row per row of ``docs``, whole texts.

    round_trip: decoding gives the text back, its marks U+2581 read as spaces. Null and empty texts
    have no pieces. Rows without id or that repeat are encoded like any other. Other columns are
    not read. An empty table gives an empty table. ``docs`` that aren't read from files are written
    first, as chunks are parts of file splits.
    """
    spark = docs.sparkSession
    split = F.concat_ws("@", F.input_file_name(), F.input_file_block_start())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = rows.select(F.input_file_name().alias("f")).limit(1).collect()
    if one and not one[0]["f"]:
        rows = written(rows, "texts")
    rows = rows.select("doc_id", "text", split.alias("split"))
    path = scratch_path(spark, "words")
    folders = min(max(rows.rdd.getNumPartitions(), 1), 4096)
    numbers = _split_numbers(rows)
    word_codes(rows, pieces, path, chunk_bytes, folders, numbers)
    decoder, long, cut = _Decoder(pieces), _LongWords(pieces), re.compile(pieces.word_pattern(), re.DOTALL)

    def apply(batches):
        for chunk, held in _chunks(batches, chunk_bytes, numbers):
            some = any(text for _, texts in held for text in texts)  # else there are no words and perhaps no folder
            known = _Known(_codes(f"{path}/folder={chunk % folders}", chunk, NARROW if pieces.narrow else 0) if some else [], decoder, long)
            for ids, texts in held:
                coded = [b"".join([known[w] for w in _words(text, cut)]) for text in texts]
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                good = [back == text.replace(MARK, " ").encode() for back, text in zip(decoder.texts(flat, ends), texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                chars = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, chars, pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(good, pa.bool_())],
                                                 names=["doc_id", "n_chars", "n_pieces", "ids", "round_trip"])
            known.close()

    return rows.mapInArrow(apply, "doc_id long, n_chars long, n_pieces long, ids array<int>, round_trip boolean")


def _codes(path: str, chunk: int, added: int) -> list[bytes]:
    """32-bit ids of one chunk's words in the order of their numbers (empty: spelt); files are sorted by chunk, so others' row groups are skipped."""
    files, root = open_folder(path)
    if files.get_file_info(root).type == pafs.FileType.NotFound:  # all words are long
        return []
    table = pads.dataset(root, filesystem=files, format="parquet").to_table(columns=["at", "ids"], filter=pads.field("chunk") == chunk)
    out: list = [None] * table.num_rows
    for batch in table.to_batches():
        ids = batch.column("ids")
        raw, ends = (np.asarray(ids.values, np.int32) + np.int32(added)).tobytes(), (4 * np.asarray(ids.offsets, np.int64)).tolist()
        for at, a, b in zip(batch.column("at").to_pylist(), ends, ends[1:]):
            out[at] = raw[a:b]
    return out


class _Known(dict):
    """word -> 32-bit ids of one chunk; words are met in the order in which the first pass numbered them."""

    def __init__(self, codes: list[bytes], decoder: _Decoder, long: _LongWords):
        self.codes, self.decoder, self.long = iter(codes), decoder, long

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            self[word] = self.long.ids(word.replace(" ", MARK))
            return self[word]
        code = next(self.codes, None)
        if code is None:
            raise RuntimeError("a split's rows are not those of the first pass")
        self[word] = code or self.decoder.spelt(word.replace(" ", MARK))
        return self[word]

    def close(self) -> None:
        if next(self.codes, None) is not None:
            raise RuntimeError("a split's rows are not those of the first pass")


class _Decoder:
    """Rows of ids to text, and characters without pieces to ids."""

    def __init__(self, pieces: Pieces):
        self.base, self.unknown = pieces.byte_base, pieces.unknown
        self.piece = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces.rows}
        if self.base is not None:
            self.piece |= {self.base + b: bytes([b]) for b in range(256)}
        other = b" \xe2\x81\x87 "
        # by id; the last entry is for ids outside the vocabulary
        self.table = pa.array([self.piece.get(i, other) for i in range(max(self.piece, default=0) + 2)], pa.large_binary())

    def spelt(self, word: str) -> bytes:
        ids = [self.unknown] * len(word) if self.base is None else [self.base + b for b in word.encode()]
        return np.array(ids, np.int32).tobytes()

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids end at ``ends`` (0 first), without the space in front."""
        at = self.table.take(pa.array(np.where((ids >= 0) & (ids < len(self.table) - 1), ids, len(self.table) - 1)))
        spots = np.frombuffer(at.buffers()[1], np.int64, len(at) + 1, at.offset * 8)[ends].tolist()
        raw = at.buffers()[2] or b""
        return [bytes(raw[a + 1 : b]) for a, b in zip(spots, spots[1:])]


class _LongWords:
    """The folds for one long word; the lattice is looked up as it is needed."""

    def __init__(self, pieces: Pieces):
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
        self.table = {p: (ranks[s], s, i) for p, i, s in pieces.rows}
        self.longest, self.kind, self.decoder = pieces.longest, pieces.kind, _Decoder(pieces)
        self.worst = min((s for _, _, s in pieces.rows), default=0.0) - 10.0

    def ids(self, word: str) -> bytes:
        """32-bit ids."""
        cuts = self.merged(word) if self.kind == "bpe" else self.viterbi(word)
        parts = (word[a:b] for a, b in zip(cuts, cuts[1:]))
        return b"".join([np.int32(self.table[p][2]).tobytes() if p in self.table else self.decoder.spelt(p) for p in parts])

    def merged(self, word: str) -> list[int]:
        """Byte-pair merges, best rank first, leftmost among equals: a heap of the pairs of neighbours, stale ones skipped."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here; its left neighbour's start
        heap: list = []

        def offer(a: int) -> None:
            m = end[a]
            if a >= 0 and m < n and end[m] - a <= self.longest and (found := self.table.get(word[a : end[m]])):
                heapq.heappush(heap, (found[0], a, m, end[m]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, m, b = heapq.heappop(heap)
            if end[a] != m or end[m] != b:
                continue
            end[a], end[m] = b, 0  # no part starts at m any more
            if b < n:
                before[b] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(end[cuts[-1]])
        return cuts

    def viterbi(self, word: str) -> list[int]:
        """Best path; of equal scores the way with the larger cuts, as in the relation."""
        score, back = [0.0], [0]

        def way(s: int) -> list[int]:
            cuts = [s]
            while s:
                s = back[s]
                cuts.append(s)
            return cuts[::-1]

        for e in range(1, len(word) + 1):
            total, start = score[e - 1] + self.worst, e - 1
            for s in range(max(0, e - self.longest), e):
                if found := self.table.get(word[s:e]):
                    x = score[s] + found[1]
                    if x > total or (x == total and s != start and way(s) + [e] > way(start) + [e]):
                        total, start = x, s
            score.append(total)
            back.append(start)
        return way(len(word))


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), one row per row: the ids are joined to the piece table as bytes and put together in order.

    Null ids give null, no ids the empty text. Ids outside the vocabulary are read as U+2047.
    """
    spark = encoded.sparkSession
    rows = [(i, p.replace(MARK, " ").encode()) for p, i, _ in pieces.rows]
    if pieces.byte_base is not None:
        rows += [(pieces.byte_base + b, bytes([b])) for b in range(256)]
    table = spark.createDataFrame(rows, "id int, bytes binary")  # bounded by the vocabulary
    numbered = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), F.monotonically_increasing_id().alias("row"))
    flat = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"), F.col("ids").isNull().alias("none"))
    known = flat.join(F.broadcast(table), "id", "left")
    put = F.hex(F.coalesce("bytes", F.when(F.col("id").isNotNull(), F.encode(F.lit(" ⁇ "), "UTF-8"))))
    joined = known.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("none").alias("none"), F.sort_array(F.collect_list(F.struct("pos", put.alias("h")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8")
    return joined.select("doc_id", F.when(~F.col("none"), F.substring(text, 2, 2**31 - 1)).alias("text"))
