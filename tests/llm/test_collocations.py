"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {p for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p in cands:
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and f[q] >= f[p] and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q in cands):
            continue
        score, k, left, right = min((1000 * f[p] * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out[lang].append((-score, -f[p], " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, c in out.items() for i, (s, a, p, left, right) in enumerate(sorted(c)[:top]))


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed, n=400):
    r = random.Random(seed)
    vocabulary = ["a", "B", "çé", "😀", "the", "of the", "New York City", "one\ttwo  three", "x\x00y", "q.", "ok!", "end\n", *(f"w{i}" for i in range(30))]
    rows = [(r.choice(["en", "fr", None, "und", "", "zh tw"]), " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, "  \t\n"), ("en", "the the the the the the " * 300), ("long", "lone word run " * 4000)] + rows[:30]


def test_brute(spark):
    rows = sample(1)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, f long, phrase string, range int")
    for cfg in (C.Collocations(least=12), C.Collocations(least=5, top=40, part=2000, range_words=50, bits=12)):
        assert result(C.collocations(docs, cfg)) == brute(rows, cfg.least, cfg.top)


def test_empty(spark):
    schema = "lang string, text string"
    assert result(C.collocations(spark.createDataFrame([], schema))) == []
    assert result(C.collocations(spark.createDataFrame([("en", None), (None, "")], schema))) == []


def test_transducer():
    r = random.Random(2)
    counts = {tuple(r.choice([b"a", b"b", b"", b"c d"]) for _ in range(r.randrange(1, 5))): r.choice([1, 1, 7, 10**14]) for _ in range(80)}
    t = C.Transducer.of(counts)
    back = C.Transducer.unpack(t.pack())
    assert dict(back.items()) == dict(t.items()) == counts
    assert len(t.states) < 1 + len({k[:i] for k in counts for i in range(len(k))})  # states are shared
    asked = {k: 1 for k in [*list(counts)[::2], (b"a", b"zz"), (b"q",)]}
    assert dict(back.compose(C.Transducer.of(asked))) == {k: w for k, w in counts.items() if k in asked}
    assert C.Transducer.unpack(C.Transducer.of({}).pack()).states[-1] in ((), [])


def test_ranges_agree():
    """Parts are looked up where the shards have put them."""
    import pyarrow as pa

    shard = C._Shard(pa.array(["en", "fr"]), pa.array(["one two three four five six", "un deux trois quatre"]))
    every = {n: np.flatnonzero([all(shard.joined[i : i + n - 1]) and i + n <= len(shard.word) for i in range(len(shard.word))]) for n in range(1, 6)}
    for at in ({1: every[1]}, {2: every[2]}, {n: every[n] for n in (3, 4, 5)}):
        for home, packed in C._transducers(shard, at, 7):
            keys = [k for k, _ in C.Transducer.unpack(packed).items()]
            assert set(C._home(keys, 7).tolist()) == {home}


def test_sketches():
    r = np.random.default_rng(3)
    for bits, parts, least in ((27, 32, 100), (12, 8, 5), (12, 64, 1000)):
        drawn = [r.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 1, 3000)] + [np.full(2000, (1 << bits) - 1, np.uint32)]
        got = collections.Counter()
        for slots in drawn:
            for part, packed in C._sketches(slots, bits, parts, least):
                at, counts = C._slot_counts(packed, least)
                got.update(dict(zip((at + part * ((1 << bits) // parts)).tolist(), counts.tolist())))
        want = collections.Counter()
        for slots in drawn:
            want.update({s: min(n, least) for s, n in collections.Counter(slots.tolist()).items()})
        assert got == want


def test_rare_pairs_stay_out(spark):
    """Of frequent words, only pairs and longer phrases that may be frequent are packed and shuffled."""
    r = random.Random(4)
    rows = [("en", " ".join(r.choice([f"w{r.randrange(40)}", "new york city"]) for _ in range(50))) for _ in range(80)]
    docs, cfg = spark.createDataFrame(rows, "lang string, text string"), C.Collocations(least=20, part=3000)
    packed, shard_transducers = [], C.shard_transducers

    def kept(*args):
        out = shard_transducers(*args)
        packed.append([k for row in out.filter("range >= 0").select("packed").collect() for k, _ in C.Transducer.unpack(bytes(row.packed)).items()])
        return out

    C.shard_transducers = kept
    try:
        assert result(C.collocations(docs, cfg)) == brute(rows, cfg.least)
    finally:
        C.shard_transducers = shard_transducers
    f = collections.Counter(tuple(p) for _, t in rows for n in range(1, 6) for w in [t.split()] for p in (w[i : i + n] for i in range(len(w) - n + 1)))
    assert min(f[f"w{i}",] for i in range(40)) >= cfg.least and sum(f[p] < cfg.least for p in f if len(p) == 2) > 500
    seen = [{tuple(w.decode() for w in k[1:]) for k in keys if len(k) > 2} for keys in packed]
    assert {p for keys in seen for p in keys} >= {p for p in f if len(p) > 1 and f[p] >= cfg.least}
    assert sum(f[p] < cfg.least for keys in seen for p in keys) < 5


def test_exact_scores(spark):
    rows = [(a, n, left, right) for a, n, left, right in [(10**14, 10**17, 10**14 + 1, 10**15 - 1), (100, 12345678901234, 101, 103), (7, 9, 7, 7), (10**14, 10**18, 10**14, 10**14)]]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long")
    q, top, bottom = C._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    assert [r.s for r in got.withColumn("top", top).withColumn("bottom", bottom).select(q.alias("s")).collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]
