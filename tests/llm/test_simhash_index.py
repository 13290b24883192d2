"""SimHash near duplicates against brute force."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from quarry.llm import queries, simhash_index
from test_operators import LOWER, SPACE, TEXTS, words  # noqa: F401

SF001 = "/root/testdata/sf0.001"


def fingerprint(text):
    w = SPACE.findall((text or "").translate(LOWER))
    runs = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else ([w] if w else [])
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, component) per row; all pairs compared."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    of = {}
    for i, f in prints:
        if i is not None:
            of.setdefault(i, set()).add(f)
    group = {i: i for i in of}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    by_print = {}
    for i, fs in of.items():
        for f in fs:
            by_print.setdefault(f, []).append(i)
    fs = list(by_print)
    for x, f in enumerate(fs):
        for g in fs[x:]:
            if (f ^ g).bit_count() <= 4:
                for j in by_print[f] + by_print[g]:
                    a, b = root(by_print[f][0]), root(j)
                    group[max(a, b)] = min(a, b)
    return sorted((-1 if i is None else i, f"{f:016x}", -1 if i is None else root(i)) for i, f in prints)


def result(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in frame.collect())


def test_odd_rows(spark):
    rows = TEXTS + [(60, "one two three four"), (60, " ".join(words(30, 8))), (61, " ".join(words(30, 8))), (62, "ONE  two\tthree\nfour")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, fp long, fingerprint string, label int")
    assert result(simhash_index.near_duplicates(docs)) == brute(rows)
    assert simhash_index.near_duplicates(docs.limit(0)).collect() == []


def family(n, seed, size=300):
    """Texts that differ from one text in a few words: fingerprints in chains of small steps."""
    r, base = random.Random(seed), words(size, seed)
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(size)] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_in_blocks(spark):
    rows = list(enumerate(family(150, 1) + family(120, 2) + [" ".join(words(50, 100 + k)) for k in range(80)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, _, c in want}) < 350
    for block in (4096, 7):
        assert result(simhash_index.near_duplicates(docs, simhash_index.SimHash(block=block))) == want


def test_every_pair_within_four_bits_meets_in_a_list():
    from itertools import combinations

    r = random.Random(3)
    masks = [simhash_index._mask(p) for p in combinations(range(8), 4)]
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in (m & (1 << 64) - 1 for m in masks))


def test_native_hash_agrees(spark):
    """The session's own xxhash64 is the contract's XXH64 with seed 42."""
    rows = [("é😀 naïve 中文字",), ("one two three four" * 9,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.xxhash64("t")).collect()]
    assert got == [int.from_bytes(xxhash.xxh64_intdigest(t.encode(), 42).to_bytes(8, "big"), "big", signed=True) for (t,) in rows]


def test_query(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert result(queries.op13_simhash_near_dedup(spark, SF001)) == brute([tuple(r) for r in docs])


def test_exploded_lists_are_never_broadcast(spark, monkeypatch):
    """Spark sizes the lists as the table before the explode, so every join of them has to be a merge join."""
    plans = {}

    def recorded(df, name="stage"):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    kept = simhash_index.written
    monkeypatch.setattr(simhash_index, "written", recorded)
    rows = [(i, f"one two three four five six seven eight nine ten eleven {i % 7} twelve") for i in range(40)]
    assert simhash_index.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40
    assert "SortMergeJoin" in plans["members"] and "Broadcast" not in plans["members"]
    assert "SortMergeJoin [at" in plans["open"]

    members = spark.createDataFrame([(0, 1, 2, 3)], "at int, bytes long, fp long, label long")
    assert "Broadcast" not in simhash_index._block_links(members, simhash_index.SimHash())._jdf.queryExecution().executedPlan().toString()
