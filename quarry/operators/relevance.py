"""Planted-passage relevance: (item_id, doc_id) where the document text contains the item text.

One pass over the corpus per block of passages (one block up to MAX_PATTERNS
passages and MAX_PATTERN_CHARS characters): a block is compiled into an
Aho-Corasick automaton shipped to every task, and each document is scanned
once, whatever the number of passages -- O(total characters), not
O(passages x characters). Without pyahocorasick the fallback is a broadcast
``contains`` join (exact, slower).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

MAX_PATTERNS = 200_000
MAX_PATTERN_CHARS = 64_000_000

try:  # optional accelerator
    import ahocorasick  # type: ignore
except ImportError:  # pragma: no cover
    ahocorasick = None


def _blocks(passages: DataFrame) -> list[DataFrame]:
    """The passages in blocks of bounded size, by a hash of their id; one block unless they are many."""
    pats = passages.filter(~T.is_blank("text")).select("item_id", "text")
    stats = pats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).collect()[0]
    n = max(1, -(-stats["n"] // MAX_PATTERNS), -(-stats["c"] // MAX_PATTERN_CHARS))
    if n == 1:
        return [pats]
    n = 2 * n   # room for blocks that the hash fills unevenly
    return [pats.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def contains_relevance(docs: DataFrame, passages: DataFrame) -> DataFrame:
    found = [docs.select("doc_id", "text").crossJoin(F.broadcast(block.withColumnRenamed("text", "_p"))).filter(
        F.col("text").contains(F.col("_p"))).select("item_id", "doc_id") for block in _blocks(passages)]
    return functools.reduce(DataFrame.unionByName, found)


def planted_relevance(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) pairs, distinct."""
    if ahocorasick is None:
        return contains_relevance(docs, passages)
    return functools.reduce(DataFrame.unionByName, [_scan_block(docs, block) for block in _blocks(passages)])


def _scan_block(docs: DataFrame, block: DataFrame) -> DataFrame:
    patterns = [(int(r["item_id"]), r["text"]) for r in block.collect()]   # bounded by the block
    if not patterns:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long")
    bc = docs.sparkSession.sparkContext.broadcast(patterns)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for item_id, text in bc.value:
            ids = auto.get(text, None) if text in auto else None
            auto.add_word(text, (ids or ()) + (item_id,))
        auto.make_automaton()
        for pdf in batches:
            out_i, out_d = [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                seen = set()
                for _end, ids in auto.iter(text):
                    seen.update(ids)
                out_i.extend(seen)
                out_d.extend([doc_id] * len(seen))
            yield pd.DataFrame({"item_id": pd.Series(out_i, dtype="int64"), "doc_id": pd.Series(out_d, dtype="int64")})

    return docs.select("doc_id", "text").mapInPandas(scan, "item_id long, doc_id long")
