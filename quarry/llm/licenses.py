"""Licence scan by a positional index of rare licence words.

The templates' words form a small vocabulary; its document frequencies are counted over the whole
corpus. The index holds each template's rarest (highest-IDF) words with their positions, and every
place of such a word in a file proposes an alignment: template and relative position. Of a
template's n words m must stand in place, so at least one of any n - m + 1 does; so many are
indexed, and every alignment that can hold is proposed, whatever else the file has. It is checked
word by word, and counts if enough of the template stands there and one of the template's mandatory
key phrases is complete.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbuf as T

#: Phrases whose consecutive words count as base places, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, template, mandatory key phrases: one of them must be complete)
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("in compliance with the license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal", "public domain dedication")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)


@dataclass(frozen=True)
class LicenseScan:
    """``least``: share of a template's words that must stand in place; ``most_bytes``: the largest template table that is taken.

    The index of the templates is held by every task, so a larger table is refused, never cut.
    """

    least: float = 0.6
    most_bytes: int = 16 << 20


def _words(text: str) -> list[str]:
    data, offsets = T.utf8(pa.array([text]))
    w = T.Words(T.LOWER[data], offsets, T.ALNUM)
    return [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]


def template_rows(templates: DataFrame | Sequence, cfg: LicenseScan = LicenseScan()) -> list[tuple]:
    """(label, template, phrases) of a template table or list, as the index takes them, ordered by label and template.

    A table has the columns label, template and phrases (array of strings; null: no phrase is
    mandatory). Rows without a label or without words are left out, as are phrases without words;
    repeated rows count once; other columns are not read. A table of over ``most_bytes`` bytes of
    text raises ValueError before it is gathered.
    """
    if isinstance(templates, DataFrame):
        rows = templates.select(F.col("label").cast("string"), F.col("template").cast("string"), F.col("phrases").cast("array<string>")).distinct()
        size = rows.agg(F.sum(F.coalesce(F.octet_length("template"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("phrases", " ")), F.lit(0)))).first()[0] or 0
        if size > cfg.most_bytes:
            raise ValueError(f"the templates have {size} bytes of text, over most_bytes = {cfg.most_bytes}")
        templates = [tuple(r) for r in rows.collect()]  # bounded by most_bytes
    found = ((label, text, tuple(p for p in keys or () if p and _words(p))) for label, text, keys in templates if label is not None and text and _words(text))
    return sorted(set(found))


def _needed(n: int, least: float) -> int:
    """Fewest of ``n`` words whose share is at least ``least``."""
    return next(m for m in range(n + 1) if m / n >= least)


class _Index:
    """Vocabulary, template postings and phrases, all as word numbers."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [_words(t) for _, t, _ in templates]
        phrases = [[_words(p) for p in keys] for _, _, keys in templates]
        self.base = [(_words(p), label) for p, label in base]
        words = sorted({x for t in texts for x in t} | {x for ks in phrases for k in ks for x in k} | {x for p, _ in self.base for x in p})
        number = {w: i for i, w in enumerate(words)}
        column = T.utf8(pa.array(words))
        h = T.Words(*column, T.ALNUM).hashes()
        self.by_hash = np.argsort(h)
        self.hashes, self.words = h[self.by_hash], words
        self.labels = [label for label, _, _ in templates]
        self.texts = [[number[x] for x in t] for t in texts]
        self.phrases = [[[number[x] for x in k] for k in ks] for ks in phrases]
        self.base = [([number[x] for x in p], label) for p, label in self.base]

    def possible(self, known, least: float) -> list[int]:
        """Templates that a file with these licence words can hold enough of."""
        return [t for t, text in enumerate(self.texts) if sum(x in known for x in text) >= _needed(len(text), least)]

    def rare(self, idf: np.ndarray, least: float) -> list[list[int]]:
        """Per template the positions of its rarest words, so many that an alignment that holds has one of them in place."""
        return [sorted(range(len(text)), key=lambda at: (-idf[text[at]], at))[: len(text) - _needed(len(text), least) + 1] for text in self.texts]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Word number of each hash, -1 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)


def _parts(column, index):
    """(first document, last, words, word numbers) of parts of a batch."""
    data, offsets = T.utf8(column)
    for i, j in T.slices(offsets, 1 << 22):
        w = T.Words(T.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], T.ALNUM)
        yield i, j, w, index.lookup(w.hashes())


def word_frequencies(docs: DataFrame, text_col: str = "text", index: _Index | None = None) -> tuple[int, np.ndarray]:
    """Rows of the corpus, and in how many of them each licence word stands (one number a vocabulary word)."""
    index = index or _Index()
    n = len(index.words)

    def run(batches):
        total, rows = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, w, number in _parts(batch.column(0), index):
                hit = np.flatnonzero(number >= 0)
                pairs = np.unique(w.doc()[hit] * np.int64(n) + number[hit])
                total[:n] += np.bincount(pairs % n, minlength=n)
        total[n] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], names=["word", "df"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = np.zeros(n + 1, np.int64)
    for r in found.collect():  # one row a vocabulary word
        df[r["word"]] = r["df"]
    return int(df[n]), df[:n]


def _spots(phrase: list[int], places: dict[int, list[int]], at_place: dict[int, int]) -> list[int]:
    """File positions where the phrase's words stand consecutively."""
    return [p for p in places.get(phrase[0], ()) if all(at_place.get(p + k) == x for k, x in enumerate(phrase))]


def _align(places: dict[int, list[int]], at_place: dict[int, int], number: np.ndarray, index: _Index, rare: list[list[int]], cfg: LicenseScan):
    """(template, file position of its first word, share of its words in place) of each template's best alignment that holds.

    ``number``: the word number at each place of the file, -1 outside the vocabulary. Of equally good alignments the first counts.
    """
    out, pad = [], max(map(len, index.texts), default=0)
    padded = np.concatenate([np.full(pad, -1), number, np.full(pad, -1)])
    for t in index.possible(places, cfg.least):
        text = index.texts[t]
        n = len(text)
        starts = np.unique(np.array([p - at for at in rare[t] for p in places.get(text[at], ())], np.int64))
        same = np.zeros(len(starts), np.int64)
        for at, x in enumerate(text):
            same += padded[starts + (pad + at)] == x
        spots = np.array(sorted(p for key in index.phrases[t] for p in _spots(key, places, at_place)), np.int64)
        phrase = (np.searchsorted(spots, starts) < np.searchsorted(spots, starts + n)) if index.phrases[t] else np.ones(len(starts), bool)
        share = np.where(phrase, same / n, 0.0)
        if len(share) and share.max() >= cfg.least:
            best = int(np.argmax(share))
            out.append((t, int(starts[best]), float(share[best])))
    return out


def license_scan(docs: DataFrame, cfg: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text",
                 templates: DataFrame | Sequence | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Base places are those where a base phrase's words stand consecutively; first_word and
    last_word are their smallest and largest start (null without one). ``matches`` lists the
    method's (label, start word, share). Score is the best share, 1 for a base place, else 0.
    Null and empty texts have no words, empty labels and score 0. Rows are scanned one by one;
    a null id stays null; other columns are not read. ``templates`` (see ``template_rows``) take
    the place of the built-in notices and may be whole licence texts; without any, only the base
    phrases label.
    """
    index = _Index(TEMPLATES if templates is None else template_rows(templates, cfg))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, df = word_frequencies(rows, "text", index)
    idf = np.array([math.log((n_docs + 1) / (x + 1)) + 1 for x in df])
    rare = index.rare(idf, cfg.least)

    def run(batches):
        for batch in batches:
            for i, j, w, number in _parts(batch.column(1), index):
                n = j - i
                hit = np.flatnonzero(number >= 0)
                doc = np.searchsorted(w.first, hit, "right") - 1
                bounds = np.searchsorted(doc, np.arange(n + 1))
                present = np.unique(doc * np.int64(len(idf)) + number[hit])
                of = np.searchsorted(present, np.arange(n + 1) * np.int64(len(idf)))
                present = (present % len(idf)).tolist()
                out = [[0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]]
                for d in range(n):
                    have = set(present[of[d] : of[d + 1]])
                    if not (any(have.issuperset(p) for p, _ in index.base) or index.possible(have, cfg.least)):
                        continue
                    at = hit[bounds[d] : bounds[d + 1]]
                    first = int(w.first[d])
                    known = number[at].tolist()
                    at_place = dict(zip((at - first).tolist(), known))
                    places: dict = defaultdict(list)
                    for p, x in at_place.items():
                        places[x].append(p)
                    starts, base = [], set()
                    for phrase, label in index.base:
                        spots = _spots(phrase, places, at_place)
                        if spots:
                            starts += spots
                            base.add(label)
                    found = _align(places, at_place, number[first : first + int(w.first[d + 1] - w.first[d])], index, rare, cfg)
                    row = (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                           ",".join(sorted(base | {index.labels[t] for t, _, _ in found})), 1.0 if base else max((x for _, _, x in found), default=0.0),
                           [{"label": index.labels[t], "start": p, "share": x} for t, p, x in found])
                    for column, value in zip(out, row):
                        column[d] = value
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                         pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(w.first).astype(np.int64)), *(pa.array(c, k) for c, k in zip(out, kinds))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                "labels string, score double, matches array<struct<label string, start long, share double>>")
