"""Text expressions: lower-case, dictionary-aware segmentation, stop words, cleaning.

All of it is native Spark expressions (codegen, no Python workers):

* segmentation is forward maximum matching done by one regex: the dictionary
  words as an alternation sorted longest-first, then a run of Latin letters /
  digits / underscore, then a single Han character. ``regexp_extract_all``
  scans left to right, so at each position the longest dictionary word wins.
* feature tokens are tokens of at least two characters (one-character tokens,
  including single Han characters, are never index features).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config

_REGEX_META = re.compile(r"([\\.^$|?*+()\[\]{}])")

# Unicode script classes per regex dialect (Java for Spark, RE2 for DuckDB).
_CLASSES = {
    "java": {"latin": r"\p{IsLatin}", "han": r"\p{IsHan}"},
    "re2": {"latin": r"\p{Latin}", "han": r"\p{Han}"},
}
# Whitespace class that also covers U+3000 and other Unicode spaces.
WS_JAVA = r"(?U)\s"


def _escape(word: str) -> str:
    return _REGEX_META.sub(r"\\\1", word)


def _trie_regex(words: Iterable[str]) -> str:
    """Alternation factored as a prefix trie: at each node the longer
    continuations are tried before ending the word, so a match is always the
    longest dictionary word starting at the position (forward maximum matching),
    and a failing first character is rejected after one comparison."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = [_escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch]
        ends = "" in node
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if ends:
            body = (body if len(branches) > 1 else "(?:" + body + ")") + "?"
        return body

    top = [_escape(ch) + emit(child) for ch, child in sorted(trie.items()) if ch]
    return "|".join(top)


def segment_pattern(dictionary: Iterable[str] | None = None, dialect: str = "java") -> str:
    """Regex whose successive matches are the tokens of a lower-cased text."""
    words = config.custom_words() if dictionary is None else list(dictionary)
    words = sorted({w.strip().lower() for w in words if w and w.strip()})
    cls = _CLASSES[dialect]
    generic = f"[{cls['latin']}\\p{{N}}_]+|{cls['han']}"
    if not words:
        return generic
    return _trie_regex(words) + "|" + generic


def flat_segment_pattern(dictionary: Iterable[str] | None = None, dialect: str = "java") -> str:
    """The same tokens as ``segment_pattern`` with a plain longest-first alternation."""
    words = config.custom_words() if dictionary is None else list(dictionary)
    words = sorted({w.strip().lower() for w in words if w and w.strip()}, key=lambda w: (-len(w), w))
    cls = _CLASSES[dialect]
    generic = f"[{cls['latin']}\\p{{N}}_]+|{cls['han']}"
    return "|".join(_escape(w) for w in words) + ("|" if words else "") + generic


def normalized_text(col: Column | str) -> Column:
    """Missing text becomes '' (never the literal token 'nan'), then lower-case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def tokens(col: Column | str, dictionary: Iterable[str] | None = None) -> Column:
    """ARRAY<STRING> of segmented tokens of the lower-cased text."""
    pattern = segment_pattern(dictionary, "java")
    return F.regexp_extract_all(normalized_text(col), F.lit(pattern), 0)


def drop_stopwords(tok: Column, stop: Sequence[str] | None = None) -> Column:
    """Remove stop words (order and repeats of the other tokens are kept)."""
    stop = config.stopwords() if stop is None else [s.strip() for s in stop if s and s.strip()]
    if not stop:
        return tok
    stop_arr = F.array(*[F.lit(s) for s in stop])
    return F.filter(tok, lambda t: ~F.array_contains(stop_arr, t) & (F.length(strip(t)) > 0))


def clean_tokens(
    col: Column | str,
    dictionary: Iterable[str] | None = None,
    stop: Sequence[str] | None = None,
    remove_stopwords: bool = True,
) -> Column:
    """lower -> segment -> drop stop words and blanks."""
    tok = tokens(col, dictionary)
    return drop_stopwords(tok, stop) if remove_stopwords else tok


def feature_tokens(clean: Column) -> Column:
    """Index features: tokens of two or more characters."""
    return F.filter(clean, lambda t: F.length(t) >= 2)


def clean_text(
    col: Column | str,
    dictionary: Iterable[str] | None = None,
    stop: Sequence[str] | None = None,
    remove_stopwords: bool = True,
) -> Column:
    """Space-joined cleaned tokens (the reference's ``clean_text`` column)."""
    return F.array_join(clean_tokens(col, dictionary, stop, remove_stopwords), " ")


def strip(col: Column | str) -> Column:
    """Strip Unicode whitespace on both sides (plain trim leaves U+3000)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"(?U)\s+$", "")


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (F.length(strip(c)) == 0)


def snippet(col: Column | str, n: int = config.SNIPPET_CHARS_FIXED) -> Column:
    """First ``n`` characters, with '...' appended when the text is longer."""
    c = F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
