"""Words of whole Arrow text columns as numpy arrays.

A text column is one UTF-8 buffer plus offsets, so a batch of documents is scanned with
vectorised byte operations and no Python string is made per word. Both word classes used by
the operators are closed under UTF-8: every byte of a non-ASCII character is >= 0x80, and all
separators are ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE_BYTES)] = False
#: ASCII letters and digits, and everything outside ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null reads as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string()).fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch: byte ``start`` and ``end``, and per document the range ``first[d]:first[d + 1]``.

    A word is a maximal run of bytes of one class; class 0 separates.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, byte_class: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        kind = np.zeros(n + 2, dtype=np.uint8)
        kind[1:-1] = byte_class[data]
        change = kind[1:] != kind[:-1]
        change[offsets] = True  # a word never runs on into the next document
        self.start = np.flatnonzero(change[:n] & (kind[1:-1] != 0))
        self.end = np.flatnonzero(change[1:] & (kind[1:-1] != 0)) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, read eight at a time."""
        size = self.end - self.start
        h = size.astype(np.uint64) * _M2
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(self.data) + 8,), (1,))
        live, at = np.arange(len(size)), 0
        while len(live):
            left = size[live] - at
            block = lanes[self.start[live] + at]
            short = left < 8
            keep = (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            block[short] &= keep
            x = (h[live] ^ block) * _M1
            h[live] = x ^ (x >> _S29)
            at += 8
            live = live[left > 8]
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _M2
    h = (h ^ (h >> _S29)) * _M1
    return h ^ (h >> _S32)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` hashes; runs over a document's end are for the caller to leave out."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _M1 + h[i : i + n]
        out ^= out >> _S29
    return mix(out)


def slices(offsets: np.ndarray, most: int):
    """Document ranges (i, j) of up to ``most`` bytes each, at least one document; they cover the batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
