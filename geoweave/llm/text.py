"""Words of UTF-8 texts as numpy arrays, straight from Arrow buffers.

Everything here works on one Arrow batch inside a task, in slices of about
``SLICE`` bytes, so memory follows the longest text and not the number of rows.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get this module by value: executors need numpy and pyarrow, not this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 19

_ALL = np.arange(256)
#: `[^\x20\x09-\x0D]+`
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)

_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Keeps the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, limit: int = SLICE):
    """Yield (first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a slice: ``doc`` (row in the slice), ``start`` and ``end`` (bytes), ``hash`` (64 bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool):
        n = len(data)
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = table[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # word number at each text's start
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = _LOWER[data] if fold else data
        self.bytes = padded
        self.eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans that do not depend on where they stand.

        Eight bytes at a time are mixed into all 64 bits, with no algebra that
        repetitive spans could meet; long spans get a BLAKE2 digest.
        """
        size = end - start
        h = mix(size.astype(np.uint64) * _STEP + _SEED)
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at = 0
        while len(live):
            rest = size[live] - at
            h[live] = mix((h[live] ^ (self.eights[start[live] + at] & _FIRST[np.minimum(rest, 8)])) * _STEP)
            live = live[rest > 8]
            at += 8
        for i in np.flatnonzero(size > LONG_SPAN):
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes are flagged in each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[self.offsets])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which n words of one text begin, and hashes of those n words."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        h = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            h += self.hash[k : total - n + 1 + k]
            h *= np.uint64(0x9DDFEA08EB382D69)
            h ^= h >> np.uint64(29)
        return at, mix(h[at])


def word_hash(word: str, fold: bool = True) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), np.ones(256, bool), fold)
    return int(w.hash[0])
