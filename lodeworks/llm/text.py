"""Vectorised word and shingle hashing over Arrow string columns, for use inside Spark tasks.

A column is walked in chunks of about a megabyte of UTF-8, and a longer text in pieces of that size, so that the numpy
temporaries stay small however long the column or a text is; what is kept of a text grows with its words. Words are maximal runs of word bytes; which bytes those are, and how letters fold, is a table of
256 entries. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SHINGLE_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA5A3564E9D5F6E8B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)


def _table(is_word: np.ndarray, fold: bool) -> np.ndarray:
    t = np.where(is_word, np.arange(256), 0).astype(np.uint8)
    if fold:
        t[0x41:0x5B] = np.where(is_word[0x41:0x5B], np.arange(0x61, 0x7B), 0)
    return t


def _words_table() -> np.ndarray:
    w = np.ones(256, bool)
    w[[0x20, *range(0x09, 0x0E)]] = False
    return _table(w, True)


def _alnum_table() -> np.ndarray:
    w = np.zeros(256, bool)
    w[0x30:0x3A] = w[0x41:0x5B] = w[0x61:0x7B] = w[0x80:] = True
    return _table(w, True)


#: Words ``[^\x20\x09-\x0D]+`` after folding A-Z (byte 0 counts as the separator it never is in such texts).
WORDS = _words_table()
WORDS[0] = 1
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding A-Z.
ALNUM = _alnum_table()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for pieces of up to CHUNK_BYTES."""
    if CHUNK_BYTES not in _powers:
        up, down = np.full(CHUNK_BYTES + 2, BASE), np.full(CHUNK_BYTES + 2, BASE_INVERSE)
        up[0] = down[0] = 1
        _powers[CHUNK_BYTES] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[CHUNK_BYTES]


def run_hashes(values, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run start..end of n numbers, the same wherever a run stands. ``values(lo, hi)`` gives them piece by
    piece; a run may span pieces."""
    up, down = power_tables()
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, n, CHUNK_BYTES):
        hi = min(n, lo + CHUNK_BYTES)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values(lo, hi) * up[: hi - lo], out=sums[1:])
        first, last = int(np.searchsorted(end, lo, side="right")), int(np.searchsorted(start, hi, side="left"))
        if first >= last:
            continue
        a, b = np.maximum(start[first:last], lo) - lo, np.minimum(end[first:last], hi) - lo
        part = (sums[b] - sums[a]) * down[a]
        if start[first] < lo:  # the run came from the piece before
            part[:1] *= np.uint64(pow(int(BASE), lo - int(start[first]), 1 << 64))
        out[first:last] += part
    return mix(out)


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a column: their bytes, and where each begins among them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows, up to ``most`` bytes at a time or one longer row; null is an empty text."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for part in parts:
        if part.null_count:
            part = part.fill_null("")
        if not pa.types.is_large_string(part.type):
            part = part.cast(pa.large_string())
        n = len(part)
        if not n:
            continue
        _, where, data = part.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            hi = min(hi, n)
            yield Chunk(base + lo, base + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        base += n


@dataclass
class Words:
    """The words of a chunk: first and end byte, row within the chunk, hash, and each row's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_rows + 1 entries


def words(chunk: Chunk, table: np.ndarray = WORDS) -> Words:
    n, rows = len(chunk.data), chunk.hi - chunk.lo
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    w = table.astype(bool)[chunk.data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    edge = chunk.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = w[edge]
    last[edge - 1] = w[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashes = run_hashes(lambda lo, hi: table[chunk.data[lo:hi]], start, end, n)
    first = np.searchsorted(start, chunk.offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, row, hashes, first)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles in text order, and each row's first one (n_rows + 1 entries).

    A row with fewer than ``k`` words, but some, has its whole sequence as its one shingle; its length counts in the hash.
    """
    per_row = np.diff(w.first)
    counts = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1], np.uint64)
    if not len(out):
        return out, first
    n = len(w.hash)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if len(full) else 0):
        full += w.hash[j : j + len(full)] * SHINGLE_FACTORS[j]
    long_rows = np.flatnonzero(per_row >= k)
    # Position p of row r is word first_word[r] + p.
    at = np.repeat(w.first[:-1][long_rows] - first[:-1][long_rows], counts[long_rows])
    slots = np.arange(first[-1])[np.repeat(per_row >= k, counts)]
    if len(slots):
        out[slots] = full[slots + at]
    for r in np.flatnonzero((per_row > 0) & (per_row < k)):
        own = w.hash[w.first[r] : w.first[r + 1]]
        out[first[r]] = (own * SHINGLE_FACTORS[: len(own)]).sum() ^ np.uint64(0x5851F42D4C957F2D * len(own) % (1 << 64))
    return mix(out), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
