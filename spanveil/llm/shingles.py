"""Hashes of word shingles for whole batches of texts at once (numpy).

Words are maximal runs of other bytes than space, tab, LF, VT, FF and CR, with A-Z
lower-cased.  A word's hash is a polynomial over its bytes modulo 2**64, taken
from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes hashed at a time; a longer word is still hashed whole
PIECE = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z as a-z
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.empty(max(n, PIECE + 1), dtype=np.uint64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        if n <= PIECE + 1:
            _powers[name] = have
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offset of each row and the end; nulls are empty."""
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose column ``text`` holds about ``most`` bytes at most (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, i = np.cumsum(lengths), 0
    while i < len(upto):
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece without row boundaries inside words."""
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = _BYTE[data]
    value *= _power("up", _BASE, len(data))[:len(data)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    hashed = (total[end] - total[start]) * _power("down", _INVERSE, len(data) + 1)[start]
    return start, end, mix64(hashed + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and the number of words before each row and in all."""
    hashes, counts = [], np.zeros(len(offsets), dtype=np.int64)
    for row in _row_groups(offsets):
        first, last = int(offsets[row[0]]), int(offsets[row[1]])
        if row[1] - row[0] == 1:
            got = [_hash_piece(data[a:b])[2] for a, b in _cuts(data, first, last)]
            counts[row[1]] = sum(map(len, got))
            hashes += got
            continue
        # a blank between rows keeps their words apart
        inner = offsets[row[0] + 1:row[1]] - first
        start, _, got = _hash_piece(np.insert(data[first:last], inner, 0x20))
        bounds = offsets[row[0]:row[1] + 1] - first + np.arange(row[1] - row[0] + 1)
        counts[row[0] + 1:row[1] + 1] = np.diff(np.searchsorted(start, bounds))
        hashes.append(got)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def _row_groups(offsets: np.ndarray):
    """Runs of rows of at most PIECE bytes together; a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(data: np.ndarray, first: int, last: int):
    """Pieces of one row, cut at white space."""
    a = first
    while a < last:
        b = min(a + PIECE, last)
        if b < last:
            blank = np.flatnonzero(_SPACE[data[a:b]])
            if len(blank):
                b = a + int(blank[-1]) + 1
            else:
                while b < last and not _SPACE[data[b]]:
                    b += 1
        yield a, b
        a = b


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes (uint64) of its k-word shingles; with
    fewer words (but some), one hash of the whole sequence; with none, nothing."""
    data, offsets = text_bytes(column)
    words, upto = word_hashes(data, offsets)
    many = len(words) - k + 1
    if many > 0:
        runs = np.zeros(many, dtype=np.uint64)
        for i in range(k):
            runs = mix64(runs * np.uint64(0xD6E8FEB86659FD93) + words[i:i + many])
    out = []
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a) * np.ones(1, np.uint64)
            for i in range(a, b):
                whole = mix64(whole * np.uint64(0xA0761D6478BD642F) + words[i:i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
