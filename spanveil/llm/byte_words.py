"""Words of whole batches of texts as spans of their UTF-8 bytes, with polynomial hashes (numpy).

A class table says which bytes are inside words; all delimiters are ASCII, so bytes and code points agree.
A text longer than a piece is walked piece by piece, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shingles import _BASE, _INVERSE, _cuts, _power, _row_groups, mix64, text_bytes

#: A-Z as a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: two independent families of hashes
_BASE2 = np.uint64(0xD1342543DE82EF95)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_BYTE1, _BYTE2 = np.random.Generator(np.random.PCG64(20251103)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def byte_class(members: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members.encode())] = True
    return table


def spans(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; a run ends before each byte where ``cut`` is true."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:]
    ends[:-1] &= ~inside[1:] | cut[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of ``data``: a polynomial over its bytes by prefix sums, mixed with the length."""
    table, up, down = (_BYTE2, _power("up2", _BASE2, len(data)), _power("down2", _INVERSE2, len(data) + 1)) if second else (
        _BYTE1, _power("up", _BASE, len(data)), _power("down", _INVERSE, len(data) + 1))
    value = table[data]
    value *= up[:len(data)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each run of ``n`` word hashes, from prefix sums (not yet mixed)."""
    many = len(words) - n + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power("up", _BASE, len(words))[:len(words)], dtype=np.uint64)))
    return (total[n:] - total[:many]) * _power("down", _INVERSE, many)[:many] + np.uint64(n)


@dataclass
class Piece:
    """Words of one piece of a batch.  ``data`` are the bytes of the whole batch; ``start`` and ``end`` are
    places in it; ``row`` is the word's row; words of equal ``part`` have no separator between them; words before ``fresh`` were
    in the piece before already."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashed: np.ndarray
    part: np.ndarray
    row: np.ndarray
    fresh: int


def pieces(column: pa.Array, inside: np.ndarray, breaks: np.ndarray, table: np.ndarray | None = None, carry: int = 0) -> Iterator[Piece]:
    """The words of a batch of texts (nulls are empty) piece by piece.  ``inside`` and ``breaks`` are byte classes: of words, and of
    the separators that part them.  ``table`` maps bytes first.  The last ``carry`` words of a piece stand again
    at the head of the next one of the same text."""
    data, offsets = text_bytes(column)
    if table is not None:
        data = table[data]
    for i, j in _row_groups(offsets):
        first, last = int(offsets[i]), int(offsets[j])
        cuts = [(first, last)] if j - i > 1 else _cuts(data, first, last)
        before = None
        for a, b in cuts:
            part = data[a:b]
            cut = np.zeros(b - a, dtype=bool)
            at = offsets[i:j] - a
            cut[at[(at >= 0) & (at < b - a)]] = True
            start, end = spans(inside[part], cut)
            upto = np.cumsum(breaks[part] | cut, dtype=np.int64)
            counts = np.diff(np.searchsorted(start, np.clip(offsets[i:j + 1] - a, 0, b - a)))
            piece = Piece(data, start + a, end + a, span_hashes(part, start, end), upto[start],
                          np.repeat(np.arange(i, j), counts), 0)
            if before is not None:
                joined, base = before
                piece.part += base
                for name in ("start", "end", "hashed", "part", "row"):
                    setattr(piece, name, np.concatenate((getattr(joined, name), getattr(piece, name))))
                piece.fresh = len(joined.start)
            yield piece
            if carry and b < last:
                kept = max(0, len(piece.start) - carry)
                base = (before[1] if before is not None else 0) + (int(upto[-1]) if len(upto) else 0)
                before = (Piece(data, *(getattr(piece, name)[kept:] for name in ("start", "end", "hashed", "part", "row")), 0), base)
