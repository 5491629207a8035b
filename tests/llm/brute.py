"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return _WORD.findall((text or "").encode())


def low_words(text):
    return _WORD.findall((text or "").encode().translate(_LOWER))


def shingle_set(text, k):
    w = low_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(rows, k=4, percent=85):
    """rows (id, text) -> sorted (id, set size, smallest id of the component), every pair compared."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and sets[a][0] is not None and sets[b][0] is not None:
            i = len(x & y)
            if 100 * i >= percent * (len(x) + len(y) - i):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else least[find(i)] if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def shards(rows, n_shards, extra=16):
    """rows (id, text) with distinct ids -> {id: (size, crc, shard)} for any order that keeps equal texts together."""
    return {i: (len((t or "").encode()) + extra, zlib.crc32((t or "").encode())) for i, t in rows}


def best_windows(docs, items, k=5, percent=80):
    """Every window in line with a shared shingle: {(doc, item): (similarity, start)}."""
    from collections import Counter
    out = {}
    for item, it in items:
        iw = low_words(it)
        n = min(k, len(iw))
        if not n:
            continue
        ish = [tuple(iw[j:j + n]) for j in range(len(iw) - n + 1)]
        want = Counter(ish)
        for doc, t in docs:
            dw = low_words(t)
            dsh = [tuple(dw[j:j + n]) for j in range(len(dw) - n + 1)]
            starts = {max(0, p - o) for p, s in enumerate(dsh) if s in want for o, x in enumerate(ish) if x == s}
            for start in sorted(starts):
                have = Counter(dsh[start:start + len(ish)])
                common = sum((have & want).values())
                union = sum(have.values()) + len(ish) - common
                if 100 * common >= percent * union:
                    new = (common / union, start)
                    old = out.get((doc, item))
                    if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                        out[(doc, item)] = new
    return out
