"""Token ids of whole batches of texts.

Where a tokenizer's file shows that it cuts at white space and drops it, a text's ids are the ids of its words one after
the other: each different word is then encoded once a worker process, and the ids of a text are gathered by numpy.  Words are told
apart by two independent 64-bit hashes.  Words of letters are encoded many at a time, where the ids tell their ends.
Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .byte_words import byte_class, span_hashes, spans
from .shingles import _cuts, _row_groups, text_bytes

#: words kept by a worker; beyond it the store starts anew
KEPT_WORDS = 1_000_000
#: words of letters encoded as one text
JOINED = 64

_BLANK = byte_class(" \t\n\x0b\x0c\r")
_LETTER = byte_class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = byte_class(".,;:!?")


def cuts_words(spec: dict) -> bool:
    """Whether the tokenizer of this file surely cuts at ASCII white space, drops it, and parts a letter from a following mark:
    it normalizes by NFC, lower case and runs of blanks only, keeps just the matches of a pattern whose matches hold
    neither blanks nor letters next to marks, and adds nothing."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    before = spec.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", [before] if before else [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (plain and len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": pattern} and parts[0]["behavior"] == "Removed"
            and parts[0]["invert"] is True and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
            and not any(set(" \t\n\x0b\x0c\r.,;:!?") & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))


def end_ids(spec: dict, tokenizer) -> np.ndarray | None:
    """For each id whether it ends a word, if the tokenizer marks the last piece of every word by a suffix."""
    suffix = spec["model"].get("end_of_word_suffix")
    from tokenizers.pre_tokenizers import ByteLevel
    vocab = tokenizer.get_vocab()
    if spec["model"]["type"] != "BPE" or not suffix or not all(c + suffix in vocab for c in ByteLevel.alphabet()):
        return None
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return ends


@lru_cache(maxsize=1)
def worker_encoder(spec: str) -> Encoder:
    """The encoder of this Python worker: tasks that run in it one after the other share its words."""
    return Encoder(spec)


class Encoder:
    """Ids of texts by a tokenizer, given as the text of its file."""

    def __init__(self, spec: str, by_word: bool | None = None, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        read = json.loads(spec)
        self.by_word = cuts_words(read) if by_word is None else by_word
        self.ends = end_ids(read, self.tokenizer) if self.by_word else None
        self.most = kept
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids.  Letters are never parted, so a word of letters has one end."""
        if self.ends is None or not all(map(str.isalpha, words)):
            got = self._encode(words)
            return np.array([len(g) for g in got], dtype=np.int64), np.concatenate(got)
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        sizes, found = [], []
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            upto = np.flatnonzero(self.ends[ids]) + 1
            if len(upto) == len(group) and upto[-1] == len(ids):
                sizes.append(np.diff(upto, prepend=0))
                found.append(ids)
            else:  # lower case or NFC gave a word something else than letters
                got = self._encode(group)
                sizes.append(np.array([len(g) for g in got], dtype=np.int64))
                found += got
        return np.concatenate(sizes), np.concatenate(found)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        sizes, pools = [], [self.pool]
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end, strict=True)]
        plain = np.array([w.isalpha() for w in words], dtype=bool)
        first = np.argsort(~plain, kind="stable")  # words of letters before the others
        words, keys, checks = [words[i] for i in first], keys[first], checks[first]
        letters = int(plain.sum())
        for low, high in ((0, letters), (letters, len(words))):
            for i in range(low, high, 1 << 14):
                size, ids = self._encode_words(words[i:min(i + (1 << 14), high)])
                sizes.append(size)
                pools.append(ids)
        size = np.concatenate(sizes)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(pools)
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        self.keys, self.checks = np.concatenate((self.keys, keys))[order], np.concatenate((self.checks, checks))[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def _words(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Starts of the words of ``data``, the number of ids of each, and all ids; None if two words share a hash."""
        inside = ~_BLANK[data]
        cut = cut.copy()
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        start, end = spans(inside, cut)
        keys, first, of = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        checks = span_hashes(data, start, end, second=True)
        if not np.array_equal(checks, checks[first][of]):
            return None
        if len(self.keys) > self.most:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not np.array_equal(self.checks[place[known]], checks[first[known]]):
            return None
        if not known.all():
            new = first[~known]
            self._learn(keys[~known], checks[new], data, start[new], end[new])
            place = np.searchsorted(self.keys, keys)
        size = self.size[place][of]
        upto = np.cumsum(size)
        shift = np.repeat(self.at[place][of] - (upto - size), size)
        return start, size, self.pool[shift + np.arange(upto[-1] if len(upto) else 0)]

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text; nulls and empty texts have none."""
        if not self.by_word:
            return self._encode(["" if t is None else t for t in column.to_pylist()])
        data, offsets = text_bytes(column)
        out: list[np.ndarray] = []
        for i, j in _row_groups(offsets):
            first, last = int(offsets[i]), int(offsets[j])
            if j - i == 1:
                got = [self._words(data[a:b], np.zeros(b - a, bool)) for a, b in _cuts(data, first, last)]
                if any(g is None for g in got):
                    out += self._encode([data[first:last].tobytes().decode("utf-8", "replace")])
                else:
                    out.append(np.concatenate([g[2] for g in got]) if got else np.empty(0, np.uint32))
                continue
            cut = np.zeros(last - first, dtype=bool)
            at = offsets[i:j] - first
            cut[at[at < last - first]] = True
            got = self._words(data[first:last], cut)
            if got is None:
                out += self._encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j], offsets[i + 1:j + 1], strict=True)])
                continue
            start, size, ids = got
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            bounds = upto[np.searchsorted(start, offsets[i:j + 1] - first)]
            out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out
