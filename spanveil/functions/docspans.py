"""Span work inside one document: matching, tokens, merge, union.

These helpers run in Arrow batches on the executors (``operators.detect``) where a document's
text is at hand, so spans need no second look at the text and no shuffle.  All are linear in the text, and
in the number of spans up to a sort.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Sequence

from . import tables as tb

_TOKEN = re.compile(tb.TOKEN_PATTERN_POSSESSIVE)
_BLANK = re.compile(r"\s")


_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")
_MAY_BE_BLANK = re.compile(r"\\[sSWDnrtfvAZ]|[\s^$]|(?<!\\)\.")


def blank_free(pattern: str) -> bool:
    """No match of the pattern can hold a blank (said only when its text makes that plain)."""
    inside = any(c.startswith("[^") or re.search(r"\\[sSWDnrtfv]|\s", c) for c in _CLASS.findall(pattern))
    return not inside and not _MAY_BE_BLANK.search(_CLASS.sub("", pattern))


class Matcher:
    """Compiled patterns (regex, literals that every match contains)."""

    def __init__(self, patterns: Sequence[tuple[str, list[str]]]):
        self.patterns = [(re.compile(p), literals, bool(literals) and blank_free(p)) for p, literals in patterns]

    @staticmethod
    def _matches(pattern: re.Pattern, literals: list[str], runs_only: bool, text: str, pos: int = 0) -> Iterable[re.Match]:
        """Leftmost non-overlapping matches from ``pos`` on."""
        if not runs_only:
            yield from pattern.finditer(text, pos)
            return
        # matches lie within blank-free runs that hold the literals: long runs without them are not tried at each place
        rare = min(literals, key=text.count)
        at = text.find(rare, pos)
        while at >= 0:
            a, b = at, _BLANK.search(text, at)
            b = b.start() if b else len(text)
            while a > pos and not text[a - 1].isspace():
                a -= 1
            if all(text.find(x, a, b) >= 0 for x in literals):
                yield from pattern.finditer(text, a, b)
            at = text.find(rare, b)

    def find(self, text: str) -> Iterable[tuple[int, int, int, int, str]]:
        """(pattern, match, start, end, text) per pattern, leftmost and non-overlapping; matches whose
        trimmed text is shorter than the least length keep their number but are left out."""
        for i, (pattern, literals, runs_only) in enumerate(self.patterns):
            if all(x in text for x in literals):
                for j, m in enumerate(self._matches(pattern, literals, runs_only, text)):
                    if len(m.group().strip()) >= tb.HEURISTIC_MIN_TRIMMED_LENGTH:
                        yield i, j, m.start(), m.end(), m.group()


def longest_literal(pattern: str) -> str:
    """The longest string that every match of ``pattern`` surely holds, or '' (read off the parsed pattern)."""
    tree = re._parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    found, run = [""], []

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
                continue
            if name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
                continue
            stop()
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                walk(arg[2])
                stop()

    def stop() -> None:
        found.append("".join(run))
        run.clear()
    walk(tree)
    stop()
    return max(found, key=len)


class AutomatonMatcher:
    """Many patterns at once: one pass of an Aho-Corasick automaton over the literals that their matches must hold tells
    which patterns a text can match, and where; only those are tried.  Gives what ``Matcher`` gives."""

    def __init__(self, patterns: Sequence[str]):
        import ahocorasick
        self.patterns = [re.compile(p) for p in patterns]
        self.runs_only = [blank_free(p) for p in patterns]
        literals = [longest_literal(p) for p in patterns]
        self.always = [i for i, x in enumerate(literals) if not x]
        self.of: dict[str, list[int]] = {}
        for i, x in enumerate(literals):
            if x:
                self.of.setdefault(x, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for x in self.of:
            self.automaton.add_word(x, x)
        if self.of:
            self.automaton.make_automaton()

    def _matches(self, pattern: re.Pattern, places: list[int], text: str) -> Iterable[re.Match]:
        """Matches in the blank-free runs around ``places`` (ascending)."""
        done = 0
        for at in places:
            if at < done:
                continue
            a, b = at, _BLANK.search(text, at)
            done = b.start() if b else len(text)
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            yield from pattern.finditer(text, a, done)

    def find(self, text: str) -> Iterable[tuple[int, int, int, int, str]]:
        """(pattern, match, start, end, text), as ``Matcher.find``."""
        places: dict[str, list[int]] = {}
        if self.of:
            for end, x in self.automaton.iter(text):
                places.setdefault(x, []).append(end - len(x) + 1)
        tried = {i: x for x in places for i in self.of[x]} | dict.fromkeys(self.always, "")
        for i in sorted(tried):
            inside = tried[i] and self.runs_only[i] and not any(c.isspace() for c in tried[i])
            hits = self._matches(self.patterns[i], places[tried[i]], text) if inside else self.patterns[i].finditer(text)
            for j, m in enumerate(hits):
                if len(m.group().strip()) >= tb.HEURISTIC_MIN_TRIMMED_LENGTH:
                    yield i, j, m.start(), m.end(), m.group()


#: so many values are replaced one after the other; more are looked for together
FEW_VALUES = 8


def _replacements_stay(values: list[str], reps: list[str]) -> bool:
    """No replacement can be part of a later occurrence: none is empty, no value holds the first or last character of one, and
    none lies within one."""
    edges = {r[0] for r in reps if r} | {r[-1] for r in reps if r}
    return all(reps) and not any(edges & set(v) for v in values) and not any(v in r for r in set(reps) for v in values)


def replace_values(text: str, pairs: Sequence[tuple[str, str]]) -> str:
    """Every occurrence of each value replaced, value after value in the given order, each over the output of the one before (empty values
    are skipped).  Where no replacement can take part in a later occurrence, that is: every value takes its leftmost non-overlapping
    occurrences among the characters that earlier values left, so one pass of an automaton finds all occurrences of all
    values.  Otherwise the values are replaced one by one."""
    first: dict[str, tuple[int, str]] = {}
    for i, (v, r) in enumerate(pairs):
        if v:
            first.setdefault(v, (i, r))
    if len(first) <= FEW_VALUES or not _replacements_stay(list(first), [r for _, r in first.values()]):
        for v, r in pairs:
            text = text.replace(v, r) if v else text
        return text
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for v in first:
        automaton.add_word(v, v)
    automaton.make_automaton()
    places: dict[str, list[int]] = {}
    for end, v in automaton.iter(text):
        places.setdefault(v, []).append(end - len(v) + 1)
    taken, chosen = bytearray(len(text)), []
    for v in sorted(places, key=lambda v: first[v][0]):
        for at in places[v]:
            if taken.find(1, at, at + len(v)) < 0:
                taken[at:at + len(v)] = b"\x01" * len(v)
                chosen.append((at, at + len(v), first[v][1]))
    return rewrite(text, sorted(chosen))


class Tokens:
    """The tokens of a text, found for one blank-free run at a time and kept."""

    def __init__(self, text: str):
        self.text, self.runs = text, {}

    def _run(self, pos: int) -> tuple[int, list[tuple[int, int]]]:
        """End and tokens of the blank-free run around ``pos``."""
        for (a, b), tokens in self.runs.items():
            if a <= pos < b:
                return b, tokens
        a, b = pos, _BLANK.search(self.text, pos)
        b = b.start() if b else len(self.text)
        while a > 0 and not self.text[a - 1].isspace():
            a -= 1
        if len(self.runs) > 4:
            self.runs.clear()
        self.runs[(a, b)] = [m.span() for m in _TOKEN.finditer(self.text, a, b)]
        return b, self.runs[(a, b)]

    def cover(self, start: int, end: int) -> list[tuple[int, int]]:
        """The tokens that overlap [start, end)."""
        out: list[tuple[int, int]] = []
        pos = start
        while pos < end:
            if self.text[pos].isspace():
                pos += 1
                continue
            after, run = self._run(pos)
            i = max(bisect_right(run, (pos, len(self.text))) - 1, 0)
            while i < len(run) and run[i][0] < end:
                if run[i][1] > start:
                    out.append(run[i])
                i += 1
            pos = after
        return out

    def align(self, start: int, end: int) -> tuple[int, int]:
        """The span over the tokens it touches, without one trailing punctuation token; itself if it touches none."""
        tokens = self.cover(start, end)
        if len(tokens) > 1 and self.text[slice(*tokens[-1])] in tb.TRAILING_PUNCTUATION:
            tokens.pop()
        return (tokens[0][0], tokens[-1][1]) if tokens else (start, end)


def islands(spans: list[dict]) -> Iterable[list[dict]]:
    """Groups of transitively overlapping spans, each in list order."""
    group, end = [], -1
    for s in sorted(spans, key=lambda s: s["char_start"]):
        if group and s["char_start"] >= end:
            yield sorted(group, key=lambda s: (s["grp"], s["ord"]))
            group = []
        end = max(end, s["char_end"]) if group else s["char_end"]
        group.append(s)
    if group:
        yield sorted(group, key=lambda s: (s["grp"], s["ord"]))


def merge_sources(model: list[dict], heuristic: list[dict]) -> list[dict]:
    """The heuristic spans taken one by one into the growing list of model spans: one that overlaps an
    earlier entry (first in the list) widens it and makes it 'dual', else it is appended.  Spans of different
    islands never meet, whatever grows, so each island is folded by itself."""
    out = []
    for island in islands([{**s, "grp": 0} for s in model] + [{**s, "grp": 1} for s in heuristic]):
        merged: list[dict] = []
        for s in island:
            first = None
            if s["grp"]:
                first = next((m for m in merged if s["char_start"] < m["char_end"] and m["char_start"] < s["char_end"]), None)
            if first is None:
                merged.append(s)
                continue
            first["char_start"] = min(first["char_start"], s["char_start"])
            first["char_end"] = max(first["char_end"], s["char_end"])
            first["source"] = "dual"
            if s["confidence"] > first["confidence"]:
                first["confidence"] = s["confidence"]
                first["reason"] += tb.MERGE_REASON_SUFFIX
                if s["status"] == "redacted":
                    first["status"] = "redacted"
        out += merged
    return sorted(out, key=lambda s: (s["grp"], s["ord"]))


def union(spans: list[dict], text: str) -> list[dict]:
    """Strictly overlapping spans, taken by start, as one: the first one's fields, the largest end, type and
    confidence of the strictly most confident."""
    out: list[dict] = []
    for s in spans:
        if out and s["char_start"] < out[-1]["char_end"]:
            last = out[-1]
            last["char_end"] = max(last["char_end"], s["char_end"])
            if s["confidence"] > last["confidence"]:
                last["confidence"], last["type"] = s["confidence"], s["type"]
        else:
            out.append(dict(s))
    for s in out:
        s["text"] = text[s["char_start"]:s["char_end"]]
    return out


def percent(value: float) -> str:
    return f"{value:.0%}"


def model_reason(label: str, confidence: float, policy: str) -> str:
    up = label.upper()
    fields = {"label": up.replace("_", " "), "pct": percent(confidence), "policy": policy}
    if "PERSON" in up or "NAME" in up:
        return tb.MODEL_REASON_PERSON.format(**fields)
    if any(x in up for x in ("IBAN", "ACCOUNT", "CARD")):
        return tb.MODEL_REASON_FINANCIAL.format(**fields)
    if any(x in up for x in ("PASSWORD", "KEY", "TOKEN")):
        return tb.MODEL_REASON_SECRET.format(**fields)
    return tb.MODEL_REASON_DEFAULT.format(**fields)


def heuristic_status(confidence: float) -> str:
    return "redacted" if confidence >= tb.REDACT_AT else "missed" if confidence >= tb.REVIEW_AT else "false_positive"




def rewrite(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with every span replaced.  Of spans that overlap the first (by start, then the longest) gives the
    replacement for all they cover together, so no character of any of them is left."""
    out, done = [], 0
    for start, end, new in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= done:
            out += [text[done:start], new]
        done = max(done, end)
    out.append(text[done:])
    return "".join(out)
