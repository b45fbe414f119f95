"""Personal data by patterns, and by a semi-Markov conditional random field that adds spans.

The patterns' spans stay as they are. What they leave of runs of tokens that hold a digit or ``@``, or follow a word such as
*password*, is split into atoms. A candidate is a stretch of up to SPAN atoms that begins and ends visibly; features of the
whole stretch score it as each kind, transitions score kinds beside one another and beside plain text, and dynamic
programming over the atoms chooses boundaries and kinds together. Weights maximise the likelihood of the segmentations
of sampled texts, in which the patterns' spans and variants of them are the labels, and dates, book numbers, versions,
coordinates and other numbers are none. No candidate is excluded by its form.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestframe.llm.common import draw, read

#: Kinds in the order in which spans of one start are listed; the last has no pattern of its own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Most atoms of a span; least letters and digits, and most characters, of a candidate.
SPAN, SHORTEST, LONGEST = 12, 6, 120
#: Bounds of what is learned from: texts, characters of a text, windows, and atoms of a window.
TEXTS, CHARS, WINDOWS, ATOMS = 1_500, 20_000, 2_000, 24
#: Atoms whose candidates are scored together.
BLOCK = 8_192

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A token that holds a digit or @; it is looked for from tokens' beginnings only.
_MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_ATOM = re.compile(r"[A-Za-z0-9]+|[^\W\d_]+|\s+|.", re.S)
#: Words before secrets, numbers to call, cards, and numbers that are nobody's.
_SECRET_CUE = re.compile(r"(?i)(?<![a-z])(?:token|secret|key|passw(?:or)?d|pwd|credential)s?\b[\"']?\s{0,2}(?:is\b|[=:])?\s{0,2}[\"']?")
_CALL_CUE = re.compile(r"(?i)\b(?:call|phone|tel|mobile|fax|dial|reach|text)\b\.?:?\s{0,2}")
_CARD_CUE = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|paid)\b:?\s{0,2}")
_OTHER_CUE = re.compile(r"(?i)\b(?:isbn|issn|doi|version|ver|commit|sha|md5|hash|rows?|lat|lon|page|pages|order|item|no|id|ssn|date|at|on)\b[.:#]?\s{0,2}")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|key|passw(?:or)?d|pwd|credential)s?\s?[=:]\s?[\"']?([A-Za-z0-9_/+-]{16,})")


def luhn(digits: str) -> bool:
    """The check sum of a card number."""
    total = sum(int(d) for d in digits[-1::-2]) + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the patterns, leftmost and without overlaps a kind, in time proportional to the text."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if len(digits) <= 19 and len(digits) >= 14 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def windows(text: str, taken: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches to look at, in order: neighbouring marked tokens, and tokens after a secret's cue, without what ``taken`` spans (by start) cover."""
    marked = [m.span() for m in _MARKED.finditer(text)]
    for m in _SECRET_CUE.finditer(text):
        end = m.end()
        while end < len(text) and end - m.end() < LONGEST and not text[end].isspace():
            end += 1
        if end - m.end() >= SHORTEST:
            marked.append((m.end(), end))
    runs: list[list[int]] = []
    for a, b in sorted(marked):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        elif runs and a - runs[-1][1] == 1 and text[a - 1] in " \t":
            runs[-1][1] = b
        else:
            runs.append([a, b])
    spans = iter(taken)
    span = next(spans, None)
    for at, end in runs:
        while span is not None and span[1] <= at:
            span = next(spans, None)
        while span is not None and span[0] < end:
            if span[0] - at >= SHORTEST:
                yield at, span[0]
            at = max(at, span[1])
            if span[1] > end:
                break
            span = next(spans, None)
        if end - at >= SHORTEST:
            yield at, end


def _within(ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places a cue ends at."""
    at = np.minimum(np.searchsorted(ends, places), max(len(ends) - 1, 0))
    return ends[at] == places if len(ends) else np.zeros(len(places), bool)


def _cumulated(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x)))


def _shape(lengths: Sequence[int]) -> int:
    return sum(x * 32 ** (len(lengths) - 1 - k) for k, x in enumerate(lengths))


#: Lengths of groups of digits in dates (1), numbers to call (2) and cards (3).
GROUPED = {
    1: ((4, 2, 2), (2, 2, 4), (1, 2, 4), (2, 1, 4), (4, 2), (4, 2, 2, 2, 2), (4, 2, 2, 2, 2, 2)),
    2: ((3, 3, 4), (4, 3, 4), (2, 3, 4), (2, 4, 4), (3, 4, 4), (3, 3, 3), (1, 3, 3, 4), (2, 3, 3, 4), (3, 4)),
    3: ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4)),
}
_known = sorted((_shape(x), form) for form, shapes in GROUPED.items() for x in shapes)
_SHAPES, _FORM = (np.array(x) for x in zip(*_known, strict=True))


def _flags(signs: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in signs]] = True
    return out


_LEFT, _RIGHT, _LINKS = _flags("+_@%"), _flags("_@%"), _flags(".-/:")


class Pieces:
    """Stretches of texts side by side: their atoms, and the candidates that start at a range of atoms, with features."""

    def __init__(self, pieces: Sequence[tuple[str, int, int]]) -> None:
        joined, start, end, owner, self.shift = [], [], [], [], []
        at = 0
        for p, (text, a, b) in enumerate(pieces):
            left = max(0, a - 24)
            joined.append(f"\n{text[left:b]}{text[b : b + 2]}\n\n")
            self.shift.append(a - (at + 1 + a - left))  # from a place here to one in the text
            inner = at + 1 + a - left
            for m in _ATOM.finditer(text, a, b):
                start.append(m.start() - a + inner)
                end.append(m.end() - a + inner)
                owner.append(p)
            at += len(joined[-1])
        whole = "".join(joined)
        self.start, self.end, self.owner = (np.array(x, np.int64) for x in (start, end, owner))
        c = self.code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit, upper, lower = (c >= 48) & (c <= 57), (c >= 65) & (c <= 90), (c >= 97) & (c <= 122)
        known = np.unique(c[c > 127])
        lower |= np.isin(c, known[np.array([chr(x).isalpha() for x in known.tolist()], bool)]) if len(known) else False
        self.alnum = digit | upper | lower
        kind = digit + 2 * upper + 3 * lower
        changes = np.zeros(len(c), bool)
        changes[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        signs = [digit, upper, lower, c == 64, c == 46, c == 45, (c == 32) | (c == 9), (c == 40) | (c == 41), c == 43, (c == 58) | (c == 47), (c == 95), changes]
        self.sums = np.zeros((len(c) + 1, len(signs)), np.int32)
        np.cumsum(np.column_stack(signs), 0, np.int32, self.sums[1:])
        n_digit = self.sums[:, 0].astype(np.int64)
        self.visible = _cumulated(self.alnum)
        self.digits = n_digit
        value = np.where(digit, c.astype(np.int64) - 48, 0)
        double = np.where(2 * value > 9, 2 * value - 9, 2 * value)
        even = (n_digit[:-1] % 2 == 0) & digit
        # Check sums of digits, the last of which has an even or an odd number of digits before it.
        self.check = [_cumulated(np.where(even, value, double) * digit), _cumulated(np.where(even, double, value) * digit)]
        self.cues = [np.array(sorted({m.end() for m in cue.finditer(whole)}), np.int64) for cue in (_SECRET_CUE, _CALL_CUE, _CARD_CUE, _OTHER_CUE)]
        first, last = self.code[self.start] if len(self.start) else c[:0], self.code[self.end - 1] if len(self.end) else c[:0]
        self.opens = self.alnum[self.start] & (first != 95) | (first == 43) | (first == 40) if len(self.start) else np.zeros(0, bool)
        self.closes = self.alnum[self.end - 1] if len(self.end) else np.zeros(0, bool)
        del last
        size = self.end - self.start
        digits = n_digit[self.end] - n_digit[self.start]
        self.group = np.where((digits == size) & (size > 0), size, 0)  # length of an atom of digits only, else 0
        self.number = np.full(len(size), 999)
        for length in (1, 2, 3):
            of = np.flatnonzero(self.group == length)
            self.number[of] = sum(value[self.start[of] + k] * 10 ** (length - 1 - k) for k in range(length))

    def __len__(self) -> int:
        return len(self.start)

    def candidates(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First atom, last atom + 1 and features of the candidates that start at atoms ``low`` to ``high``."""
        n = len(self.start)
        i = np.arange(low, min(high, n))
        most, least, groups, shape, octets = np.zeros(len(i), np.int64), np.full(len(i), 99), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.ones(len(i), bool)
        out_i, out_j, runs = [], [], []
        for w in range(1, SPAN + 1):
            keep = i + w <= n
            i, most, least, groups, shape, octets = i[keep], most[keep], least[keep], groups[keep], shape[keep], octets[keep]
            keep = self.owner[i] == self.owner[i + w - 1]
            i, most, least, groups, shape, octets = i[keep], most[keep], least[keep], groups[keep], shape[keep], octets[keep]
            if not len(i):
                break
            g = self.group[i + w - 1]
            is_group = g > 0
            most, least = np.maximum(most, g), np.where(is_group, np.minimum(least, g), least)
            groups = groups + is_group
            shape = np.where(is_group, (shape * 32 + np.minimum(g, 31)) % (1 << 50), shape)
            octets &= (self.number[i + w - 1] <= 255) | ~is_group
            size = self.end[i + w - 1] - self.start[i]
            use = self.opens[i] & self.closes[i + w - 1] & (self.visible[self.end[i + w - 1]] - self.visible[self.start[i]] >= SHORTEST) & (size <= LONGEST)
            out_i.append(i[use])
            out_j.append(i[use] + w)
            runs.append(np.stack([most[use], least[use], groups[use], shape[use], octets[use]]))
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)
        first, after = np.concatenate(out_i), np.concatenate(out_j)
        return first, after, self._features(first, after, np.concatenate(runs, 1))

    def _features(self, i: np.ndarray, j: np.ndarray, runs: np.ndarray) -> np.ndarray:
        s, e = self.start[i], self.end[j - 1]
        digits, upper, lower, at, dots, dashes, spaces, round_, plus, slashes, under, changes = (self.sums[e] - self.sums[s]).T.copy()
        most, least, groups, shape, octets = runs
        n, atoms = e - s, j - i
        letters = upper + lower
        c = self.code
        before, after, second = c[s - 1], c[e], c[np.minimum(e + 1, len(c) - 1)]
        plain = digits + spaces + dots + dashes + round_ + plus == n
        parity = (self.digits[e] - 1) % 2
        check = np.where(parity == 0, self.check[0][e] - self.check[0][s], self.check[1][e] - self.check[1][s]) % 10 == 0
        known = np.minimum(np.searchsorted(_SHAPES, shape), len(_SHAPES) - 1)
        form = np.where(_SHAPES[known] == shape, _FORM[known], 0)
        seps = n - digits - letters
        alike = (seps == dots) | (seps == dashes) | (seps == spaces)
        word = (letters > 0) & (digits + letters + under + dashes + plus + slashes == n)
        secret, call, card, other = (_within(x, s) for x in self.cues)
        date = (form == 1) & (digits >= 6) & (letters == 0)
        first3 = (c[s] == 57) & (c[np.minimum(s + 1, len(c) - 1)] == 55) & (c[np.minimum(s + 2, len(c) - 1)] >= 56)
        x = [
            np.ones(len(i)),
            (at == 1) & (dots > 0) & (spaces == 0),
            at > 1,
            plain & (groups == 4) & (dots == 3) & (seps == 3) & octets,
            plain & (groups == 4) & (dots == 3) & (seps == 3) & ~octets,
            plain & check & (digits >= 14) & (digits <= 19),
            plain & ~check & (digits >= 14) & (digits <= 19),
            plain & (digits >= 10) & (digits <= 13) & (groups > 1),
            plain & (digits >= 7) & (digits < 10) & (groups > 1),
            plain & (digits < 7),
            plain & (digits > 19),
            plain & (groups == 1),
            (c[s] == 43) & plain,
            (round_ == 2) & plain,
            (round_ == 1),
            plain & (groups > 1) & (shape % 32 == 4) & (most <= 4) & (least >= 3),
            plain & (form == 2),
            plain & (form == 3),
            plain & (most == 4) & (least == 4) & alike & (seps > 0) & (groups < 4),
            date,
            slashes > 0,
            plain & first3 & ((digits == 13) | (digits == 10)),
            plain & (dots == seps) & (groups == 2),
            plain & (dots > 0) & (dots == seps) & (groups > 2) & (least < 3),
            plain & (spaces > 0) & (dots > 0),
            (letters > 0) & (spaces > 0),
            (letters > 0) & (digits == 0) & (at == 0),
            word & (digits >= 2) & (letters >= 4) & (n >= 16),
            word & (digits >= 2) & (letters >= 4) & (n < 16),
            word & (n >= 16) & (upper >= 2) & (lower >= 2) & (digits >= 2),
            word & (changes >= 4),
            secret & (spaces == 0) & (n >= 8),
            secret & word & (n >= 12),
            secret & (n < 8),
            call,
            card,
            other,
            self.alnum[s - 1] | _LEFT[np.minimum(before, 127)],
            _LINKS[np.minimum(before, 127)] | (before == 61) | (before == 40),
            self.alnum[e] | _RIGHT[np.minimum(after, 127)],
            _LINKS[np.minimum(after, 127)] & self.alnum[np.minimum(e + 1, len(c) - 1)],
            (after == 32) & (second >= 48) & (second <= 57),
            ~alike & (round_ == 0) & plain,
            atoms / SPAN,
            np.minimum(n, 64) / 64,
        ]
        out = np.empty((SIZE, len(i)), np.float32)
        for k, v in enumerate(x):
            out[k] = v
        return out.T


#: Features of a candidate.
SIZE = 45


@dataclass
class Field:
    """Weights by feature and kind, and of transitions between labels: 0 is plain text, an atom each; k + 1 a span of kind k.

    That plain text follows plain text weighs nothing, as spans' features weigh their atoms."""

    weights: np.ndarray
    turns: np.ndarray

    @classmethod
    def new(cls) -> Field:
        weights = np.zeros((SIZE, len(KINDS)))
        weights[0] = -3.0
        turns = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        turns[1:, 1:] = -3.0  # spans seldom touch
        return cls(weights, turns)

    def gain(self) -> np.ndarray:
        """By kind, the most that a span's neighbours can add to it over plain text in its place."""
        t = self.turns
        return np.array([(t[:, k, None] + t[None, k, :] - t[:, 0, None] - t[None, 0, :]).max() for k in range(1, len(t))])


def decode(n: int, first: np.ndarray, after: np.ndarray, scores: np.ndarray, turns: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of atoms 0 to n: (first, after, kind) of its spans; ``scores`` by candidate and kind. Steps within plain text weigh nothing."""
    labels = range(len(turns))
    to = turns.T.tolist()  # by label: what it costs to come from each
    stops = sorted({0, n, *first.tolist(), *after.tolist()})
    place = {x: k for k, x in enumerate(stops)}
    ending: list[list[tuple[int, int]]] = [[] for _ in stops]
    begins = {place[x] for x in first.tolist()}
    for c, (i, j) in enumerate(zip(first.tolist(), after.tolist(), strict=True)):
        ending[place[j]].append((c, place[i]))
    rows = scores.tolist()
    best = [[0.0] + [-np.inf] * (len(turns) - 1)]
    back: list[list[tuple[int, int, int]]] = [[(0, 0, -1)] * len(turns)]
    enter: dict[int, list[tuple[float, int]]] = {}
    for k in range(len(stops)):
        if k:
            last = best[-1]
            value, y = max((last[y] + to[0][y], y) for y in labels) if any(v > -np.inf for v in last[1:]) else (last[0], 0)
            now, ways = [value] + [-np.inf] * (len(turns) - 1), [(k - 1, y, -1)] * len(turns)
            for c, i in ending[k]:
                for kind, (come, y) in enumerate(enter[i]):
                    v = come + rows[c][kind]
                    if v > now[kind + 1]:
                        now[kind + 1], ways[kind + 1] = v, (i, y, c)
            best.append(now)
            back.append(ways)
        if k in begins:
            now = best[-1]
            enter[k] = [max((now[y] + to[kind][y], y) for y in labels) for kind in labels[1:]]
    out, k = [], len(stops) - 1
    y = max(labels, key=lambda y: best[-1][y])
    while k > 0:
        i, before, c = back[k][y]
        if c >= 0:
            out.append((int(first[c]), int(after[c]), y - 1))
        k, y = i, before
    return out[::-1]


def added(pieces: Sequence[tuple[str, int, int]], field: Field) -> list[list[tuple[int, int, int]]]:
    """The spans (start, end, kind) that the field finds in each stretch. Candidates that no neighbours could make worth while are passed over."""
    if not pieces:
        return []
    own, gain = Pieces(pieces), field.gain()
    parts = []
    for low in range(0, len(own), BLOCK):
        first, after, x = own.candidates(low, low + BLOCK)
        scores = x @ field.weights
        use = (scores + gain > 0).any(1)
        parts.append((first[use], after[use], scores[use]))
    first, after, scores = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(KINDS))))
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    bounds = np.searchsorted(own.owner, np.arange(len(pieces) + 1))
    order = np.argsort(first, kind="stable")
    first, after, scores = first[order], after[order], scores[order]
    cuts = np.searchsorted(first, bounds)
    for p in range(len(pieces)):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            low = bounds[p]
            for i, j, k in decode(int(bounds[p + 1] - low), first[a:b] - low, after[a:b] - low, scores[a:b], field.turns):
                out[p].append((int(own.start[low + i]) + own.shift[p], int(own.end[low + j - 1]) + own.shift[p], k))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Cases:
    """Windows of up to ATOMS atoms with their labels: candidates by (window, first atom, atoms - 1), their features, and the labelled segments."""

    atoms: np.ndarray
    window: np.ndarray
    first: np.ndarray
    size: np.ndarray
    x: np.ndarray
    gold: np.ndarray  # by candidate: its kind, or -1
    seen_turns: np.ndarray  # by label and label: how often one follows the other in the labels

    @classmethod
    def of(cls, examples: Sequence[tuple[str, Sequence[tuple[int, int, int]]]], most: int = WINDOWS) -> Cases:
        pieces, golds = [], []
        for text, gold in examples:
            for a, b in windows(text, []):
                inside = {g for g in gold if a <= g[0] and g[1] <= b}
                pieces.append((text, a, b))
                golds.append(inside)
        pieces, golds = pieces[:most], golds[:most]
        own = Pieces(pieces)
        bounds = np.searchsorted(own.owner, np.arange(len(pieces) + 1))
        first, after, x = own.candidates(0, len(own))
        window = own.owner[first] if len(first) else np.zeros(0, np.int64)
        number = np.full(len(pieces), -1)
        seen = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        gold_of = np.full(len(first), -1)
        by: dict[tuple[int, int, int], int] = {(int(w), int(own.start[i]) + own.shift[w], int(own.end[j - 1]) + own.shift[w]): c for c, (w, i, j) in enumerate(zip(window.tolist(), first.tolist(), after.tolist(), strict=True))}
        used = 0
        for p, gold in enumerate(golds):
            n = int(bounds[p + 1] - bounds[p])
            chosen = sorted((by[key], k) for s, e, k in gold if (key := (p, s, e)) in by)
            # Windows are left out if they are long, or if their labels are no segmentation by candidates.
            if n == 0 or n > ATOMS or len(chosen) != len(gold):
                continue
            places = sorted((int(first[c] - bounds[p]), int(after[c] - bounds[p]), k, c) for c, k in chosen)
            if any(x[1] > y[0] for x, y in zip(places, places[1:], strict=False)):
                continue
            label, at = 0, 0
            for i, j, k, c in places:
                for _ in range(at, i):
                    seen[label, 0] += 1
                    label = 0
                seen[label, k + 1] += 1
                label, at = k + 1, j
                gold_of[c] = k
            for _ in range(at, n):
                seen[label, 0] += 1
                label = 0
            number[p] = used
            used += 1
        keep = number[window] >= 0 if len(window) else np.zeros(0, bool)
        atoms = (bounds[1:] - bounds[:-1])[number >= 0]
        return cls(atoms, number[window[keep]], (first - bounds[window])[keep] if len(window) else first, (after - first - 1)[keep], x[keep], gold_of[keep], seen)

    def part(self, low: int, high: int) -> Cases:
        """The windows of more than ``low`` and up to ``high`` atoms; ``seen_turns`` stays that of all."""
        inside = (self.atoms > low) & (self.atoms <= high)
        keep, number = inside[self.window], np.cumsum(inside) - 1
        return Cases(self.atoms[inside], number[self.window[keep]], self.first[keep], self.size[keep], self.x[keep], self.gold[keep], self.seen_turns)

    def step(self, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
        """The log likelihood without the labels' transitions, the slope of the weights (labelled minus expected features), and the expected
        transitions, by forward and backward sums."""
        w, n, kinds = len(self.atoms), int(self.atoms.max(initial=0)), len(KINDS)
        score = self.x @ field.weights
        z = np.full((w, n, SPAN, kinds), -np.inf)
        z[self.window, self.first, self.size] = score
        t = field.turns
        ahead = np.full((w, n + 1, kinds + 1), -np.inf)
        enter = np.full((w, n + 1, kinds), -np.inf)  # all ways to a span of a kind that begins here
        ahead[:, 0, 0] = 0.0
        for j in range(n + 1):
            if j:
                ahead[:, j, 0] = _log_sum(ahead[:, j - 1] + t[:, 0], 1)
                sizes = np.arange(min(SPAN, j))
                ahead[:, j, 1:] = _log_sum(z[:, j - 1 - sizes, sizes] + enter[:, j - 1 - sizes], 1)
            enter[:, j] = _log_sum(ahead[:, j, :, None] + t[None, :, 1:], 1)
        behind = np.full((w, n + 1, kinds + 1), -np.inf)
        leave = np.full((w, n + 1, kinds), -np.inf)  # all ways on by a span of a kind that begins here
        ends = np.arange(n + 1)[None, :] == self.atoms[:, None]
        for i in range(n, -1, -1):
            if i < n:
                sizes = np.arange(min(SPAN, n - i))
                leave[:, i] = _log_sum(z[:, i, sizes] + behind[:, i + 1 + sizes, 1:], 1)
                on = np.concatenate([t[None, :, :1] + behind[:, i + 1, None, :1], t[None, :, 1:] + leave[:, i, None, :]], 2)
                behind[:, i] = _log_sum(on, 2)
            behind[:, i] = np.where(ends[:, i, None], 0.0, behind[:, i])
        total = _log_sum(np.where(ends[:, :, None], ahead, -np.inf).max(1), 1)
        chance = np.exp(enter[self.window, self.first] + score + behind[self.window, self.first + self.size + 1, 1:] - total[self.window, None])
        seen = np.zeros_like(chance)
        marked = self.gold >= 0
        seen[marked, self.gold[marked]] = 1.0
        with np.errstate(invalid="ignore"):
            inside = np.arange(n)[None, :] < self.atoms[:, None]
            plain = np.exp(ahead[:, :-1, :, None] + t[None, None, :, :1] + behind[:, 1:, None, :1] - total[:, None, None, None])
            spans = np.exp(ahead[:, :-1, :, None] + t[None, None, :, 1:] + leave[:, :-1, None, :] - total[:, None, None, None])
        expected = np.nan_to_num(np.concatenate([plain, spans], 3) * inside[:, :, None, None]).sum((0, 1))
        return float((score * seen).sum() - total.sum()), self.x.T @ (seen - chance), expected


#: Forms of numbers that are nobody's, N for a digit; forms of numbers to call, and of cards.
NOBODYS = ("20NN-0N-1N", "20NN-0N-1N 1N:2N:3N", "20NN-0N-1NT1N:2N:3NZ", "1N/0N/20NN", "0N.1N.20NN", "ISBN 978-N-NN-NNNNNN-N", "ISBN N-NNNN-NNNN-N", "978NNNNNNNNNN", "version 1N.N.NN", "v2.NN.N-rc1", "1.NN.NNN.NNNN", "lat NN.NNNN lon NN.NNNN", "NN.NNNNN, 1N.NNNNN", "rows 1NNN 2NNN 3NNN", "NNNN NNNN NNNN", "order #NNNNNNNNNNNN", "id NNNNNNNNNNNNNNNN", "NN,NNN.NN", "pages NNN-NNN", "NNN-NN-NNNN", "commit 3faNNNb0cNNNde4f6NNNa7b8c9dNNN", "1NNN-2NNN", "N.NNe-1N", "NNNNNN items", "serial AB-NNNN-NNNN-CD", "10.NNNN/abc.20NN.NNN", "sku-NNNNNNN", "room NNN.NN")
CALLED = ("(NNN) NNN-NNNN", "NNN-NNN-NNNN", "NNN.NNN.NNNN", "NNN NNN NNNN", "0NN NNNN NNNN", "(0NN) NNNN NNNN")
SEPARATORS = (".", " ", "-", "")


def number(form: str, rng: random.Random) -> str:
    return "".join(str(rng.randrange(1, 10)) if c == "N" else c for c in form)


def card(rng: random.Random, separator: str) -> str:
    """Sixteen digits with the right check sum, in groups of four."""
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
    return separator.join(digits[i : i + 4] for i in range(0, 16, 4))


def secret(rng: random.Random) -> str:
    return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(rng.randrange(18, 40)))


def examples(text: str, rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """A text with its labels, and made-up variants at a random place of it: numbers to call and cards that the patterns don't know, secrets, and numbers that are nobody's."""
    gold = base_spans(text)
    taken = [(m.start(1), m.end(1), 4) for m in _SECRET.finditer(text)]
    gold = [g for g in gold if not any(g[0] < b and a < g[1] for a, b, _ in taken)] + taken
    yield text, gold
    words = text.split(" ")
    for what in ("nobody", "nobody", "nobody", "call", "card", "secret"):
        at = rng.randrange(len(words) + 1)
        before, after = " ".join(words[max(0, at - 4) : at]), " ".join(words[at : at + 4])
        if _SIGN.search(before) or _SIGN.search(after):
            continue
        if what == "nobody":
            new, kind, cue = number(rng.choice(NOBODYS), rng), None, ""
        elif what == "call":
            new, kind, cue = number(rng.choice(CALLED), rng), 3, rng.choice(("", "", "call ", "Tel: ", "phone "))
        elif what == "card":
            new, kind, cue = card(rng, rng.choice(SEPARATORS)), 2, rng.choice(("", "", "card ", "Visa: "))
        else:
            new, kind, cue = secret(rng), 4, rng.choice(("token = ", "api_key: ", "secret=", "password: ", "key is "))
        start = len(before) + 1 + len(cue)
        yield f"{before} {cue}{new}{rng.choice((' ', '. ', ', ', chr(10)))}{after}", [] if kind is None else [(start, start + len(new), kind)]


def fit(texts: Sequence[str], steps: int = 60, rate: float = 0.5, most: int = WINDOWS, seed: int = 5) -> Field:
    """A field by steps up the likelihood of the texts' examples, each weight by its own pace; the order of texts is kept and the seed fixed, so reruns agree."""
    rng = random.Random(seed)
    cases = Cases.of([x for text in texts for x in examples(text, rng)], most)
    field = Field.new()
    if not len(cases.atoms):
        return field
    # Windows of like lengths are summed together.
    parts = [part for low, high in ((0, 4), (4, 8), (8, 14), (14, ATOMS)) if len((part := cases.part(low, high)).atoms)]
    mean, square = [np.zeros_like(field.weights), np.zeros_like(field.turns)], [np.zeros_like(field.weights), np.zeros_like(field.turns)]
    for step in range(1, steps + 1):
        steps_up = [part.step(field) for part in parts]
        slopes = [sum(x[1] for x in steps_up), cases.seen_turns - sum(x[2] for x in steps_up)]
        for k, (w, g) in enumerate(zip((field.weights, field.turns), slopes, strict=True)):
            g = g - 0.3 * w  # a small pull to 0
            if k:
                g[0, 0] = 0.0
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    return field


def learn(docs: DataFrame, rows: int = TEXTS, chars: int = CHARS, most: int = WINDOWS) -> Field:
    """A field of up to ``rows`` texts that hold a digit or @ and are not longer than ``chars``, the first by a hash of doc_id, and of up to ``most`` of their windows."""
    marked = docs.filter(F.length("text") <= chars).filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    return fit([r["text"] for r in draw(marked, "pii", "doc_id", rows, ties=("text",)).collect()], most=most)


def found(texts: Sequence[str | None], field: Field, chars: int = 1 << 18) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and all spans by start and kind, of each text; the stretches of up to ``chars`` characters are looked at together."""
    held: list[tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]] = []
    size = 0

    def flush():
        spans = iter(added([p for _, pieces in held for p in pieces], field))
        for base, pieces in held:
            more = [s for _ in pieces for s in next(spans)]
            yield base, sorted({*base, *more}, key=lambda s: (s[0], s[2], s[1]))

    for text in texts:
        base = base_spans(text) if text and _SIGN.search(text) else []
        held.append((base, [(text, a, b) for a, b in windows(text, base)] if text else []))
        size += sum(b - a + 32 for _, a, b in held[-1][1])
        if size > chars:
            yield from flush()
            held, size = [], 0
    yield from flush()


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (patterns' spans), base_sha256, spans, n_added, redacted of every whole text of docs (doc_id, text).

    Offsets are code points, ends exclusive. A null text is empty: no spans, the digest of nothing, and
    a null ``redacted``. Rows that repeat are scanned each; an empty table gives an empty result; other
    columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                spans = list(found(texts, known))
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in spans], pa.int64()) for k in range(4)]
                sha = [hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in spans]
                hidden = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([spell(every) for _, every in spans], pa.string()), pa.array([len(every) - len(base) for base, every in spans], pa.int64()), pa.array(hidden, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs with personal data in ``text`` replaced by its kind, and ``n_chars`` (if there) by the new length.

    Null texts, and texts without such data, stay as they are; rows that repeat are treated each; an empty table gives an empty result; other columns come with the rows."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                given = part.column("text").to_pylist()
                texts = [None if t is None else redact(t, every) for t, (_, every) in zip(given, found(given, known), strict=True)]
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, learn(docs)).drop("redacted")
