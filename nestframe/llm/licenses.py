"""Licence notices and whole licence texts by the Dice coefficient of word bigrams.

A text's lines and paragraphs are normalised and compared with templates. A template whose number of bigrams
lies outside the bounds that the threshold allows for a unit's size is not compared with it; of the rest, those that share enough bigrams
are reported.

Then all runs of consecutive words are compared, within lines and across lines and paragraphs, with these templates,
further notices and whole licence texts. What is between words, such as comment marks, does not count. A template is
looked for only in texts that have enough of its bigrams; from a start whose best run falls short by d, the
threshold t allows none at the next d / t starts, so few starts are tried and none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nestframe.llm.common import read

# Notices of public licences, by SPDX id.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Notices that are looked for in runs of words only.
NOTICES = (
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)

_WORD = re.compile(r"[^\W_]+")
#: Comment marks that are words.
_MARK = re.compile(r"^[^\S\n]*(?:dnl|rem)\b", re.MULTILINE)


@cache
def texts() -> tuple[tuple[str, str], ...]:
    """Whole licence texts by SPDX id, without the GNU licences' and Apache's appendices."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words: case, punctuation and spaces don't count, nor does the British spelling."""
    words = ["license" + w[7:] if w.startswith("licence") else w for w in _WORD.findall(text.lower())]
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float) -> None:
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(text) for _, text in templates]
        self.threshold = threshold
        # 2 |A & B| / (|A| + |B|) >= t allows |A| from |B| t / (2 - t) to |B| (2 - t) / t.
        self.bounds = [(len(s) * threshold / (2 - threshold), len(s) * (2 - threshold) / threshold) for s in self.sets]
        most = int(max((high for _, high in self.bounds), default=0))
        #: By a unit's number of bigrams, the templates within whose bounds it is.
        self.within = [[k for k, (low, high) in enumerate(self.bounds) if low <= n <= high] for n in range(most + 1)]

    def match(self, unit: str) -> tuple[str, float] | None:
        """The best template of a unit and its coefficient, ties to the name first by code point. Only templates whose bounds allow the unit's size are compared."""
        own = bigrams(unit)
        known = self.within[len(own)] if 0 < len(own) < len(self.within) else ()
        found = [(-2 * len(own & self.sets[k]) / (len(own) + len(self.sets[k])), self.names[k]) for k in known]
        best = min(found, default=(0.0, ""))
        return (best[1], -best[0]) if found and -best[0] >= self.threshold else None

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of the lines and paragraphs that match, in code points."""
        units = set()
        at = 0
        for line in text.split("\n"):
            bare = line.strip()
            if bare:
                start = at + line.index(bare)
                units.add((start, start + len(bare)))
            at += len(line) + 1
        if "\n" in text:
            start = None
            at = 0
            for line in [*text.split("\n"), ""]:
                bare = line.strip()
                if bare and start is None:
                    start = at + line.index(bare)
                if bare:
                    end = at + line.index(bare) + len(bare)
                elif start is not None:
                    units.add((start, end))
                    start = None
                at += len(line) + 1
        return [(a, b, *m) for a, b in sorted(units) if (m := self.match(text[a:b]))]


class Runs:
    """Runs of words that match a template."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float) -> None:
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        sets = [bigrams(text) for _, text in templates]
        self.sizes = np.array([len(s) for s in sets])
        self.ids = {w: i for i, w in enumerate(sorted({w for s in sets for b in s for w in b}))}
        self.codes = np.array(sorted({self.code(b) for s in sets for b in s}), np.int64)
        self.has = np.zeros((len(self.codes), len(sets)), bool)
        for k, s in enumerate(sets):
            self.has[np.searchsorted(self.codes, sorted(map(self.code, s))), k] = True

    def code(self, bigram: tuple[str, str]) -> int:
        return self.ids[bigram[0]] * len(self.ids) + self.ids[bigram[1]]

    def candidates(self, text: str) -> tuple[str, list[str], np.ndarray, np.ndarray]:
        """The lower text, its words, each pair's place in ``codes`` or -1, and the templates of which the text has enough bigrams."""
        low = text.lower()
        if "dnl" in low or "rem" in low:
            low = _MARK.sub(lambda m: " " * len(m[0]), low)
        words = _WORD.findall(low)
        if "licence" in low:
            words = ["license" + w[7:] if w.startswith("licence") else w for w in words]
        own = np.array([self.ids.get(w, -1) for w in words], np.int64)
        pair = np.where((own[:-1] < 0) | (own[1:] < 0), -1, own[:-1] * len(self.ids) + own[1:])
        place = np.full(len(pair), -1)
        known = np.flatnonzero(pair >= 0)
        if len(known) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, pair[known]), len(self.codes) - 1)
            place[known] = np.where(self.codes[at] == pair[known], at, -1)
        shared = self.has[np.unique(place[place >= 0])].sum(axis=0)
        return low, words, place, np.flatnonzero((shared > 0) & (shared + 1e-9 >= self.sizes * self.threshold / (2 - self.threshold)))

    def best(self, k: int, hit: np.ndarray, before: np.ndarray) -> Iterator[tuple[float, int, int, int, int]]:
        """(coefficient, first and last pair, shared, distinct pairs) of the best run from each start with a run that matches.

        ``hit``: which pairs the template has; ``before``: where each pair came last. A best run starts and ends at a pair of the template's; of equal ones the longest is given.
        """
        n, t = int(self.sizes[k]), self.threshold
        starts = np.flatnonzero(hit)
        far = 3 * n
        x = 0
        while x < len(starts):
            i = int(starts[x])
            length = far + 1
            while True:
                fresh = before[i : i + length] < i
                distinct = np.cumsum(fresh)
                if distinct[-1] > far or i + length >= len(hit):
                    break
                length *= 2
            shared = np.cumsum(fresh & hit[i : i + length])
            dice = 2 * shared / (distinct + n)
            j = int(np.flatnonzero((dice == dice.max()) & hit[i : i + length])[-1])
            if dice[j] >= t:
                yield float(dice[j]), i, i + j, int(shared[j]), int(distinct[j])
                x += 1
            else:
                # Longer runs have more than ``far`` pairs, of which the template has n at most.
                short = -max(float(np.max(2 * shared - t * (distinct + n))), 2 * n - t * (far + n))
                x = max(x + 1, int(np.searchsorted(starts, i + int(short / t - 1e-6))))

    def scan(self, text: str, candidates: tuple[str, list[str], np.ndarray, np.ndarray], units: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """The runs of a text to report beside its ``units``.

        Of runs that overlap and whose sizes the bounds allow for one template the best is reported, ties to more shared
        pairs, the name first by code point, and the longer run; a unit goes before a run that is no better or of its licence. A run
        within a longer one or a unit is not reported if that is of its licence or its template has all of the run's pairs.
        """
        low, words, place, found = candidates
        if not len(found):
            return []
        numbers: dict[str, int] = {}
        own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        pair = own[:-1] * len(numbers) + own[1:]
        order = np.argsort(pair, kind="stable")
        before = np.full(len(pair), -1)
        again = pair[order[1:]] == pair[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        runs = [(-d, -s, self.names[k], i - j, i, j, w, int(k)) for k in found for d, i, j, s, w in self.best(k, (place >= 0) & self.has[place, k], before)]
        if not runs:
            return []
        places = [m.span() for m in _WORD.finditer(low)]
        if len(low) != len(text):
            back = [i for i, c in enumerate(text) for _ in c.lower()]
            places = [(back[a], back[b - 1] + 1) for a, b in places]
        wide = ((2 - self.threshold) / self.threshold) ** 2
        taken = [(a, b, name, dice, len(bigrams(text[a:b])), -1) for a, b, name, dice in units]
        kept = []
        for less, _, name, _, i, j, w, k in sorted(runs):
            a, b = places[i][0], places[j + 1][1]
            if not any(a < e and s < b and w <= v * wide and v <= w * wide and (m >= 0 or dice >= -less or name == other) for s, e, other, dice, v, m in taken):
                taken.append((a, b, name, -less, w, k))
                kept.append((a, b, name, -less, place[i : j + 1]))

        def told(a: int, b: int, name: str, own: np.ndarray) -> bool:
            return any(s <= a and b <= e and (s, e) != (a, b) and (name == other or m >= 0 and bool(np.all((own >= 0) & self.has[own, m]))) for s, e, other, _, _, m in taken)

        return [(a, b, name, dice) for a, b, name, dice, own in kept if not told(a, b, name, own)]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, more: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, start, end, license, dice: a row for each line or paragraph of docs (doc_id, text) that matches a template, and for each other run of words that matches one of these or of ``more`` (``NOTICES`` and ``texts()``).

    Offsets are code points, ends exclusive; a paragraph ends at a blank line. The best template of a unit is given; ``Runs.scan`` states which runs are. Null and
    empty texts, and units of one word, match nothing. Rows that repeat are scanned each; an empty table
    gives an empty result; other columns are not looked at.
    """

    every = (*templates, *(NOTICES + texts() if more is None else more))

    def search(own: Scanner, runs: Runs, text: str) -> list[tuple[int, int, str, float]]:
        candidates = runs.candidates(text)
        # A line or paragraph has no pair that its text hasn't.
        units = own.scan(text) if np.any(candidates[3] < len(templates)) else []
        return sorted(units + runs.scan(text, candidates, units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, runs = Scanner(templates, threshold), Runs(every, threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, found = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for m in search(own, runs, text) if text else ():
                        rows.append(i)
                        found.append(m)
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True))], names=["doc_id", "start", "end", "license", "dice"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, end long, license string, dice double")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
