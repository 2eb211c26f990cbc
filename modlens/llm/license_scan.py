"""License scans by word alignment and conditional compression.

Each template is looked for anywhere in the words of a text, over line ends and blank lines and inside longer lines.
Word pairs propose places: a match lacks at most ``DIFFERENT`` of the template's words, so it must hold some number of
the template's pairs in a stretch of bounded length. There a word-level alignment finds for each end the stretch with
the fewest differences: words of the template that it lacks, and words that the template lacks, in order. Of
overlapping matches the one with the most words of its template less its differences stays; what lies between the
chosen ones is searched again. A match is then its whole lines if these still fit the template, else just its words.

The size reduction is by how much a block's compressed size falls with the template as a zstandard raw dictionary.

Edge cases: null and empty texts have no blocks; equal matches go to fewer differences, the larger size reduction, then
the name; repeated rows are scanned alike; a line may hold several blocks; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_blocks

# Wording of public license notices (without names, years and addresses).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
WORD = re.compile(r"[\w.+-]*\w")
# Share of a template's words that may differ.
DIFFERENT = 0.2
LEVEL = 9


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


_STEP = 1 << 40  # a difference; smaller parts of an alignment's cost hold where it starts


def aligned(template: np.ndarray, words: np.ndarray, most: int, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(differences, start, end) of the best stretch of words for each end, if it has at most ``most`` differences;
    of equal ones the shortest. edges[i]: a line begins at word i. Inside a line the template's first and last words
    may only be missing if the word in their place counts as added, so that another version is not cut off."""
    steps = np.arange(len(template) + 1, dtype=np.int64) * _STEP
    costs, out = steps + (0 if edges[0] else _STEP * (most + 1)), []
    costs[0] = 0
    for end, word in enumerate(words, 1):
        new = costs + _STEP
        new[0] = -end if edges[end] else _STEP - (end - 1)
        np.minimum(new[1:], np.where(template == word, costs[:-1], new[1:]), out=new[1:])
        last = new[-1]
        costs = np.minimum.accumulate(new - steps) + steps
        last = int(costs[-1] if edges[end] else last)
        costs[0] = -end
        n = -(-last // _STEP)
        if n <= most:
            out.append((n, n * _STEP - last, end))
    return out


class Scanner:
    def __init__(self, templates: Mapping[str, str]):
        self.words = {name: words_of(text) for name, text in templates.items()}
        self.words = {name: words for name, words in self.words.items() if words}
        self.number = {w: i for i, w in enumerate(sorted({w for t in self.words.values() for w in t}))}
        self.coded = {name: self.codes(words) for name, words in self.words.items()}
        self.allowed = {name: int(DIFFERENT * len(words)) for name, words in self.words.items()}
        self.pairs: dict[tuple[str, str], list[str]] = {}
        for name, words in self.words.items():
            for pair in set(zip(words, words[1:], strict=False)):
                self.pairs.setdefault(pair, []).append(name)
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(level=LEVEL, **plain)
        self.given = {}
        for name, words in self.words.items():
            content = " ".join(words).encode()
            content = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, **plain)

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; -1: in no template."""
        return np.array([self.number.get(w, -1) for w in words], dtype=np.int64)

    def reduction(self, name: str, words: list[str]) -> float:
        """Share by which the size falls with the template."""
        block = " ".join(words).encode()
        return 1 - len(self.given[name].compress(block)) / len(self.alone.compress(block))

    def differences(self, name: str, words: list[str]) -> list[str]:
        """Words of the template that are missing (-) and words that are added (+), as few as possible."""
        template = self.words[name]
        least = [list(range(len(words), -1, -1))]  # of what is left of both, the last template word first
        for i in range(len(template) - 1, -1, -1):
            row, below = [len(template) - i], least[-1]
            for j in range(len(words) - 1, -1, -1):
                same = template[i] == words[j]
                row.append(below[j + 1] if same else 1 + min(below[j], row[-1]))
            least.append(row[::-1])
        least.reverse()
        out, i, j = [], 0, 0
        while i < len(template) or j < len(words):
            if i < len(template) and j < len(words) and template[i] == words[j]:
                i, j = i + 1, j + 1
            elif i < len(template) and (j == len(words) or least[i + 1][j] <= least[i][j + 1]):
                out.append(f"-{template[i]}")
                i += 1
            else:
                out.append(f"+{words[j]}")
                j += 1
        return out

    def places(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(template, first word, end) of the stretches that can hold a match."""
        hits: dict[str, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            for name in self.pairs.get(pair, ()):
                hits.setdefault(name, []).append(i)
        out = []
        for name, template in self.words.items():
            most = self.allowed[name]
            longest = len(template) + most
            # A missing word takes two pairs of the template, an added one takes one.
            needed = len(template) - 1 - 2 * most
            if needed < 1:
                out.append((name, 0, len(words)))
                continue
            found, begin, end = hits.get(name, []), 0, 0
            for first, last in zip(found, found[needed - 1 :], strict=False):
                if last - first > longest - 2:
                    continue
                a, b = max(0, last + 2 - longest), min(len(words), first + longest)
                if a > end:
                    if end:
                        out.append((name, begin, end))
                    begin = a
                end = max(end, b)
            if end:
                out.append((name, begin, end))
        return out

    def matches(self, words: list[str], codes: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, str]]:
        """(first word, end, template) of the chosen matches, in order."""
        found = []
        for name, a, b in self.places(words):
            for n, start, end in aligned(self.coded[name], codes[a:b], self.allowed[name], edges[a : b + 1]):
                start, end = a + start, a + end
                found.append((n - len(self.words[name]), n, -self.reduction(name, words[start:end]), name, start, end))
        chosen: list[tuple[int, int, str]] = []
        for *_, name, start, end in sorted(found):
            if all(end <= a or start >= b for a, b, _ in chosen):
                chosen.append((start, end, name))
        if not chosen:
            return []
        chosen.sort()
        out, edge = [], 0
        for start, end, name in [*chosen, (len(words), len(words), "")]:
            between = self.matches(words[edge:start], codes[edge:start], edges[edge : start + 1])
            out += [(edge + a, edge + b, x) for a, b, x in between]
            if name:
                out.append((start, end, name))
            edge = end
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, list[str]]]:
        """(first line, last line, license, size reduction, differences) of every confirmed block."""
        if not text:
            return []
        lines = [words_of(line) for line in text.split("\n")]
        words = [w for line in lines for w in line]
        if not self.places(words):
            return []
        ends = np.cumsum([len(line) for line in lines])
        edges = np.zeros(len(words) + 1, dtype=bool)
        edges[0] = True
        edges[ends] = True
        found, out = self.matches(words, self.codes(words), edges), []
        for k, (start, end, name) in enumerate(found):
            a, b = (int(np.searchsorted(ends, x, side="right")) for x in (start, end - 1))
            low, high = int(ends[a]) - len(lines[a]), int(ends[b])
            alone = (k == 0 or found[k - 1][1] <= low) and (k + 1 == len(found) or found[k + 1][0] >= high)
            changed = None
            if alone and high - low <= len(self.words[name]) + self.allowed[name]:
                changed = self.differences(name, words[low:high])
            if changed is None or len(changed) > self.allowed[name]:
                low, high, changed = start, end, self.differences(name, words[start:end])
            out.append((a, b, name, self.reduction(name, words[low:high]), changed))
        return out


@cache
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, first_line, last_line, license, reduction, n_changed, exact, changes of every licensed block."""
    fixed = tuple((templates or TEMPLATES).items())
    names = ["doc_id", "first_line", "last_line", "license", "reduction", "n_changed", "exact", "changes"]
    kinds = [
        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.string())
    ]

    def run(batches):
        scanner = _scanner(fixed)
        for block in text_blocks(batches):
            rows = []
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                for first, last, name, fall, changed in scanner.scan(text):
                    rows.append((doc_id, first, last, name, round(fall, 6), len(changed), not changed, changed))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(slim).mapInArrow(
        run,
        "doc_id long, first_line long, last_line long, license string, reduction double, n_changed long, exact boolean, "
        "changes array<string>",
    )
