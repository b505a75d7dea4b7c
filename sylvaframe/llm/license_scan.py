"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

A text is compared whole, by line, by sentence and by windows of consecutive lines and sentences, so notices and license texts that are wrapped match too. With a units' and b template's distinct bigrams, the Dice coefficient 2 |A and B| / (a + b) can
reach t only if t / (2 - t) <= a / b <= (2 - t) / t; these size bounds leave few templates for a unit.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8
#: Notices and texts of public licenses, by SPDX identifier; a parameter of scan().
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    """The file notice of a GNU license."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole texts of short licenses and the file notices of long ones; beside the templates, the SQL twin has only those.
FULL_TEXTS: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0": (_gnu("Affero General Public License", "3"),),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL,),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, _BSD_HEAD + _BSD_THIRD),
    "GPL-2.0": (_gnu("General Public License", "2"),),
    "GPL-3.0": (_gnu("General Public License", "3"),),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (_gnu("Lesser General Public License", "3"),),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS
        + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _AS_IS
        + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to <https://unlicense.org>",
    ),
}
_OTHER = re.compile(r"[^a-z0-9\n]+")
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+")


def bigrams(text: str) -> set[str]:
    """Distinct bigrams of the lower-case words of ASCII letters and digits."""
    words = _OTHER.sub(" ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _numbered(grams: set[str]) -> dict[str, set[str]]:
    """Left word -> numbers that follow it."""
    out: dict[str, set[str]] = {}
    for g in grams:
        a, b = g.split(" ")
        if b.isdigit():
            out.setdefault(a, set()).add(b)
    return out


def contradicts(own: set[str], numbers: dict[str, set[str]]) -> bool:
    """Whether a unit has another number than the template after one of its words, such as another version."""
    if not numbers:
        return False
    found = _numbered(own)
    return any(a in found and not found[a] & n for a, n in numbers.items())


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]], least: float) -> None:
        self.least = least
        self.known = sorted(((len(b), name, b) for name, texts in templates.items() for t in texts if (b := bigrams(t))), key=lambda x: x[:2])
        self.sizes = [n for n, _, _ in self.known]
        self.numbers = [_numbered(b) for _, _, b in self.known]
        self.first = {x for _, _, b in self.known for x in b}
        #: A unit has at least this share of a template's bigrams, and a template of a unit's.
        self.share = least / (2 - least)

    def best(self, own: set[str]) -> tuple[float, str] | None:
        """Best (score, name) of a unit's bigrams of at least the least score; ties go to the smaller name."""
        a = len(own)
        hits = own & self.first
        if not hits or len(hits) < a * self.share - 1e-9:
            return None
        found = None
        lo = bisect_left(self.sizes, a * self.share - 1e-9)
        for i in range(lo, bisect_right(self.sizes, a / self.share + 1e-9)):
            b, name, grams = self.known[i]
            score = 2 * len(hits & grams) / (a + b)
            if score >= self.least and (found is None or (-score, name) < (-found[0], found[1])) and not contradicts(own, self.numbers[i]):
                found = score, name
        return found

    def windows(self, grams: list[str], starts: list[int]) -> list[tuple[float, int, str, int, int]]:
        """Best (score, shared bigrams, name, first, last) windows of two lines or sentences or more without overlap; line or sentence k has the words from starts[k] on.

        The best window of a template begins with a line that shares a bigram with it; once later lines repeat all that its first
        line shares, the window without that line is no worse. So a template takes time in proportion to the text.
        """
        hits = self.first.intersection(grams)
        found = []
        for (b, name, known), numbers in zip(self.known, self.numbers, strict=True):
            most = len(hits & known)
            if most < b * self.share - 1e-9:
                continue
            places: dict[int, set[str]] = {}  # line -> shared bigrams that begin in it
            line = 0
            for at, x in enumerate(grams):
                while line + 1 < len(starts) - 1 and starts[line + 1] <= at:
                    line += 1
                if x in known:
                    places.setdefault(line, set()).add(x)
            for i in places:
                own, later, shared = set(), set(), 0
                for j in range(i, len(starts) - 1):
                    # the bigram that leads into a line joins with that line
                    new = set(grams[max(starts[i], starts[j] - 1) : starts[j + 1] - 1]) - own
                    own |= new
                    shared += len(new & known)
                    if len(own) > b / self.share + 1e-9:
                        break
                    score = 2 * shared / (len(own) + b)
                    if j > i and score >= self.least and not contradicts(own, numbers):
                        found.append((score, shared, name, i, j))
                    later |= places.get(j, set()) if j > i else set()
                    if shared == most or places[i] <= later:
                        break
        chosen: list[tuple[float, int, str, int, int]] = []
        for w in sorted(found, key=lambda w: (-w[0], -w[1], w[2:])):
            if all(w[4] < c[3] or w[3] > c[4] for c in chosen):
                chosen.append(w)
        return sorted(chosen, key=lambda w: w[3])

    def scan(self, text: str | None) -> list[tuple[str, str, float]]:
        """(license, unit, score) of each line, sentence, or window of lines and sentences that matches; the whole text if nothing else does.

        A sentence counts beside its line if its license is another one. A window takes the place of the units in it if it scores more
        than each, or as much with more bigrams.
        """
        text = text or ""
        lines = text.split("\n")
        pieces: list[tuple[int, str]] = []  # line, sentence
        for k, line in enumerate(lines):
            pieces += [(k, p) for p in _SENTENCE.split(line)]
        words: list[str] = []
        starts = []
        for _, piece in pieces:
            starts.append(len(words))
            words += _OTHER.sub(" ", piece.lower()).split()
        starts.append(len(words))
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        of = lambda a, b: set(grams[starts[a] : max(starts[a], starts[b] - 1)])
        units: list[tuple[int, int, str, str, float, int]] = []  # first and last piece, license, unit, score, bigrams
        at = 0
        for k, line in enumerate(lines):
            end = at
            while end < len(pieces) and pieces[end][0] == k:
                end += 1
            own = of(at, end)
            hit = self.best(own)
            if hit:
                units.append((at, end - 1, hit[1], line, hit[0], len(own)))
            if end > at + 1 and not self.first.isdisjoint(own):
                for i in range(at, end):
                    if (h := self.best(g := of(i, i + 1))) and (not hit or h[1] != hit[1]):
                        units.append((i, i, h[1], pieces[i][1], h[0], len(g)))
            at = end
        filled = [i for i in range(len(pieces)) if starts[i] < starts[i + 1]]
        for score, shared, name, a, b in self.windows(grams, [starts[i] for i in filled] + starts[-1:]) if len(filled) > 1 else ():
            first, last = filled[a], filled[b]
            inside = [u for u in units if u[0] <= last and u[1] >= first]
            if all((score, shared) > (u[4], u[5]) for u in inside):
                by_line = itertools.groupby(pieces[first : last + 1], key=lambda p: p[0])
                whole = "\n".join(" ".join(p for _, p in ps) for _, ps in by_line)
                units = [u for u in units if u not in inside] + [(first, last, name, whole, score, shared)]
        out = [u[2:5] for u in sorted(units, key=lambda u: (u[0], -u[1]))]
        if not out and "\n" in text and (hit := self.best(set(grams))):
            out.append((hit[1], text, hit[0]))
        return out


def scan(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = MIN_DICE, id_col: str = "doc_id", text_col: str = "text", full_texts: Mapping[str, tuple[str, ...]] = FULL_TEXTS
) -> DataFrame:
    """(doc_id, n_matches, best_license, best_score, matches array<struct<license, text, score>>): one row per row of docs.

    Null and empty texts match nothing: 0, null, null and an empty array; of equal scores the smaller license name is best; repeated rows give
    repeated rows, an empty table an empty result. Other columns are ignored.
    """
    kinds = pa.list_(pa.struct([("license", pa.string()), ("text", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner({n: (*templates.get(n, ()), *full_texts.get(n, ())) for n in {**templates, **full_texts}}, least)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            best = [min(((-s, n) for n, _, s in r), default=(None, None)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([b[1] for b in best], pa.string()),
                    pa.array([None if b[0] is None else -b[0] for b in best], pa.float64()),
                    pa.array([[{"license": n, "text": t, "score": s} for n, t, s in r] for r in rows], kinds),
                ],
                names=["doc_id", "n_matches", "best_license", "best_score", "matches"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_matches long, best_license string, best_score double, matches array<struct<license: string, text: string, score: double>>")
