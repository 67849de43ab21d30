"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text and a template are normalised alike: lower case, copyright clauses dropped, spelling
variants joined, all but letters, digits and dots inside versions removed. The segments of a
text are its lines, its maximal runs of neighbouring lines that mostly hold template bigrams, the
whole text, and for each template the windows of words, across lines, whose sizes are within its
bounds (from its own length up for templates under SHORT bigrams, where a word left out may
name another licence). Of segments that overlap, the one with the best Dice counts. A segment of a bigrams and a template of b can reach a Dice of t only if
t / (2 - t) * a <= b <= (2 - t) / t * a; templates outside these bounds are never compared.

Templates are a fixed list or one given by the caller (driver-side, so bounded); documents are
read once, with no shuffle.

Defined results: null or word-free text has no licence (n_matches 0, nulls); ties of the best
Dice go to the smaller template name; repeated rows give a row each; no templates, no matches; an
empty table gives an empty result. Texts are compared whole whatever their length: a size bound leaves
out templates, never a part of a text. Of the columns only doc_id and text are read, so others may
have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.runs import first_occurrences
from ._util import table, text_only

# Public licence notices, as text. Names are SPDX identifiers.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # whole licence texts
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_COPYRIGHT = re.compile(r"(?m)^\W*(?i:copyright\b(?!\s+(?:notices?|holders?|owners?|laws?|and|or)\b)|©|\(c\)\s*\d{4}).*?(?:(?<![A-Z])[.;](?=\s+[A-Z])|$)(?:\s*(?i:all rights reserved)\b\.?)?")
_VARIANT = {"licence": "license", "licenced": "licensed", "licences": "licenses"}
DENSE = 0.5
SHORT = 12


def normalised(text: str) -> list[str]:
    return [_VARIANT.get(w, w) for w in _WORD.findall(_COPYRIGHT.sub("", text).lower())]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Templates:
    def __init__(self, templates, threshold: float):
        self.threshold = threshold
        self.all = [(name, bigrams(normalised(text))) for name, text in templates]
        self.lengths = [len(normalised(text)) - 1 for _, text in templates if bigrams(normalised(text))]
        self.all = [(n, b) for n, b in self.all if b]
        self.most = max((len(b) for _, b in self.all), default=0)
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.all):
            for g in b:
                self.holders.setdefault(g, []).append(i)
        self.vocabulary = {w for g in self.holders for w in g}

    def best(self, segment: set[tuple[str, str]]) -> tuple[float, str] | None:
        """The best template at or above the threshold; size bounds prune, then shared bigrams are counted."""
        t, a = self.threshold, len(segment)
        if t / (2 - t) * a > self.most:
            return None
        shared = Counter(i for g in segment for i in self.holders.get(g, ()))
        out = None
        for i, c in shared.items():
            name, b = self.all[i]
            if not t / (2 - t) * a <= len(b) <= (2 - t) / t * a:
                continue
            dice = 2 * c / (a + len(b))
            if dice >= t and (out is None or (-dice, name) < (-out[0], out[1])):
                out = (dice, name)
        return out

    def windows(self, grams: list[tuple[str, str]], distinct: set[tuple[str, str]]) -> list[tuple[float, str, int, int]]:
        """dice, name, first and last bigram: of every start, the best window for each template.

        Only bigrams that a start meets anew change a window's Dice, so from each start the first places of
        bigrams are walked, and no more of them than a template's bound allows: repeats cost nothing, and
        a text costs its length times the bound. Starts whose next bigrams are the same share their walk.
        """
        t, n, out = self.threshold, len(grams), []
        wanted = []
        for i, c in Counter(i for g in distinct & self.holders.keys() for i in self.holders[g]).items():
            name, b = self.all[i]
            low, high = t / (2 - t) * len(b), (2 - t) / t * len(b)
            if c >= low:  # so many must be shared to reach t at any size
                least = self.lengths[i] if len(b) < SHORT else 1
                wanted.append((name, b, low, high, least, {}))
        if not wanted:
            return out
        number: dict[tuple[str, str], int] = {}
        ids = array("i", [number.setdefault(g, len(number)) for g in grams])
        whole, wide = ids.tobytes(), ids.itemsize
        for k, after in first_occurrences(ids):
            for name, b, low, high, least, known in wanted:
                if (grams[k] not in b or k + least > n) and k != max(0, n - least):
                    continue
                reach = int(4 * high) + least
                key = None
                if n > 8 * reach and k + reach <= n:
                    key = hashlib.blake2b(whole[k * wide : (k + reach) * wide], digest_size=16).digest()
                    if key in known:
                        if known[key]:
                            out.append((known[key][0], name, k, k + known[key][1]))
                        continue
                seen = shared = 0
                best, z = None, k
                while z < n:
                    seen, shared = seen + 1, shared + (grams[z] in b)
                    if seen > high:
                        break
                    dice = 2 * shared / (seen + len(b))
                    # the shortest window with these bigrams that is long enough
                    end = max(z, k + min(least, n) - 1)
                    if dice >= t and seen >= low and (best is None or dice > best[0]) and (after[z] > end or after[z] == n) and end < n:
                        best = (dice, end - k)
                    if shared == len(b) and z >= k + least - 1:
                        break
                    z = after[z]
                if key is not None and z < k + reach:
                    known[key] = best
                if best:
                    out.append((best[0], name, k, k + best[1]))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Matches apart from each other as (first line, last line, name, dice)."""
        found, run, lines = [], [], text.split("\n")
        words = [normalised(x) for x in lines]
        whole = [x for w in words for x in w]
        if self.vocabulary.isdisjoint(whole):
            return []
        at = np.cumsum([0, *map(len, words)]).tolist()
        for k, w in enumerate([*words, []]):
            g = bigrams(w) if not self.vocabulary.isdisjoint(w) else set()
            if g and sum(x in self.holders for x in g) >= DENSE * len(g):
                if hit := self.best(g):
                    found.append((*hit, at[k], at[k + 1] - 1))
                run.append(k)
                continue
            if len(run) > 1:
                joined = [x for i in run for x in words[i]]
                if hit := self.best(bigrams(joined)):
                    found.append((*hit, at[run[0]], at[run[-1] + 1] - 1))
            run = []
        grams = list(zip(whole, whole[1:]))
        distinct = set(grams)
        if len(lines) > 1 and (hit := self.best(distinct)):
            found.append((*hit, 0, len(whole) - 1))
        found += [(d, name, a, z + 1) for d, name, a, z in self.windows(grams, distinct)]
        apart: list[tuple[int, int, str, float]] = []  # by first word; no two overlap
        for d, name, a, z in sorted(found, key=lambda m: (-m[0], m[2] - m[3], m[1], m[2])):
            at = bisect(apart, (z, len(whole)))
            if not at or apart[at - 1][1] < a:
                apart.insert(at, (a, z, name, d))
        line = [k for k, w in enumerate(words) for _ in w]
        return [(line[a], line[z], name, d) for a, z, name, d in apart]


SCHEMA = "doc_id long, n_matches long, license string, dice double, licenses array<string>, first_line int, last_line int"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per document: matches, the best licence with its Dice and lines, and all licences met."""
    fixed = tuple(templates)

    def scan(batches):
        known = Templates(fixed, threshold)
        for b in batches:
            rows = []
            for t in b.column("text"):
                found = known.scan(t.as_py()) if known.all else []
                top = min(found, key=lambda m: (-m[3], m[2], m[0], m[1]), default=None)
                rows.append((len(found), *((top[2], top[3]) if top else (None, None)), sorted({m[2] for m in found}), *((top[0], top[1]) if top else (None, None))))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.int32(), pa.int32())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_matches", "license", "dice", "licenses", "first_line", "last_line"])

    return text_only(docs).mapInArrow(scan, SCHEMA)


def op2_dice_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
