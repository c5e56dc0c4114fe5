"""License texts and notices inside documents, by patience alignment of words against templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license texts and usual notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "notice: MIT": "Released under the MIT License.",
    "notice: Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice: GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice: CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice: CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "notice: CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice: all rights reserved": "All rights reserved.",
}

#: Templates that a table may give.
MOST_TEMPLATES = 10_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first, that rises in the second."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            last.append(i)
        else:
            tails[at], last[at] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both: words unique to both as anchors, the longest increasing run of them, then
    the same in the gaps between; equal words at both ends of a gap match first."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: y for y, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = _increasing([(x, place[w]) for x, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        x, y = i, k
        for p, q in [*anchors, (j, m)]:
            if p > x and q > y:
                gaps.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


class Scanner:
    """Finds every stretch of a text that covers a template well enough."""

    def __init__(self, templates: dict[str, str], coverage: float, stretch: float):
        self.coverage, self.stretch = coverage, stretch
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(w) for name, w in self.templates.items()}
        self.vocabulary = set().union(*self.templates.values()) if templates else set()
        #: Distinct words of a template that a text must have: what it may lack is lost with one word each at least.
        self.needed = {name: len(c) - (len(self.templates[name]) - math.ceil(coverage * len(self.templates[name]))) for name, c in self.counts.items()}

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(template, matched words, template words, first character, end) of each find, in text order."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        there = self.vocabulary.intersection(words)
        if not there:
            return []
        found: list[tuple[int, int, int, str, int]] = []
        for name, template in self.templates.items():
            if len(there.intersection(self.counts[name])) >= self.needed[name]:
                found += [(n, first, end, name, len(template)) for n, first, end in self._finds(words, template, self.counts[name])]
        # Of finds that share words the one with the most matched words stays.
        out: list[tuple[int, int, int, str, int]] = []
        for f in sorted(found, key=lambda f: (-f[0], f[4], f[1], f[3])):
            if all(f[2] <= g[1] or g[2] <= f[1] for g in out):
                out.append(f)
        return [(name, n, size, spans[first][0], spans[end - 1][1]) for n, first, end, name, size in sorted(out, key=lambda f: f[1])]

    def _finds(self, words: list[str], template: list[str], counts: Counter) -> Iterator[tuple[int, int, int]]:
        hits = [i for i, w in enumerate(words) if w in counts]
        need, reach = math.ceil(self.coverage * len(template)), math.ceil(self.stretch * len(template))
        at = 0
        while at < len(hits):
            first = hits[at]
            # A find that begins here takes its words from the next `reach` words.
            last = bisect_left(hits, first + reach, at)
            if last - at < need or sum((counts & Counter(words[i] for i in hits[at:last])).values()) < need:
                at += 1
                continue
            best = patience(words[first : first + reach], template)
            if len(best) >= need:
                best = _tight(best, need)
                yield len(best), first + best[0][0], first + best[-1][0] + 1
                at = bisect_left(hits, first + best[-1][0] + 1, at)
            else:
                at += 1


def _tight(pairs: list[tuple[int, int]], need: int) -> list[tuple[int, int]]:
    """Without stray matches at either end: those across a gap in the text that is longer than the words they add."""
    while len(pairs) > need and pairs[1][0] - pairs[0][0] > 8:
        pairs = pairs[1:]
    while len(pairs) > need and pairs[-1][0] - pairs[-2][0] > 8:
        pairs = pairs[:-1]
    return pairs


FINDS = "license string, n_matched long, n_template long, coverage double, start_char long, end_char long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, coverage: float = 0.85, stretch: float = 1.4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every license text or notice in every whole document: key and FINDS, a row for each find (none: no row).

    Words are runs of letters and digits, lower-cased. A find matches at least `coverage` of a template's words in order, inside
    a stretch of `stretch` times its length. Of finds that share words of the text the one with the most matched words
    stays. Null and empty texts have no finds. Repeated rows each give theirs. An empty table gives an empty
    result. Each document is read once, on its own: no shuffle.

    templates: the texts by name, or a table of name and text (MOST_TEMPLATES rows at most, as every task holds them all); rows without a word find
    nothing.
    """
    if isinstance(templates, DataFrame):
        given = templates.select("name", "text").limit(MOST_TEMPLATES + 1).collect()
        if len(given) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = {r.name: r.text or "" for r in given}
    templates = TEMPLATES if templates is None else {n: t for n, t in templates.items() if words_of(t)}
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, stretch)
        for b in batches:
            rows, finds = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for f in scanner.scan(t) if t else ():
                    rows.append(i)
                    finds.append(f)
            keys = b.column(0).take(pa.array(rows, pa.int64()))
            name, n, size, start, end = ([f[j] for f in finds] for j in range(5))
            columns = [keys, pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array([x / y for x, y in zip(n, size)], pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", *(x.split()[0] for x in FINDS.split(", "))])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, {FINDS}").withColumnRenamed("k", key)
