"""Licence scans by patience alignment.

Texts and templates become words (letters and digits, lower-case). A template is aligned
with a part of the text: words that occur once in both are anchors, the longest increasing
subsequence of them is kept, and the gaps between kept anchors are aligned again, after
equal words at their ends are matched. Coverage is the share of the template's words that
are matched.

The words that say which licence it is (its name and version) must be matched whole and in
one piece, so a notice of another licence in the same wording isn't taken for this one.

The words that say which licence it is (its name and version) must be matched whole and in
one piece, so a notice of another licence in the same wording isn't taken for this one.

The parts are windows around each occurrence of the template words that are rarest in the
text, so long texts cost no more than their length. The occurrence is an anchor itself. The
parts on its two sides first end about where the template does, then where the same word
stands again, so a notice that stands twice is found however near the copies are; only if
that covers too little do they reach further. A part may be longer than another only if
a tenth of the words it takes in are matched. A text is only aligned with templates that its set of words could cover.

Null texts and texts without words have no licences; repeated rows are scanned each. Very
long texts are one row of work. Empty tables give no rows. Nothing crosses rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, ids_and_texts, prepare

_WORD = re.compile(r"[^\W_]+")

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU %sGeneral Public License} as published by the Free Software Foundation, either {version %s} of the License, or (at your option) any later version."

#: Public notices, as their licences word them; a name may have several. Words in braces say which licence it is: a place
#: must have them all, one after the other.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "MIT-notice": ("Released under the {MIT License}.", "Licensed under the {MIT License}."),
    "BSD-notice": ("Released under the {BSD License}.", "Licensed under the {BSD License}."),
    "BSD-2-Clause-notice": "Licensed under the {BSD 2-Clause} License.",
    "BSD-3-Clause-notice": "Licensed under the {BSD 3-Clause} License.",
    "ISC-notice": "Licensed under the {ISC License}.",
    "Apache-notice": ("Released under the {Apache License}.", "Licensed under the {Apache License}."),
    "Apache-2.0-notice": ("Licensed under the {Apache License, Version 2.0}.", "Licensed under the {Apache License 2.0}."),
    "MPL-2.0-notice": "Licensed under the {Mozilla Public License}, {version 2.0}.",
    **{
        f"{n}-{v}.0-notice": f"This work is licensed under the {{GNU {w}General Public License}}, {{version {v}}}."
        for n, w, vs in (("GPL", "", (1, 2, 3)), ("LGPL", "Lesser ", (2, 3)), ("AGPL", "Affero ", (3,)))
        for v in vs
    },
    **{
        f"CC-{k}-{v}-notice": f"Licensed under {{CC {k} {v}}}."
        for v in ("2.0", "3.0", "4.0")
        for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    },
    **{
        f"CC-{k}-{v}": f"This work is licensed under a {{Creative Commons {n} {v} {area}}} License."
        for v, area in (("3.0", "Unported"), ("4.0", "International"))
        for k, n in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
    "CC0-1.0-notice": "Released under {CC0 1.0}.",
    "Apache-2.0-header": """Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": (_BSD, f"{_BSD} {_AS_IS}"),
    "BSD-3-Clause": (
        f"{_BSD} 3. {{Neither the name}} of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        f"{_BSD} 3. {{Neither the name}} of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the {public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Distributed under the {Boost Software License, Version 1.0}. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    **{
        f"{n}-{v if '.' in v else v + '.0'}-or-later": _GPL % (w, v)
        for n, w, vs in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",)))
        for v in vs
    },
    "MPL-2.0": "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "{All rights reserved}.",
}


@dataclass(frozen=True)
class Template:
    """A notice's words, and the places (start, length) of the phrases that name the licence."""

    name: str
    words: list[str]
    phrases: list[tuple[int, int]]


def templates_of(texts: dict[str, str | tuple[str, ...]]) -> list[Template]:
    """All notices that have words; phrases in braces."""
    out = []
    for name, variants in texts.items():
        for text in (variants,) if isinstance(variants, str) else variants:
            words, phrases = [], []
            for i, part in enumerate(re.split(r"[{}]", text)):
                own = words_of(part)
                if i % 2 and own:
                    phrases.append((len(words), len(own)))
                words += own
            if words:
                out.append(Template(name, words, phrases))
    return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops, piles, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], head: bool = True, tail: bool = True) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising in both. head, tail: whether both start, or end, at the same place, so that equal words there belong together."""
    out, todo = [], [(0, len(a), 0, len(b), head, tail)]
    while todo:
        a0, a1, b0, b1, head, tail = todo.pop()
        while head and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while tail and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        pairs = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
        kept = [pairs[k] for k in _increasing([j for _, j in pairs])]
        if not kept:
            continue
        out += kept
        i0, j0 = a0, b0
        for i, j in [*kept, (a1, b1)]:
            if i > i0 and j > j0:
                todo.append((i0, i, j0, j, head or i0 > a0, tail or i < a1))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _around(words: list[str], t: Template, p: int, j: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Matched words, first word and past the last word of the template when words[p] is its word j and nothing outside low to high is; None without its phrases."""
    left = align(words[low:p], t.words[:j], head=False)
    right = align(words[p + 1 : high], t.words[j + 1 :], tail=False)
    if t.phrases:
        at = {y: low + x for x, y in left} | {j: p} | {j + 1 + y: p + 1 + x for x, y in right}
        for first, n in t.phrases:
            if first not in at or any(at.get(first + k) != at[first] + k for k in range(1, n)):
                return None
    return 1 + len(left) + len(right), low + left[0][0] if left else p, p + 2 + right[-1][0] if right else p + 1


def _places(words: list[str], t: Template, need: float, own: set[str]) -> list[tuple[int, int, int]]:
    """(matched words, first word, past the last word) of each place where at least need words of the template are matched, one of own among them."""
    size = len(t.words)
    reach, spread, share = 2 * size, 2 + size // 8, Counter(t.words)
    spots = {w: [j for j, x in enumerate(t.words) if x == w] for w in own}
    at = {w: [] for w in own}
    order = []
    for i, w in enumerate(words):
        if w in own:
            order.append((i, len(at[w])))
            at[w].append(i)

    def score(hit):
        return 10 * hit[0] - hit[2] + hit[1]

    def best(p: int, k: int, start: int, end: int):
        """The best place that words[p], the k-th of its kind, is matched in."""
        a, b = max(start, p - reach), min(end, p + 1 + reach)
        near = Counter(w for w in words[a:b] if w in share)
        if sum(min(n, share[w]) for w, n in near.items()) < need:
            return None
        close, far = [], []
        same, places = at[words[p]], spots[words[p]]
        for r, j in enumerate(places):  # words[p] as the template's r-th such word: those of other copies bound it
            i, m = k - r - 1, k - r + len(places)
            low, high = max(a, same[i] + 1) if i >= 0 else a, min(b, same[m]) if m < len(same) else b
            close += [(j, max(low, p - j - spread), min(high, p + size - j + spread)), (j, low, high)]
            far.append((j, a, b))
        for tries in (close, far):
            hits = [h for h in (_around(words, t, p, *x) for x in tries) if h and h[0] >= need]
            if hits:
                return max(hits, key=score)
        return None

    out, done = [], 0
    for q, (p, k) in enumerate(order):
        if p < done or not (hit := best(p, k, done, len(words))):
            continue
        # words[p] may stand before the notice by chance, or the place run into the next one: the best around any word in it counts.
        top, past = hit, hit[2]
        for x in range(q + 1, len(order)):
            if order[x][0] >= past or score(top) == 9 * size:
                break
            if (other := best(*order[x], done, len(words))) and score(other) > score(top):
                top = other
        if p < top[1] and (hit := best(p, k, done, top[1])):
            out.append(hit)
        out.append(top)
        done = top[2]
    return out


def matches(words: list[str], templates: list[Template], coverage: float) -> list[tuple[str, int, float, int, int]]:
    """(name, matched words, coverage, first word, past the last word) of each place where a notice is covered; of places that overlap, the one with more matched words stays, then the better covered, then the first, then the shorter."""
    if not words:
        return []
    counts = None
    different = set(words)
    found = []
    for t in templates:
        need = coverage * len(t.words)
        if any(w not in different for a, n in t.phrases for w in t.words[a : a + n]) or sum(w in different for w in t.words) < need:
            continue
        counts = counts or Counter(words)
        share = Counter(t.words)
        if t.phrases:  # one word is enough where each place must have it
            own = {min((w for a, n in t.phrases for w in t.words[a : a + n]), key=lambda w: (counts[w], share[w], w))}
        else:
            # Rarest words first; enough of them that a part with this coverage must hold one.
            by = sorted((w for w in share if w in different), key=lambda w: (counts[w], w))
            own, spare = set(), len(t.words) - need
            gone = sum(k for w, k in share.items() if w not in different)
            for w in by:
                own.add(w)
                gone += share[w]
                if gone > spare:
                    break
        found += [(n, t.name, n / len(t.words), first, past) for n, first, past in _places(words, t, need, own)]
    out = []  # by first word; none overlap
    for n, name, share, a, b in sorted(found, key=lambda x: (-x[0], -x[2], x[3], x[4], x[1])):
        i = bisect_left(out, a, key=lambda x: x[3])
        if (i == 0 or out[i - 1][4] <= a) and (i == len(out) or b <= out[i][3]):
            out.insert(i, (name, n, share, a, b))
    return out


OUT = "doc_id long, n_words long, licenses array<struct<license:string,matched:long,coverage:double,first_word:long,past_word:long,start:long,end:long>>"
_HIT = pa.struct(
    [
        ("license", pa.string()),
        ("matched", pa.int64()),
        ("coverage", pa.float64()),
        ("first_word", pa.int64()),
        ("past_word", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("licenses", pa.list_(_HIT))])


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str | tuple[str, ...]] | None = None,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its words and the licence notices in it, with offsets in characters."""
    prepare(docs.sparkSession)
    wanted = templates_of(templates or TEMPLATES)

    def run(batches):
        for batch in batches:
            n, found = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n.append(len(words))
                hits = matches(words, wanted, coverage)
                if hits and len(text.lower()) == len(text):
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                elif hits:  # lower-casing changed lengths: map each character
                    spans, back = [], [i for i, c in enumerate(text) for _ in c.lower()]
                    spans = [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer("".join(c.lower() for c in text))]
                found.append(
                    [
                        {
                            "license": k,
                            "matched": m,
                            "coverage": c,
                            "first_word": a,
                            "past_word": b,
                            "start": spans[a][0],
                            "end": spans[b - 1][1],
                        }
                        for k, m, c, a, b in hits
                    ]
                )
            yield batch_of(_ARROW, [batch.column(0), n, found])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, OUT)
