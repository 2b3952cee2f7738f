"""License scans by patience alignment of each whole text with license templates.

Words that stand once in the window of the text and once in the template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned recursively (after
matching equal words at a gap's two ends). Coverage is the share of the template's words that are aligned.

A template can stand anywhere and more than once in a text. A match misses at most so many of the template's words as
the least coverage allows; so windows are laid round every place of one word more than that, those rarest in the
text, and any match holds one of them. Windows grow in steps up to the width that DENSITY allows, and the word that a
window is laid round is aligned with its place in the template. Of overlapping matches of one template the best is kept.
A text is skipped for a template only if the multiset of words that they share is too small to reach the least coverage.

Nulls: a null text has no license; null ids are kept; repeated rows are scanned alike. Ties of coverage go to the
template listed first, then to the earlier place. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Notices of public licenses, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
COVERAGE = 0.8
#: Share of the words between the first and the last aligned word that must be aligned.
DENSITY = 0.6

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]|*#"


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of the alignment, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: n for n, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = [(n, place[w]) for n, w in enumerate(a[i:j], i) if w in place and in_a[w] == 1]
        kept = increasing(anchors)
        for n, p in kept:
            todo.append((i, n, k, p))
            out.append((n, p))
            i, k = n + 1, p + 1
        if kept:
            todo.append((i, j, k, m))
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first) whose second grows."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, p) in enumerate(pairs):
        k = bisect_left(tails, p)
        tails[k : k + 1], at[k : k + 1] = [p], [n]
        before.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def words(text: str) -> list[str]:
    return [w.strip(_EDGE).lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY) -> None:
        self.templates = [(name, t, Counter(t)) for name, t in ((n, words(x)) for n, x in templates.items()) if t]
        self.coverage, self.density = coverage, density
        self.vocabulary = {w for _, t, _ in self.templates for w in t if w}

    def around(self, seq: list[str], t: list[str], p: int, at: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(aligned words, first word, word after the last) of matches that align word p with the template's word at."""
        span = int(len(t) / self.density) - 1  # words of a match besides p
        # words that must be aligned on one side leave less for the other
        before, after = span - max(0, least - 1 - at), span - max(0, least - len(t) + at)
        slack = 0
        while True:
            a, b = max(0, p - min(at + slack, before)), min(len(seq), p + 1 + min(len(t) - 1 - at + slack, after))
            # the left side reversed, so that both sides are matched outwards from p
            left = [(p - 1 - i, at - 1 - k) for i, k in patience(seq[a:p][::-1], t[:at][::-1])]
            right = [(p + 1 + i, at + 1 + k) for i, k in patience(seq[p + 1 : b], t[at + 1 :])]
            places = [i for i, _ in left] + [p] + [i for i, _ in right]
            n, first, last = len(places), min(places), max(places) + 1
            if n >= least and n >= self.density * (last - first):
                yield n, first, last
                if n == len(t):
                    return
            if (a == 0 or at + slack >= before) and (b == len(seq) or len(t) - 1 - at + slack >= after):
                return
            slack = 2 * slack + 1

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, word after the last) of each match, best first."""
        low = _WORD.findall(text.lower())
        vocabulary = self.vocabulary
        found: dict[str, list[int]] = {}
        for n, w in enumerate(low):
            if w in vocabulary or (w := w.strip(_EDGE)) in vocabulary:
                found.setdefault(w, []).append(n)
        if not found:
            return []
        out, seq = [], None
        for name, t, counted in self.templates:
            size = len(t)
            least = next(g for g in range(size + 1) if g / size >= self.coverage)
            if sum(min(len(found.get(w, ())), c) for w, c in counted.items()) < least:
                continue
            seq = seq or [w.strip(_EDGE) for w in low]
            # any match aligns one of these places of the template
            rare = sorted(range(size), key=lambda n: (len(found.get(t[n], ())), n))[: size - least + 1]
            got = {m for at in rare for p in found.get(t[at], ()) for m in self.around(seq, t, p, at, least)}
            kept: list[tuple[int, int, int]] = []
            for n, first, last in sorted(got, key=lambda m: (-m[0], m[2] - m[1], m[1])):
                if all(last <= a or b <= first for _, a, b in kept):
                    kept.append((n, first, last))
            out += [(name, n / size, first, last) for n, first, last in sorted(kept, key=lambda m: m[1])]
        rank = {n: i for i, (n, _, _) in enumerate(self.templates)}
        return sorted(out, key=lambda x: (-x[1], rank[x[0]], x[2]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license (the best match, or null), coverage, first_word, end_word and n_matches of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(templates, coverage)
        for b in batches:
            rows = []
            for t in b["text"]:
                got = s.scan(t) if isinstance(t, str) else []
                rows.append((*(got[0] if got else (None, None, None, None)), len(got)))
            out = pd.DataFrame(rows, columns=["license", "coverage", "first_word", "end_word", "n_matches"])
            out = out.astype({"first_word": "Int64", "end_word": "Int64"})
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    ident = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ident}, license string, coverage double, first_word long, end_word long, n_matches long")
