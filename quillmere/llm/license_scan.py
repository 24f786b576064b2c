"""Licence notices in documents: MinHash bands over overlapping windows find
templates, exact shingle containment verifies them.

Terms are lower-cased words without signs at their ends, shingles are ``SIZE``
terms in a row.  A template of L shingles belongs to the class of the next
power of two c >= L; windows of that class are 2c shingles long and c apart, so
wherever a template stands, it lies whole in some window.  Then at least a
quarter of the shingles of window and template together are shared (with a
containment of ``CONTAINED``, at least 0.19), and of ``BANDS`` bands of one
MinHash row each at least one collides with probability 1 - 0.81**32 > 0.998;
1 - 0.75**32 > 0.9998 for whole copies.  A window's MinHash is the smaller of
those of its two halves, and a half's the smaller of those of the next class
below, so all classes cost little more than one.

Templates of different licences that share half of their shingles or more are
rivals, such as the versions of one licence.  Where both are found, the one of
whose own shingles (those the other lacks) the larger share is there stays;
none stays that shows nothing of its own, and both stay if they show as much.

Templates are a parameter of at most ``TEMPLATE_BYTES``, sent to the tasks; the
documents are scanned once, without a shuffle.

Defined cases: null and empty texts hold nothing; a template of fewer than
``SIZE`` terms is one shingle of all its terms and windows of that many terms
are compared with it; a template without terms never matches; the same template
found often in a text gives one row, with the best containment and its first
place; rows with equal ids are documents of their own; other columns are not
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.decontamination import _terms
from quillmere.llm.words import pieces, windows

SIZE = 5
CONTAINED = 0.8
BANDS = 32
TEMPLATE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15

# Wordings of common public licence notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
     " compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is'
     ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
     " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
     " permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
     " any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
     " provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

_GPL = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation"
_BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
              " following conditions are met: ")
_BSD_TWO = ("{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
            " disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
            " and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
             " derived from this software without specific prior written permission. ")
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
            " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
            " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
            " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
            " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
            " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
            " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_END = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
            " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {0} BE"
            " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
            " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU = {
    "GPL": ("General Public License", "program", ("1", "2", "3")), "AGPL": ("Affero General Public License", "program", ("1", "3")),
    "LGPL": ("Lesser General Public License", "library", ("2.1", "3")),
}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _further() -> list[tuple[str, str]]:
    """Notices, key paragraphs and SPDX lines of further licences and versions."""
    out = []
    for kind, (long, what, versions) in _GNU.items():
        for v in versions:
            name = f"{kind}-{v if '.' in v else v + '.0'}"
            # the program and the library wording differ in one term
            out.append((name, f"This {what} is free software; {_GPL.format(long)}; either version {v} of the License, or (at your"
                              " option) any later version."))
            out.append((name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU"
                              f" {long} version {v} as published by the Free Software Foundation"))
            out += [(name, f"This work is licensed under the GNU {long}, version {v}."), (name, f"GNU {long} version {v} only")]
            out += [(name, f"SPDX-License-Identifier: {name}{end}") for end in ("", "-only", "-or-later")]
    out += [
        ("LGPL-2.0", f"This library is free software; {_GPL.format('Library General Public License')}; either version 2 of the"
                     " License, or (at your option) any later version."),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
        ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
        ("Apache-2.0", "Apache License Version 2.0, January 2004"),
        ("MIT", _MIT_END.format("AUTHORS OR COPYRIGHT HOLDERS")), ("Unlicense", _MIT_END.format("AUTHORS")),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
                      " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
                      " binary, for any purpose, commercial or non-commercial, and by any means."),
        ("BSD", _BSD_END),  # the paragraph alone does not tell which one
        ("BSD-3-Clause", _BSD_NAME),
        ("BSD-4-Clause", _BSD_ADVERT),
        ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."),
        ("0BSD", _ISC + "."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
                    " not distributed with this file, You can obtain one at"),
        ("MPL-2.0", "Mozilla Public License Version 2.0"),
        ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not'
                    " use this file except in compliance with the License."),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
                    " 2.0 which is available at"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
                    " v. 2.0 which is available at"),
        ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
                    " v1.0 which accompanies this distribution, and is available at"),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
        ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring"
                    " rights to this software to the public domain worldwide."),
        ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"), ("CC0-1.0", "Licensed under CC0 1.0."),
    ]
    for marks in (("1", "2", "3", "4"), ("a", "b", "c", "d"), ("", "", "", "")):  # signs such as * are no terms
        two = _BSD_START + _BSD_TWO.format(*marks)
        three, four = f"{two}{marks[2]} {_BSD_NAME}", f"{two}{marks[2]} {_BSD_ADVERT}{marks[3]} {_BSD_NAME}"
        for name, text in (("BSD-2-Clause", two), ("BSD-3-Clause", three), ("BSD-4-Clause", four)):
            out += [(name, text), (name, text + _BSD_END)]
    for code, long in _CC.items():
        for v, kind in _CC_VERSIONS.items():
            name = f"CC-{code}-{v}"
            old = long.replace("NoDerivatives", "NoDerivs") if v != "4.0" else long
            out += [(name, f"licensed under a Creative Commons {old} {v} {kind} License"),
                    (name, f"licensed under the Creative Commons {old} {v} {kind} License"),
                    (name, f"Licensed under CC {code} {v}."), (name, f"SPDX-License-Identifier: {name}")]
            out += [(name, f"{web}://creativecommons.org/licenses/{code.lower()}/{v}/") for web in ("http", "https")]
    for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "MPL-1.1", "MPL-2.0", "EPL-1.0",
                 "EPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0", "LGPL-2.0"):
        out.append((name, f"SPDX-License-Identifier: {name}"))
    return out


TEMPLATES = [*NOTICES, *_further()]


class Templates:
    """Templates as shingle sets, and their MinHash bands by class."""

    def __init__(self, templates: Sequence[tuple[str, str]], size: int = SIZE, bands: int = BANDS):
        if sum(len(text.encode()) for _, text in templates) > TEMPLATE_BYTES:
            raise ValueError("too many templates for one scan: take them in blocks")
        deal = np.random.default_rng(11)
        self.odd = (deal.integers(0, 1 << 31, bands) * 2 + 1).astype(np.uint32)
        self.plus = deal.integers(0, 1 << 32, bands).astype(np.uint32)
        hashed, starts = _terms(pa.array([text for _, text in templates], pa.string()))
        self.names = [name for name, _ in templates]
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []  # in shingles, as it stands
        self.by_size: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # size, class
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            own = min(size, int(b - a))
            shingles = windows(hashed[a:b], own, _BASE) if own else np.empty(0, np.uint64)
            self.sets.append(np.unique(shingles))
            self.lengths.append(len(shingles))
            if own:
                self.by_size[own][1 << max(0, (len(shingles) - 1).bit_length())].append(k)
        # templates of other licences with much the same words: what only the one and only the other has
        self.rivals: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in self.sets]
        for some in self.by_size.values():
            near = [k for ks in some.values() for k in ks]
            for k in near:
                for j in near:
                    both = np.isin(self.sets[k], self.sets[j]) if self.names[j] != self.names[k] else np.zeros(1, bool)
                    if 2 * both.sum() >= len(self.sets[k]):
                        own = self.sets[k][~both]
                        self.rivals[k].append((j, own, np.setdiff1d(self.sets[j], self.sets[k])))
        # (size, class): for each band the sorted values and the templates at them
        self.bands: dict[tuple[int, int], list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        self.singles: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}  # of sizes with one-shingle templates only
        for own, classes in self.by_size.items():
            if max(classes) == 1:
                at = defaultdict(list)
                for k in classes[1]:
                    at[int(self.sets[k][0])].append(k)
                self.singles[own] = np.array(sorted(at), np.uint64), dict(at)
                continue
            for c, some in classes.items():
                self.bands[own, c] = [self._band([(int(self._permuted(self.sets[k], b).min()), k) for k in some]) for b in range(bands)]

    @staticmethod
    def _band(values: list[tuple[int, int]]) -> tuple[np.ndarray, dict[int, list[int]]]:
        at = defaultdict(list)
        for value, k in values:
            at[value].append(k)
        return np.array(sorted(at), np.uint32), dict(at)

    def _permuted(self, shingles: np.ndarray, band: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (shingles >> np.uint64(32)).astype(np.uint32) * self.odd[band] + self.plus[band]

    def candidates(self, shingles: np.ndarray, size: int) -> set[tuple[int, int, int]]:
        """(template, first, last shingle) of windows that share a band."""
        found: set[tuple[int, int, int]] = set()
        classes = self.by_size[size]
        top = max(classes)
        if top == 1:  # single shingles are looked up
            values, at = self.singles[size]
            near = np.zeros(1 << 12, bool)
            near[values >> np.uint64(52)] = True
            some = np.flatnonzero(near[shingles >> np.uint64(52)])
            some = some[np.isin(shingles[some], values)]
            return {(k, w, w + 1) for w in some.tolist() for k in at[int(shingles[w])]}
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for b, (odd, plus) in enumerate(zip(self.odd, self.plus)):
            with np.errstate(over="ignore"):
                half = high * odd + plus
            c = 1
            while len(half):
                if c in classes:
                    smallest = np.minimum(half, np.append(half[1:], half[-1]))
                    values, at = self.bands[size, c][b]
                    near = np.zeros(1 << 12, bool)  # tells most values apart
                    near[values >> np.uint32(20)] = True
                    some = np.flatnonzero(near[smallest >> np.uint32(20)])
                    some = some[np.isin(smallest[some], values)]
                    for w in some.tolist():
                        for k in at[int(smallest[w])]:
                            found.add((k, w * c, (w + 2) * c))
                if c >= top:
                    break
                if len(half) % 2:
                    half = np.append(half, np.uint32(0xFFFFFFFF))
                half, c = np.minimum(half[::2], half[1::2]), 2 * c
        return found

    def matches(self, texts: pa.Array, contained: float) -> list[tuple[int, str, float, int]]:
        """(row, licence, containment, first term) of each text and licence."""
        hashed, starts = _terms(texts)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for size in self.by_size:
            shingles = windows(hashed, size, _BASE)
            for k, first, last in self.candidates(shingles, size):
                last = min(last, len(shingles))
                low = int(np.searchsorted(starts, first, "right")) - 1
                high = int(np.searchsorted(starts, last - 1, "right")) - 1
                for row in range(low, high + 1):  # the texts that the window touches
                    a, b = max(int(starts[row]), first - self.lengths[k]), min(int(starts[row + 1]) - size + 1, last + self.lengths[k])
                    if b <= a:
                        continue
                    there = np.isin(shingles[a:b], self.sets[k])
                    share = len(np.unique(shingles[a:b][there])) / len(self.sets[k])
                    if share >= contained and not self._beaten(k, shingles, a, b, int(starts[row]), int(starts[row + 1]) - size + 1, contained):
                        at = a + int(np.argmax(there)) - int(starts[row])
                        key, new = (row, self.names[k]), (-share, at)
                        best[key] = min(best.get(key, new), new)
        return [(row, name, -share, at) for (row, name), (share, at) in sorted(best.items())]

    def _beaten(self, k: int, shingles: np.ndarray, first: int, last: int, low: int, high: int, contained: float) -> bool:
        """Whether a rival stands at the place of a match of ``k`` and shows more
        of what only it has; or as little of it as ``k``, that is nothing."""
        for j, own, other in self.rivals[k]:
            there = np.unique(shingles[max(low, first - self.lengths[j]) : min(high, last + self.lengths[j])])
            if np.isin(self.sets[j], there).sum() < contained * len(self.sets[j]):
                continue
            mine = np.isin(own, there).mean() if len(own) else 0.0
            if len(other) and np.isin(other, there).mean() > mine or len(own) and not mine:
                return True
        return False


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), contained: float = CONTAINED
) -> DataFrame:
    """doc_id, license_id, containment, first_term for each document and
    licence of which a template is found."""
    known = Templates(templates)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = known.matches(batch.column("text"), contained)
            row, name, share, at = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()),
                pa.array(share, pa.float64()), pa.array(at, pa.int64()),
            ], names=["doc_id", "license_id", "containment", "first_term"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(found, "doc_id long, license_id string, containment double, first_term long")
