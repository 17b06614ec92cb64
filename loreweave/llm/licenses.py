"""Licence scans by sentence rules.

A text is cut into segments at sentence ends and line ends, which are normalised.
A known licence sentence is one segment or several on end, so neither a wrapped
notice nor a full stop inside a sentence hides it. The identifiers of the known
sentences, in the order of the text, form a string in which any other segments are
a single mark; ordered rules over identifiers recognise licences there. What a rule
has recognised is taken out, so that a later and less specific rule can't use it.

Spark empties texts without any marker word; the others are read by a small helper.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, text_of

# Sentences of well-known licences and their notices; {} stands for an open place, one word or more.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "agpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "lgpl21-library": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-short": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-short": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-person": "To the extent possible under law, {} has waived all copyright and related or neighboring rights to {}.",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
}
CC_TERMS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SENTENCES |= {f"cc-{t}-{v}".lower(): f"Licensed under CC {t} {v}." for t in CC_TERMS for v in CC_VERSIONS}
#: Licences that a tag line names by their short identifier.
TAGGED = (
    "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0",
)
SENTENCES |= {f"spdx-{t}".lower(): f"SPDX-License-Identifier: {t}" for t in TAGGED}
#: Every known sentence holds one of these within a word; a text without any has no licence sentence.
MARKERS = ("licen", "permi", "warrant", "redistribut", "copyright", "unencumbered", "liable", "apache", "universal", "mpl")


@dataclass(frozen=True)
class LicenceRule:
    """A licence and the identifiers that make it, in order; those that end in ? may be missing.

    One mark of other segments may stand between two of them.
    """

    licence: str
    steps: tuple[str, ...]

    @property
    def pattern(self) -> str:
        """The rule as a regular expression over ``<id>`` and ``<?>``."""
        ids = [(f"<{re.escape(s.rstrip('?'))}>".replace("\\-", "-"), s.endswith("?")) for s in self.steps]
        first = next(k for k, (_, may) in enumerate(ids) if not may)
        before = "".join(f"(?:{i}(?:<\\?>)?)?" for i, _ in ids[:first])
        after = "".join(f"(?:(?:<\\?>)?{i})?" if may else f"(?:<\\?>)?{i}" for i, may in ids[first + 1 :])
        return before + ids[first][0] + after


def _rules(*rows: tuple[str, str]) -> tuple[LicenceRule, ...]:
    return tuple(LicenceRule(licence, tuple(steps.split())) for licence, steps in rows)


# Full notices come before their parts and short forms.
RULES = (
    *_rules(
        ("Apache-2.0", "apache-notice apache-copy? apache-copy-url? apache-url? apache-as-is? apache-see?"),
        ("MIT", "mit-title? mit-grant mit-notice mit-as-is mit-liability?"),
        ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-as-is?"),
        ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is?"),
        ("AGPL-3.0-or-later", "agpl-program gpl-hope? agpl-see?"),
        ("GPL-3.0-or-later", "gpl-program gpl-hope? gpl-see?"),
        ("GPL-2.0-or-later", "gpl2-program gpl-hope? gpl-see?"),
        ("GPL-2.0-only", "gpl2-only-program gpl-hope? gpl-see?"),
        ("LGPL-2.1-or-later", "lgpl21-library lgpl-hope? lgpl-see?"),
        ("ISC", "isc-grant"),
        ("Zlib", "zlib-as-is? zlib-liability? zlib-grant"),
        ("MPL-2.0", "mpl-short mpl-copy? mpl-copy-https?"),
        ("EPL-2.0", "epl-2"),
        ("EPL-1.0", "epl-1"),
        ("CC0-1.0", "cc0-title? cc0-dedication"),
        ("Apache-2.0", "apache-short"),
        ("MIT", "mit-short"),
        ("MIT", "mit-licensed"),
        ("MIT", "mit-title"),
        ("BSD-3-Clause", "bsd-style"),
        ("GPL-3.0-only", "gpl3-short"),
        ("GPL-2.0-only", "gpl2-short"),
        ("LGPL-3.0-only", "lgpl-short"),
        ("BSL-1.0", "boost-short"),
        ("Unlicense", "unlicense"),
        ("CC0-1.0", "cc0-short"),
        ("CC0-1.0", "cc0-person"),
        ("CC0-1.0", "cc0-title"),
    ),
    *(LicenceRule(f"CC-{t}-{v}", (f"cc-{t}-{v}".lower(),)) for t in CC_TERMS for v in CC_VERSIONS),
    *(LicenceRule(t, (f"spdx-{t}".lower(),)) for t in TAGGED),
)

#: Segments end behind a full stop, colon, question or exclamation mark before white space, and at line ends.
ENDS = re.compile(r"(?<=[.:!?])[\x20\x09-\x0D]+|\n")
_OTHER = re.compile("[^a-z0-9]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def normal_sentence(text: str) -> str:
    """ASCII letters in lower case and digits, other runs as one space."""
    return _OTHER.sub(" ", text.translate(_UPPER)).strip(" ")


def _wildcard(sentence: str) -> str:
    """A sentence with {} as a regular expression over normalised text."""
    return r"[a-z0-9]+(?: [a-z0-9]+)*?".join(f" {normal_sentence(part)} " for part in sentence.split("{}")).strip(" ")


class _Node:
    """A place in the automaton of known sentences' words."""

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.name: str | None = None
        #: Sentences whose first fixed words end here, with the fixed words that follow each open place.
        self.open: list[tuple[str, list[list[str]]]] = []


@lru_cache(maxsize=1)
def _known() -> _Node:
    root = _Node()
    for name, sentence in SENTENCES.items():
        first, *more = [normal_sentence(part).split() for part in sentence.split("{}")]
        node = root
        for word in first:
            node = node.next.setdefault(word, _Node())
        if more:
            node.open.append((name, more))
        else:
            node.name = name
    return root


class _Words:
    """A text's words, the segments' ends, and where given words stand."""

    def __init__(self, text: str) -> None:
        segments = [s.split() for s in map(normal_sentence, ENDS.split(text))]
        self.words = [w for s in segments for w in s]
        self.ends = [0, *sorted({n for n in accumulate(map(len, segments)) if n})]
        self._starts = frozenset(self.ends)
        self._found: dict[tuple[str, ...], list[int]] = {}

    def ends_at(self, at: int) -> bool:
        return at in self._starts

    def next_end(self, at: int) -> int:
        return self.ends[bisect_left(self.ends, at)]

    def places(self, part: list[str]) -> list[int]:
        key = tuple(part)
        if key not in self._found:
            w, n, first = self.words, len(part), part[0]
            self._found[key] = [k for k, x in enumerate(w) if x == first and w[k : k + n] == part]
        return self._found[key]

    def next_place(self, part: list[str], at: int) -> int | None:
        places = self.places(part)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None


def _closed(text: _Words, head: list[str], at: int, more: list[list[str]]) -> int | None:
    """Where a sentence with open places ends whose first words end at a place, or None.

    An open place ends at the nearest of its next fixed words, however far they are,
    and the last one of a sentence that ends open at its segment's end. It doesn't
    reach over a segment that begins the sentence anew: then the later beginning counts.
    """
    until = at
    for part in more:
        if until >= len(text.words):
            return None
        start = text.next_place(part, until + 1) if part else text.next_end(until + 1)
        if start is None:
            return None
        until = start + len(part)
    again = bisect_left(places := text.places(head), at)
    anew = any(text.ends_at(p) for p in places[again : bisect_left(places, until)])
    return until if text.ends_at(until) and not anew else None


def identifiers(text: str) -> str:
    """The identifiers of the known sentences in order, any other segments as one ``<?>``; '' if none is known.

    At each segment the longest known sentence that starts there is taken, one
    without open places first.
    """
    known, held = _known(), _Words(text)
    out, at = [], 0
    while at < len(held.words):
        node, until, best, name, opened = known, at, at, None, []
        while until < len(held.words) and (node := node.next.get(held.words[until])):
            until += 1
            if node.name and held.ends_at(until):
                best, name = until, node.name
            opened += [(until, *o) for o in node.open]
        if name is None:
            for after, sentence, more in opened:
                end = _closed(held, held.words[at:after], after, more)
                if end is not None and end > best:
                    best, name = end, sentence
        if name is not None:
            out.append(f"<{name}>")
            at = best
        else:
            at = held.next_end(at + 1)
            if not out or out[-1] != "<?>":
                out.append("<?>")
    return "" if out in ([], ["<?>"]) else "".join(out)


def recognised(ids: str, rules: tuple[tuple[str, re.Pattern], ...]) -> tuple[list[str], str]:
    """The licences that the rules find, each once, in the order of the rules, and what is left of ids."""
    found: dict[str, None] = {}
    for licence, pattern in rules if ids else ():
        ids, n = pattern.subn("<?>", ids)
        if n:
            found[licence] = None
    return list(found), ids


def _with_markers(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for m in MARKERS:
        found = found | lower.contains(m)
    return found


def scan_licences(docs: DataFrame, rules: tuple[LicenceRule, ...] = RULES) -> DataFrame:
    """doc_id, identifiers, licences, n_known, n_left for every row of docs.

    licences lists each recognised licence once, in the order of the rules; n_known
    counts known sentences, n_left those that no rule used. A tag line with an
    expression of several licences is no known sentence.

    Null and empty texts: no identifiers, empty list, zeros. Whole texts are read,
    however long, and so are open places: a name of any length is one, also over
    segments. Repeated rows are read alike; ties don't occur. No rows: no rows.
    Other columns are ignored, whatever their names.
    """
    marked = docs.select("doc_id", F.when(_with_markers(text_of()), text_of()).otherwise("").alias("text"))
    compiled = [(r.licence, r.pattern) for r in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = tuple((licence, re.compile(p)) for licence, p in compiled)
        for batch in batches:
            ids = [identifiers(t) if t else "" for t in batch["text"]]
            found = [recognised(i, ready) for i in ids]
            known = lambda x: len(re.findall("<[^?>]", x))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "identifiers": ids, "licences": [f for f, _ in found], "n_known": list(map(known, ids)), "n_left": [known(left) for _, left in found]})

    return by_batches(marked, run, "identifiers string, licences array<string>, n_known long, n_left long")
