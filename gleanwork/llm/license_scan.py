"""License scans by patience alignment against templates.

Text and template are word sequences. Their common ends are matched first; then the words
that occur once in each are anchors, the longest increasing subsequence of the anchors fixes
which of them align in order, and each gap between two aligned anchors is aligned the same
way. A template's coverage is the share of its words that end up aligned.

A notice is a passage, not a whole text, and may repeat. So a short template is aligned with
windows around each of its rare words, a long one with overlapping windows of twice its
length; every passage with at most a quarter of other words lies whole in a window. Words that
tell licenses apart (version numbers, nc, sa) must align in a notice, and where the passages
of several templates overlap, the one of the most aligned words counts alone.
"""

from __future__ import annotations

import bisect
import functools
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _whole(name: str) -> str:
    """A license text as shipped; read through the loader, as the package may be an archive."""
    return pkgutil.get_data("gleanwork.llm", f"licenses/{name}.txt").decode()


def _standard(work: str, license: str, version: str) -> str:
    """The notice that the Free Software Foundation has put at the start of each file."""
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {license}"
        f" as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        f" MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details."
    )


#: Licenses whose whole text, without the appendix on how to apply it, is a template.
WHOLE = (
    "0BSD", "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3",
    "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
#: The first sentence of a license text, for texts that are cut off behind it.
GRANTS = {
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: The notices that licenses tell their users to put into files.
NOTICES = {
    "AGPL-3.0": _standard("program", "Affero General Public License", "3"),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
    ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    " See the License for the specific language governing permissions and limitations under the License.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-2.0": _standard("program", "General Public License", "2"),
    "GPL-3.0": _standard("program", "General Public License", "3"),
    "LGPL-2.0": _standard("library", "Library General Public License", "2"),
    "LGPL-2.1": _standard("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _standard("library", "Lesser General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
    " You can obtain one at http://mozilla.org/MPL/2.0/",
}
#: One sentence or less that names a license.
SHORTS = {
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Licensed under CC0 1.0",
    "EPL-2.0": "licensed under the Eclipse Public License, version 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: All templates. A name is the license and what of it the template is.
TEMPLATES = {
    **SHORTS,
    **{f"{name}-notice": t for name, t in NOTICES.items()},
    **{f"{name}-grant": t for name, t in GRANTS.items()},
    **{f"{name}-text": _whole(name) for name in WHOLE},
}
#: What a found license is: a template's kind by the end of its name, else a short notice.
KINDS = ("notice", "grant", "text", "spdx")
#: Share of a template's words that must align.
COVERAGE = 0.9
#: Words that tell the licenses of a family apart, besides version numbers and "Library General".
TELLING = {"affero", "lesser", "nc", "nd", "sa"}
#: Templates of up to so many words are notices; their telling words must all align.
SHORT = 90

WORDS = re.compile(r"[a-z0-9]+")
#: An SPDX tag, and the operators and identifiers of the expression behind it.
TAG = re.compile(r"spdx-license-identifier:", re.I | re.A)
PART = re.compile(r"[ \t(]*([A-Za-z0-9][A-Za-z0-9.:-]*\+?)[ \t)]*")


def tokens(text: str) -> list[str]:
    """Runs of Latin letters and digits; only A-Z are lower-cased, so offsets stay."""
    return WORDS.findall(text.translate(LOWER))


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second parts; first parts rise already."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for at, (_, second) in enumerate(pairs):
        pile = bisect.bisect_left(tops, second)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(second)
            ends.append(at)
        else:
            tops[pile], ends[pile] = second, at
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = before[at]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The aligned positions (in the text, in the template), in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        place = {w: at for at, w in enumerate(template[c:d], c) if w in once}
        anchors = increasing([(at, place[w]) for at, w in enumerate(text[a:b], a) if w in once])
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """The licenses that SPDX tags name, each once: name, and its start and end in the text.

    What stands behind WITH is an exception and no license.
    """
    found: dict[str, tuple[int, int]] = {}
    for tag in TAG.finditer(text):
        part, counts = PART.match(text, tag.end()), True
        while part:
            if counts:
                name = part[1].rstrip(".:-")
                found.setdefault(name, (part.start(1), part.start(1) + len(name)))
            joint = PART.match(text, part.end())
            if not joint or joint[1] not in ("AND", "OR", "WITH"):
                break
            part, counts = PART.match(text, joint.end()), joint[1] != "WITH"
    return [(name, *place) for name, place in found.items()]


def kind(name: str) -> str:
    end = name.rpartition("-")[2]
    return end if end in KINDS else "short"


def telling(words: list[str]) -> list[int]:
    """The places of words that tell one license from another of its family."""
    return [at for at, w in enumerate(words) if w in TELLING or (w.isdigit() and len(w) < 3) or (w == "library" and words[at + 1 : at + 2] == ["general"])]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = {name: tokens(t) for name, t in templates.items()}
        spread = Counter(w for ts in self.templates.values() for w in {*ts})
        #: How many of a template's words may be missing, and how many others stand between.
        self.missing = {name: int(len(ts) * (1 - coverage) + 1e-9) for name, ts in self.templates.items()}
        self.extra = {name: max(2, len(ts) // 4) for name, ts in self.templates.items()}
        self.distinct = {name: {*ts} for name, ts in self.templates.items()}
        #: A whole license text is long enough to be known without its version number.
        self.telling = {name: telling(ts) if len(ts) <= SHORT else [] for name, ts in self.templates.items()}
        #: Of each template so many words that no passage covers enough of it without one.
        self.keys: dict[str, set[str]] = {}
        self.names: dict[str, list[str]] = {}
        for name, ts in self.templates.items():
            spare = self.missing[name] + 1
            self.keys[name] = set(sorted({*ts}, key=lambda w, ts=ts: (spread[w], -len(w), w))[:spare])
            while sum(w in self.keys[name] for w in ts) < spare:
                self.keys[name].add(next(w for w in ts if w not in self.keys[name]))
            for w in self.keys[name]:
                self.names.setdefault(w, []).append(name)

    def starts(self, name: str, words: list[str], places: dict[str, list[int]]) -> tuple[list[int], int]:
        """Where windows start that a passage may lie whole in, and how long they are."""
        template, extra = self.templates[name], self.extra[name]
        if len(template) <= SHORT:
            found = {max(0, at - j - extra) for j, w in enumerate(template) if w in self.keys[name] for at in places.get(w, ())}
            return sorted(found), len(template) + 2 * extra
        stride = -(-len(template) // 2)
        keyed = {at // stride for w in self.keys[name] for at in places.get(w, ())}
        return sorted({s * stride for k in keyed for s in range(max(0, k - 4), k + 1)}), 2 * len(template)

    def passage(self, name: str, window: list[str]) -> list[tuple[int, int]]:
        """The aligned places in a window, none if they are too few or too far apart, or if a
        telling word of either side has no partner between them."""
        template, extra = self.templates[name], self.extra[name]
        if len(self.distinct[name].difference(window)) > self.missing[name]:
            return []
        pairs = align(window, template)
        # A word of the template that also stands far off is no part of the passage.
        middle = len(pairs) // 2
        first = max((i for i in range(1, middle + 1) if pairs[i][0] - pairs[i - 1][0] - 1 > extra), default=0) if pairs else 0
        last = min((i for i in range(middle + 1, len(pairs)) if pairs[i][0] - pairs[i - 1][0] - 1 > extra), default=len(pairs))
        pairs = pairs[first:last]
        if len(pairs) < len(template) - self.missing[name] or pairs[-1][0] + 1 - pairs[0][0] - len(pairs) > extra:
            return []
        if not {j for _, j in pairs}.issuperset(self.telling[name]):
            return []
        if len(template) <= SHORT:
            aligned = {i for i, _ in pairs}
            if any(i not in aligned for i in telling(window) if pairs[0][0] < i < pairs[-1][0]):
                return []
        return pairs

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, word past the last) of each license's best passage.

        Where passages overlap, that of the most aligned words counts alone.
        """
        words = tokens(text)
        held = {*words}
        tagged = []
        if "spdx" in held and (named := identifiers(text)):
            places_of = [m.span() for m in WORDS.finditer(text.translate(LOWER))]
            for name, start, end in named:
                at = [bisect.bisect_left(places_of, (x, x)) for x in (start, end)]
                tagged.append((f"{name}-spdx", 1.0, *at))
        return self.ordered(self.aligned(words, held) + tagged)

    def ordered(self, found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """Whole texts first, then the best covered."""
        return sorted(found, key=lambda f: (kind(f[0]) != "text", -f[1], f[2], -len(self.templates.get(f[0], ())), f[0]))

    def aligned(self, words: list[str], held: set[str]) -> list[tuple[str, float, int, int]]:
        hit = held & self.names.keys()
        if not hit:
            return []
        places: dict[str, list[int]] = {w: [] for w in hit}
        for at, w in enumerate(words):
            if w in places:
                places[w].append(at)
        passages = set()
        for name in sorted({n for w in hit for n in self.names[w]}):
            if len(words) < len(self.templates[name]) - self.missing[name] or len(self.distinct[name] - held) > self.missing[name]:
                continue
            starts, width = self.starts(name, words, places)
            for start in starts:
                if pairs := self.passage(name, words[start : start + width]):
                    passages.add((len(pairs), name, start + pairs[0][0], start + pairs[-1][0] + 1))
        taken: list[tuple[int, int]] = []
        best: dict[str, tuple[str, float, int, int]] = {}
        for size, name, start, stop in sorted(passages, key=lambda p: (-p[0], -p[0] / len(self.templates[p[1]]), p[2], p[3], p[1])):
            at = bisect.bisect_left(taken, (start, stop))
            if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < stop):
                continue
            taken.insert(at, (start, stop))
            best.setdefault(name, (name, size / len(self.templates[name]), start, stop))
        return list(best.values())


@functools.lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...], coverage: float) -> Scanner:
    return Scanner(dict(templates), coverage)


FOUND = "array<struct<license: string, coverage: double, start: int, stop: int, kind: string>>"


def licenses(text: Column, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Column:
    """The licenses a text holds or names, whole license texts first, then the best covered:
    license, coverage of its template, the words [start, stop) of the passage, and its kind:
    text (a whole license text), notice (the standard one), grant (a license text's first
    sentence), short (another notice) or spdx (an identifier behind a tag).

    An empty array for null and empty texts and for texts without a license. A passage that
    repeats is found once, at its first best place.
    """
    fixed = tuple(sorted(templates.items()))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _scanner(fixed, coverage)
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "coverage", "start", "stop", "kind"), (*f, kind(f[0])), strict=True)) for f in scanner.find(t)] if t else [] for t in texts])

    return found(text)


def scan(docs: DataFrame, text: str = "text", found: str = "licenses") -> DataFrame:
    """The frame with the licenses of its texts; a column of that name is replaced, all
    others stay. Repeated rows are scanned each, an empty table gives an empty one."""
    return docs.withColumn(found, licenses(F.col(text)))
