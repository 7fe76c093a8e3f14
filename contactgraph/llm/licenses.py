"""License scans by patience alignment.

Text and template are aligned as words; a version is one word, however it is
spelled. Words that occur once in both are anchors; the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned in the same
way. The share of the template's words that find a partner is the coverage.
Licenses with like notices are all in the table of templates, and where those of
several licenses fit one place the one with the most aligned words is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.llm.text import in_pieces

_BREAKS = "".join(map(chr, range(1, 48))) + ":;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_BREAKS.encode(), b" " * len(_BREAKS))
_WORD = f"[^{re.escape(_BREAKS)}]"
_TOKEN = re.compile(rf"(?i:v(?:er(?:sion)?)?\.?\s{{0,3}})?([0-9]+(?:\.[0-9]+)*)(?!{_WORD})|{_WORD}+")


class License(NamedTuple):
    """One spelling of a notice. ``required`` are phrases of it that a match may
    not lack: what tells this license from others. Names of one license differ in
    what stands behind its own: ``-line``, ``-notice``, ``-text`` or ``-terms``."""

    name: str
    text: str
    required: tuple[str, ...] = ()

    @property
    def license(self) -> str:
        return re.sub("-(line|notice|text|terms)$", "", self.name)


_MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_APACHE_END = (
    " (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at "
    "{} Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} "
    "General Public License as published by the Free Software Foundation, either version {} of the License, "
    "or (at your option) any later version."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer."
)
_BSD_BINARY = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_WORK = "This work is licensed under the GNU {}General Public License, version {}."
_WORK_TURNED = "This work is licensed under version {} of the GNU {}General Public License."


def _creative_commons(kind: str, version: str) -> list[License]:
    required = (*kind.split("-"), version)
    return [License(f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.", required)]


def _gnu(name: str, kind: str, version: str) -> list[License]:
    required = ("GNU", *kind.split(), "General Public", f"version {version}")
    label, added = f"{name}-{version}" if "." in version else f"{name}-{version}.0", f"{kind} " if kind else ""
    return [
        License(label, _WORK.format(added, version), required),
        License(label, _WORK_TURNED.format(version, added), required),
        License(
            "GPL-notice" if label == "GPL-3.0" else f"{label}-notice", _GPL_NOTICE.format(f"GNU {kind}".strip(), version), required
        ),
    ]


#: Notices that are looked for unless others are given. The customary wordings.
LICENSES = [
    License("MIT", "Released under the MIT License.", ("MIT",)),
    License("MIT-0", "Released under the MIT-0 License.", ("MIT-0",)),
    License("MIT-0", "Released under the MIT No Attribution License.", ("MIT No Attribution",)),
    License("MIT-text", _MIT_TEXT + _MIT_END),
    License("MIT-0-text", _MIT_TEXT + ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND", ("so the software is",)),
    License("BSD", "Released under the BSD License.", ("BSD",)),
    License("BSD-2-Clause", "Released under the 2-Clause BSD License.", ("2-Clause BSD",)),
    License("BSD-3-Clause", "Released under the 3-Clause BSD License.", ("3-Clause BSD",)),
    License("BSD-terms", _BSD_TERMS),
    License("BSD-2-Clause-text", _BSD_TERMS + _BSD_BINARY, ("reproduce",)),
    License("BSD-3-Clause-text", _BSD_TERMS + _BSD_BINARY + _BSD_NAMES, ("endorse",)),
    License("ISC", "Released under the ISC License.", ("ISC",)),
    License(
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    License("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache", "Version 2.0")),
    License("Apache-2.0", "Licensed under the Apache 2.0 License.", ("Apache 2.0",)),
    License(
        "Apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0" + _APACHE_END.format("http://www.apache.org/licenses/LICENSE-2.0"),
        ("Apache License Version 2.0",),
    ),
    License("Apache-1.1", "Licensed under the Apache License, Version 1.1.", ("Apache", "Version 1.1")),
    License("ECL-2.0", "Licensed under the Educational Community License, Version 2.0.", ("Educational Community", "Version 2.0")),
    License(
        "ECL-2.0-notice",
        "Licensed under the Educational Community License, Version 2.0" + _APACHE_END.format("http://opensource.org/licenses/ECL-2.0"),
        ("Educational Community License Version 2.0",),
    ),
    License("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", ("Mozilla Public", "Version 2.0")),
    License(
        "MPL-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License v 2.0",),
    ),
    *_gnu("GPL", "", "3"),
    *_gnu("GPL", "", "2"),
    *_gnu("LGPL", "Lesser", "3"),
    *_gnu("LGPL", "Lesser", "2.1"),
    *_gnu("AGPL", "Affero", "3"),
    *[x for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0") for x in _creative_commons(kind, v)],
    License(
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
]
#: The first spelling of each.
TEMPLATES = {x.name: x.text for x in reversed(LICENSES)}
COVERAGE = 0.8


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case and where they stand. A number, with ``version`` or
    ``v`` before it or not, is one word without the zeros at its end: ``#2``."""
    words, places = [], []
    for m in _TOKEN.finditer(text):
        words.append(m[0].lower() if m[1] is None else "#" + re.sub(r"(?:\.0+)+$", "", m[1]))
        places.append(m.span())
    return words, places


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    chain, i = [], piles[-1] if piles else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
    matched, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            matched.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            matched.append((j, m))
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[q]: q for q in range(k, m) if in_b[b[q]] == 1}
        pairs = [(p, place[a[p]]) for p in range(i, j) if in_a[a[p]] == 1 and a[p] in place]
        anchors = [pairs[c] for c in increasing([q for _, q in pairs])]
        if anchors:
            matched += anchors
            ends = [(i - 1, k - 1), *anchors, (j, m)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:]) if p + 1 < r and q + 1 < s]
    return sorted(matched)


class Template:
    """Words of a notice, the places that a match may not lack, and the hints of
    which any sufficient match has one.

    Any match has the longest required word. Without one, a match may still lack only
    ``missing`` words, so of any set of words that make up more places than that,
    one occurs; the longest are taken."""

    def __init__(self, license: License, coverage: float):
        self.name, self.license, self.coverage = license.name, license.license, coverage
        self.words = words_with_places(license.text)[0]
        missing = len(self.words) - int(-(-coverage * len(self.words) // 1))
        self.slack = max(3, missing)
        self.required = [p for phrase in license.required for p in self._places(phrase)]
        named = sorted((p for p in self.required if not self.words[p].startswith("#")), key=lambda p: -len(self.words[p]))
        self.hints = {self.words[p]: p for p in named[:1]}
        # of the distinct words a text has to have all but those that a match may lack
        self.kinds = set(self.words)
        self.spelled = {w.encode() for w in self.kinds if not w.startswith("#")}
        self.enough, self.enough_spelled = len(self.kinds) - missing, len(self.spelled) - missing
        places = 0
        for word in sorted(set(self.words), key=lambda w: (-len(w), w)) if not self.hints else ():
            if places > missing:
                break
            self.hints[word] = self.words.index(word)
            places += self.words.count(word)

    def _places(self, phrase: str) -> range:
        """Where the words of ``phrase`` first stand one after the other."""
        wanted = words_with_places(phrase)[0]
        for p in range(len(self.words) - len(wanted) + 1):
            if self.words[p : p + len(wanted)] == wanted:
                return range(p, p + len(wanted))
        raise ValueError(f"{self.name}: {phrase!r} is not in the text")

    def possible(self, spelled: set[bytes]) -> bool:
        """Whether a text with these words may have a match at all."""
        return any(h.encode() in spelled for h in self.hints) and len(self.spelled & spelled) >= self.enough_spelled

    def match(self, words: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        """Aligned words, first and last place of the text's part, if they are enough."""
        pairs = align(words[low:high], self.words)
        if not pairs or len(pairs) / len(self.words) < self.coverage:
            return None
        if self.required and not {q for _, q in pairs}.issuperset(self.required):
            return None
        return len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        """Matches in a text. At every hint the template is laid over the text, with slack, and aligned."""
        found, size = [], len(self.words)
        for p, word in enumerate(words):
            if word not in self.hints or any(i <= p < j and n == size for n, i, j in found[-2:]):
                continue
            start = p - self.hints[word]
            low, high = max(0, start - self.slack), min(len(words), start + size + self.slack)
            if len(self.kinds.intersection(words[low:high])) < self.enough:
                continue
            match = self.match(words, low, high)
            if match is not None:
                found.append(match)
        return found


class Match(NamedTuple):
    """Aligned words, the coverage, first and last place, and the template's names."""

    aligned: int
    coverage: float
    first: int
    last: int
    name: str
    license: str

    def apart(self, better: Match) -> bool:
        """Whether a better match leaves this one: it is elsewhere, or another notice of the same license."""
        away = self.last <= better.first or better.last <= self.first
        return away or (self.license == better.license and self.name != better.name)


def best_matches(found: list[Match]) -> list[Match]:
    """Of overlapping matches that with the most aligned words stays; then the
    highest coverage, the earliest, the first name."""
    kept: list[Match] = []
    for match in sorted(set(found), key=lambda m: (-m.aligned, -m.coverage, *m[2:])):
        if all(map(match.apart, kept)):
            kept.append(match)
    return sorted(kept, key=lambda m: (m.first, m.name))


def find_licenses(text: str | None, templates: list[Template]) -> list[tuple[str, float, int, int]]:
    """Matches of all templates, by start: name, coverage, start and end in code points."""
    spelled = set((text or "").lower().encode(errors="replace").translate(_TO_SPACE).split())
    hinted = [t for t in templates if t.possible(spelled)]
    if not hinted:
        return []
    words, places = words_with_places(text)
    found = [Match(n, n / len(t.words), i, j, t.name, t.license) for t in hinted for n, i, j in t.find(words)]
    return [(m.name, m.coverage, places[m.first][0], places[m.last - 1][1]) for m in best_matches(found)]


_FOUND = "array<struct<license:string,coverage:double,start:int,end:int>>"
_TYPE = pa.list_(
    pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
)


def prepared(templates: dict[str, str] | list[License] | None, coverage: float) -> list[Template]:
    given = LICENSES if templates is None else templates
    if isinstance(given, dict):
        given = [License(name, text) for name, text in given.items()]
    ready = [Template(License(*x), coverage) for x in given]
    return [t for t in ready if t.words]


def scan(
    docs: DataFrame,
    templates: dict[str, str] | list[License] | None = None,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, found)`` per row: the matches in each whole text, with coverage and
    code points; where those of several licenses overlap, the best of them.

    ``templates`` is a table of :class:`License` rows, several of which may bear one
    name, or texts by name; a match must reach ``coverage`` and have the required
    phrases of its template. Null texts count as empty; repeated rows come back as
    often as they came. Templates without words find nothing. Nothing is shuffled."""
    ready = prepared(templates, coverage)

    def run(batches):
        for batch in in_pieces(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                matches = find_licenses(text, ready)
                rows.append([{"license": n, "coverage": c, "start": i, "end": j} for n, c, i, j in matches])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _TYPE)], ["id", "found"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id bigint, found {_FOUND}")
