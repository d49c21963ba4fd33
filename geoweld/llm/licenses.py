"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The whole text, each paragraph and each line are compared. A unit of b bigrams
reaches a coefficient of t only with templates of t / (2 - t) * b to
(2 - t) / t * b bigrams, so sizes prune the templates before bigrams are looked up.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Licence statements and opening clauses, as their owners publish them. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *(
        (f"CC-{code}-{version}", text)
        for code, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"),
        )
        for version, place in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"))
        for text in (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {name} {version} {place} License.")
    ),
)

#: Whole licences, a file for each name.
TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))

WORD = re.compile("[a-z0-9]+")
FOUND = "doc_id long, license string, score double, n_units long, matched string"


def pairs_of(text: str) -> list[tuple[str, str]]:
    """The bigrams of a text, in order."""
    words = WORD.findall(text.lower() if text.isascii() else text.translate(_FOLD))
    return list(zip(words, words[1:]))


def bigrams(text: str) -> set[tuple[str, str]]:
    return set(pairs_of(text))


_FOLD = {i: i + 32 for i in range(65, 91)}


class Templates:
    def __init__(self, templates: Sequence[tuple[str, str]], least: float):
        known = sorted(((bigrams(t), name, len(pairs_of(t))) for name, t in templates), key=lambda x: (len(x[0]), x[1]))
        self.sets, self.names, self.spans = (list(x) for x in zip(*known, strict=True))
        self.sizes, self.least = list(map(len, self.sets)), least
        self.having: dict[tuple[str, str], list[int]] = {}
        for i, s in enumerate(self.sets):
            for g in s:
                self.having.setdefault(g, []).append(i)

    def within(self, text: str) -> Iterator[tuple[float, str, int, int]]:
        """Coefficient, licence, first word and words of the best stretch of a text for each licence that it holds amid other words.

        A stretch has as many words as the template and begins with one of its bigrams. Only templates of
        which the text has enough bigrams for any stretch to reach `least` are looked at, in one pass each.
        """
        pairs = pairs_of(text)
        shared = Counter(i for g in self.having.keys() & set(pairs) for i in self.having[g])
        for i, n in shared.items():
            size, span, own = self.sizes[i], self.spans[i], self.sets[i]
            if len(pairs) <= span or n * (2 - self.least) < self.least * size - 1e-9:
                continue
            counts: dict[tuple[str, str], int] = {}
            hits = end = 0
            best = (0.0, 0)
            for start, first in enumerate(pairs):
                while end < min(len(pairs), start + span):
                    g = pairs[end]
                    counts[g] = counts.get(g, 0) + 1
                    hits += counts[g] == 1 and g in own
                    end += 1
                if first in own:
                    best = max(best, (2 * hits / (len(counts) + size), -start))
                counts[first] -= 1
                if not counts[first]:
                    del counts[first]
                    hits -= first in own
            if best[0] >= self.least:
                yield best[0], self.names[i], -best[1], span + 1

    def best(self, unit: str) -> tuple[float, str] | None:
        """The highest coefficient of at least `least`, and its licence; of equals the first name."""
        own = bigrams(unit)
        b = len(own)
        first = bisect_left(self.sizes, self.least / (2 - self.least) * b - 1e-9)
        last = bisect_right(self.sizes, (2 - self.least) / self.least * b + 1e-9)
        if first == last or not b:
            return None
        shared = Counter(i for g in own & self.having.keys() for i in self.having[g] if first <= i < last)
        scored = [(2 * n / (b + self.sizes[i]), self.names[i]) for i, n in shared.items()]
        scored = [x for x in scored if x[0] >= self.least]
        return min(scored, key=lambda x: (-x[0], x[1])) if scored else None


def units(text: str) -> Iterator[str]:
    """Lines; paragraphs (parted by empty lines) of several lines; a whole text of several paragraphs. CRLF ends a line as LF does."""
    text = text.replace("\r\n", "\n")
    paragraphs = text.split("\n\n")
    for p in paragraphs:
        lines = p.split("\n")
        yield from lines
        if len(lines) > 1:
            yield p
    if len(paragraphs) > 1:
        yield text


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES + TEXTS, least: float = 0.8) -> DataFrame:
    """doc_id, license, score, n_units, matched for every row of docs.

    The licence and coefficient of the unit that fits best, how many units reach
    `least`, and that unit. Units are lines, paragraphs, the whole text and, for each licence, the
    stretch of as many words as its template has that fits it best, so a notice amid other words is found too. Of equal coefficients the first name wins, then the
    first unit. Nulls for a text without such a unit, or a null one (0 units).
    Rows repeat as in docs; other columns are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        shortest = min(known.sizes) * least / (2 - least)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hits = [(*hit, u) for u in units(text or "") if len(u) >= 2 * shortest and (hit := known.best(u))]
                amid = [(score, name, at, n) for score, name, at, n in known.within(text or "") if not any(h[1] == name and h[0] >= score for h in hits)]
                words = [w for w in WORD.findall((text or "").translate(_FOLD))] if amid else []
                hits += [(score, name, " ".join(words[at : at + n])) for score, name, at, n in amid]
                top = min(hits, key=lambda x: (-x[0], x[1]), default=(None, None, None))
                rows.append((key, top[1], top[0], len(hits), top[2]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(scan, FOUND)
