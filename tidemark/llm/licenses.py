"""License scans: lines and whole texts compared to licence templates by the Dice coefficient over word bigrams.

Normalising lower-cases A-Z and takes every other ASCII character but letters
and digits as a separator; other characters belong to words. A unit is a line
of a text or the whole text, a set of bigrams of its words (a unit of one word
has that word instead). A template matches a unit if twice the number of
common bigrams is at least ``percent`` per cent of both sizes together.

Of all bigrams of a corpus only those that some template has are followed up;
for a unit with such bigrams, templates are first pruned by size (a
coefficient is at most twice the smaller size over both), then by the number
of common bigrams.

Defined results: a null text counts as empty. A text without a match has no
licence (null), a coefficient of 0 and line -1. The best match has the largest
coefficient; ties go to the first line, a line before the whole text, then to
the template name that sorts first. Lines count from 0; the whole text, if it
has several lines, is line -1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.arrow import map_texts
from tidemark.llm.columns import carry, types_of

PERCENT = 80

# Notices that texts carry: fixed texts, by licence name. Any other templates can be given.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at"
    ),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_TABLE = bytes(
    b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def normalised(text: str) -> bytes:
    return text.encode().translate(_TABLE)


def bigrams(line: bytes) -> frozenset[bytes]:
    """Distinct bigrams of a normalised line's words; of one word, that word."""
    words = line.split()
    return frozenset(b" ".join(p) for p in zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words)


class Matcher:
    def __init__(self, templates: dict[str, str], percent: int = PERCENT):
        if not 1 <= percent <= 100:
            raise ValueError("percent is from 1 to 100")
        self.percent = percent
        self.templates = sorted((len(b), name, b) for name, text in templates.items() if (b := bigrams(normalised(text).replace(b"\n", b" "))))
        parts = [b.split() for t in self.templates for b in t[2]]
        flat, _ = W.word_hashes([w for p in parts for w in p])
        at, known = 0, []
        for p in parts:
            known.append(W.run_hashes(flat[at : at + len(p)], len(p))[0])
            at += len(p)
        self.known = np.unique(np.array(known, np.uint64)) if known else np.empty(0, np.uint64)

    def _holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.known[place] == hashes

    def best(self, unit: frozenset[bytes]) -> list[tuple[float, str]]:
        """Coefficient and name of every template that a unit matches."""
        out, n = [], len(unit)
        for size, name, template in self.templates:
            if 200 * min(n, size) < self.percent * (n + size):
                continue
            common = len(unit & template)
            if 200 * common >= self.percent * (n + size):
                out.append((2 * common / (n + size), name))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[float, int, str]]]:
        """Matches of each text: (coefficient, line, name)."""
        data = [normalised(t or "") for t in texts]
        words, first = W.word_hashes(data)
        held = np.zeros(len(words) + 1, bool)  # words that begin, or alone are, a template's bigram
        held[: max(0, len(words) - 1)] |= self._holds(W.run_hashes(words, 2))
        held[: len(words)] |= self._holds(W.run_hashes(words, 1))
        counts = np.concatenate([[0], np.cumsum(held)])
        out = []
        for text, start, end in zip(data, first[:-1].tolist(), first[1:].tolist(), strict=True):
            found: list[tuple[float, int, str]] = []
            if counts[end] > counts[start]:
                lines = text.split(b"\n")
                for number, line in enumerate(lines):
                    if line and not line.isspace():
                        found += [(dice, number, name) for dice, name in self.best(bigrams(line))]
                if len(lines) > 1:
                    found += [(dice, -1, name) for dice, name in self.best(bigrams(text.replace(b"\n", b" ")))]
            out.append(found)
        return out


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """``keep`` columns (clashes: see ``columns``) and, for every whole ``text``, ``license``, ``dice`` and ``line`` of the best match, the names of
    all templates matched (``licenses``, sorted) and the number of matching units and templates (``n_matches``)."""
    matcher = Matcher(templates or TEMPLATES, percent)
    own = ["license", "dice", "line", "licenses", "n_matches"]
    kept, inner, back = carry(keep, own)
    moved = docs.select(*kept, F.col("text").alias("text_to_scan"))
    types = ", ".join([types_of(moved.select(*inner))] * bool(inner) + ["license string, dice double, line int, licenses array<string>, n_matches long"])

    def work(*columns):
        out = {"license": [], "dice": [], "line": [], "licenses": [], "n_matches": []}
        for found in matcher.scan(columns[-1]):
            dice, line, name = min(found, key=lambda m: (-m[0], m[1] if m[1] >= 0 else np.inf, m[2]), default=(0.0, -1, None))
            row = (name, dice, line, sorted({m[2] for m in found}), len(found))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return dict(zip(inner, columns, strict=False)) | out

    return back(map_texts(moved, types, work))
