"""License scans: text compared with license templates by the Dice coefficient over word bigrams.

Text is normalised (A-Z lower-cased, ASCII punctuation dropped). Units are a text's lines, its paragraphs (between lines
without words), the whole, and its windows: runs of words wherever they start and end, of up to (2 - t) / t times a
template's words. A unit's set is that of its distinct word bigrams. 2 |A and B| / (|A| + |B|) reaches the threshold t
only if both sizes, and what they share, are at least t / (2 - t) of the larger: texts that share fewer distinct bigrams with
a template are passed over, and few templates are left for the rest.

Cases: null and empty texts match nothing; ties go to the earlier template, then the narrower unit; texts of any
length are read whole; repeated rows give their result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pkgutil

import numpy as np
from pyspark.sql import DataFrame

from .common import LOWER, SPACES, mix, text_buffer, word_hashes

# Notices, standard headers and openings of public licenses; their full texts follow from license_texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-file": "Licensed under the MIT License. See LICENSE file in the project root for license information.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
FULL = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")
TEMPLATES |= {k + "-full" if k in TEMPLATES else k: pkgutil.get_data(__package__, f"license_texts/{k}.txt").decode() for k in FULL}
#: An opening that several licenses share: told only where none of their full texts is.
SHARED = {"BSD-opening": {"BSD-3-Clause", "BSD-2-Clause"}}
SCOPES = ("line", "paragraph", "text", "window")

_TABLE = LOWER.copy()
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + h[1:])


def _previous(grams: np.ndarray) -> np.ndarray:
    """Where each bigram stood before, -1 for the first time."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1)
    again = grams[order[1:]] == grams[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


class Matcher:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = 0.8):
        import pyarrow as pa

        self.names, self.least = list(templates), least
        h, at, _ = word_hashes(*text_buffer(pa.array(list(templates.values()), pa.string())), _TABLE, _SPACE)
        self.sets = [np.unique(_bigrams(h[a:b])) for a, b in zip(at, at[1:])]
        self.lengths = np.diff(at) - 1
        self.sizes = np.array([len(s) for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets))
        # The templates of each known bigram, one after the other.
        pairs = np.array(sorted((int(p), i) for i, x in enumerate(self.sets) for p in np.searchsorted(self.known, x)))
        self.of, self.from_ = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))
        # As the smaller of two sizes is at most what both share: 2 s >= least (s + size)
        self.need = self.sizes * least / (2 - least) - 1e-9
        self.shared = [(self.names.index(k), {self.names.index(x) for x in v}) for k, v in SHARED.items() if k in self.names and v <= set(self.names)]

    def _possible(self, row: np.ndarray, known: np.ndarray, rows: int):
        """(row, templates) where a row's distinct bigrams are enough for a template."""
        key = np.unique(row * len(self.known) + known)
        row, known = np.divmod(key, len(self.known))
        many = self.from_[known + 1] - self.from_[known]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.from_[known], many)
        n = len(self.names)
        counts = np.bincount(np.repeat(row, many) * n + self.of[at], minlength=rows * n).reshape(rows, n)
        enough = counts >= self.need
        for r in np.flatnonzero(enough.any(axis=1)):
            yield int(r), np.flatnonzero(enough[r])

    def _unit(self, grams: np.ndarray, among: np.ndarray):
        """(dice, template) for the templates that the unit reaches."""
        grams = np.unique(grams)
        a = len(grams)
        for i in among[2 * np.minimum(self.sizes[among], a) >= self.least * (self.sizes[among] + a)]:
            s = self.sets[i]
            p = np.searchsorted(s, grams)
            both = int((s[np.minimum(p, len(s) - 1)] == grams).sum())
            if 2 * both >= self.least * (a + len(s)):
                yield 2 * both / (a + len(s)), int(i)

    def _window(self, grams: np.ndarray, prev: np.ndarray, i: int) -> float:
        """The greatest Dice of template i with a run of words no longer than the bound on sizes allows; 0 where none reaches the threshold.

        The best run starts with a shared bigram. Starts are taken in blocks: what the run from a block's first start shares
        and the size of that from its last bound the block from above, and blocks are opened while their bound exceeds the best."""
        s, n = self.sets[i], len(grams)
        p = np.minimum(np.searchsorted(s, grams), len(s) - 1)
        hit = s[p] == grams
        length = max(1, int(self.lengths[i] * (2 - self.least) / self.least))
        starts = np.flatnonzero(hit)
        # Shared bigrams within reach, repeats and all, must be enough.
        starts = starts[np.searchsorted(starts, starts + length) - np.arange(len(starts)) >= self.need[i]]
        if not len(starts):
            return 0.0
        span = max(1, len(s) // 50)
        cut = np.flatnonzero(np.append(True, np.diff(starts // span) > 0))
        ends = np.append(cut[1:], len(starts)) - 1

        def dice(first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
            """Of each pair of starts, the bound on runs from between them; exact where they are equal."""
            out = np.empty(len(first))
            rows = max(1, (1 << 19) // width)
            for x in range(0, len(first), rows):
                lo, hi = first[x : x + rows, None], last[x : x + rows, None]
                at = lo + np.arange(width)
                inside = (at < n) & (at < hi + length)
                at = np.minimum(at, n - 1)
                before = prev[at]
                both = np.cumsum(inside & hit[at] & (before < lo), axis=1, dtype=np.int32)
                size = np.cumsum(inside & (at >= hi) & (before < hi), axis=1, dtype=np.int32)
                out[x : x + rows] = (2 * both / (np.maximum(size, both) + len(s))).max(axis=1)
            return out

        if span == 1:
            best = float(dice(starts, starts, length).max())
            return best if best >= self.least else 0.0
        bound = dice(starts[cut], starts[ends], length + span)
        best = 0.0
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] <= best or bound[j] < self.least:
                break
            own = starts[cut[j] : ends[j] + 1]
            best = max(best, float(dice(own, own, length).max()))
        return best if best >= self.least else 0.0

    def match(self, column) -> list[list[tuple[float, int, int]]]:
        """For each text of an Arrow column: (dice, template, scope), best first."""
        data, offsets = text_buffer(column)
        h, at, starts = word_hashes(data, offsets, _TABLE, _SPACE)
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if len(h) < 2:
            return out
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        grams = _bigrams(h)
        p = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        shared = np.flatnonzero((self.known[p] == grams) & (row[1:] == row[:-1]))
        for r, among in self._possible(row[shared], p[shared], len(out)):
            a, b = int(at[r]), int(at[r + 1])
            found = set()
            step = np.diff(line[a:b])
            # A bigram lies within a unit if both words do.
            for scope, cuts in enumerate((np.flatnonzero(step > 0), np.flatnonzero(step > 1), [])):
                first = [a, *(a + 1 + int(c) for c in cuts), b]
                for x, y in zip(first, first[1:]):
                    found.update((d, i, scope) for d, i in self._unit(grams[x : y - 1], among))
            own = grams[a : b - 1]
            prev = _previous(own)
            for i in among:
                d = self._window(own, prev, int(i))
                if d >= self.least:
                    found.add((d, int(i), 3))
            told = {i for _, i, _ in found}
            hidden = {i for i, full in self.shared if told & full}
            out[r] = sorted((x for x in found if x[1] not in hidden), key=lambda t: (-t[0], t[1], t[2]))
        return out


def scan_licenses(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, the best license with its dice and scope (null where none is reached), and all licenses that are."""

    def run(batches):
        import pyarrow as pa

        made = Matcher(least=least)
        for batch in batches:
            found = made.match(batch.column(1))
            best = [x[0] if x else (None, None, None) for x in found]
            names = made.names
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if b[1] is None else names[b[1]] for b in best], pa.string()),
                    pa.array([b[0] for b in best], pa.float64()),
                    pa.array([None if b[2] is None else SCOPES[b[2]] for b in best], pa.string()),
                    pa.array([",".join(sorted({names[i] for _, i, _ in x})) for x in found], pa.string()),
                ],
                ["doc_id", "license", "dice", "scope", "licenses"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, scope string, licenses string")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
