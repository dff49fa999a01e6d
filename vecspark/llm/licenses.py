"""License scans by conditional compression.

Candidate blocks are lines that speak of licensing and the few lines around them. A block is compressed by itself and
again with each template as a raw zstandard dictionary; the template that saves the largest share explains it best. The
templates that save anything and whose words can be in the block are confirmed by their exact wording: the template's
words are aligned with the block's, and what is missing, and what stands in between, is counted. A winner's differences are at most what ``threshold`` leaves of
the template's words, and none of them is a version or a name that tells licenses apart; the fewest differences win, then
the larger reduction. Blocks are read in overlapping pieces that any template
fits into, so long ones cost in proportion.

Texts without a candidate line are filtered out by a pattern in Spark; Python sees the others. Null and empty texts have
no license. Null doc_ids stay null, rows that repeat are scanned each for itself, other columns are ignored, an empty
table gives no rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import NEAR, lean, texts

CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|creative commons|\bcc[ -]?(by|0)|permission (is|to)|redistribut|warrant(y|ies)|\bgpl|free software"
WORD = re.compile(r"[^\W_]+(?:[-.+][^\W_]+)*")
#: Lines around a candidate line that belong to its block.
GAP = 3

# The usual wording of notices and short licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0-notice": "Released under CC0 1.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-only",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
}
# Words that tell one license from another, as the templates' words are cut.
NAMES = frozenset(
    """affero agpl apache artistic attribution attribution-noncommercial attribution-noncommercial-noderivatives attribution-noncommercial-sharealike
    attribution-noderivatives attribution-sharealike boost bsd by by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 eclipse epl eupl european gnu gpl isc
    lesser lgpl library mit mozilla mpl noncommercial noderivatives sharealike unlicense zlib""".split()
)
VERSION = re.compile(r"v?\d+(?:\.\d+)*")
FOUND = "doc_id long, block_start int, start int, end int, license string, reduction double, n_words int, n_missing int, n_extra int, exact boolean"


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def blocks(text: str, gap: int = GAP) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks: candidate lines and up to gap lines on either side, merged where they meet."""
    cue, lines = re.compile(CUE), text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out: list[list[int]] = []
    for i, line in enumerate(lines):
        if cue.search(line):
            a, b = max(0, i - gap), min(len(lines), i + gap + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(starts[a], starts[b] - 1) for a, b in out]


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = NEAR, level: int = 6):
        import zstandard

        self.threshold = threshold
        self.words = {k: [w for w, _, _ in tokens(t)] for k, t in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=level)
        norm = {k: " ".join(w) for k, w in self.words.items()}
        self.with_ = {k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in norm.items()}
        self.longest = max(map(len, self.words.values()))
        # an SPDX line's second word is a name as a whole
        self.keys = {k: frozenset(i for i, x in enumerate(w) if x in NAMES or VERSION.fullmatch(x) or "spdx-license-identifier" in w[:i] or re.fullmatch(r"\d-clause", x)) for k, w in self.words.items()}

    def reductions(self, block: str) -> list[tuple[float, str]]:
        """The share of the block's compressed size that each template saves, largest first."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, k) for k, c in self.with_.items()), key=lambda x: (-x[0], x[1]))

    def possible(self, template: str, held: Counter) -> bool:
        """Whether words that often in a piece leave few enough of the template missing for wording() to find it."""
        missing = (Counter(self.words[template]) - held).total()
        return missing <= (1 - self.threshold) * len(self.words[template]) + 1e-9

    def wording(self, template: str, piece: list[str]) -> tuple[int, int, int, int] | None:
        """(first word, last word, missing, extra) of the template in the piece, if there is enough of it."""
        want = self.words[template]
        runs = [m for m in SequenceMatcher(None, want, piece, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(runs)):  # matched runs in a row that lie together
            held, keys = 0, set(self.keys[template])
            for j in range(i, len(runs)):
                a, b, size = runs[j]
                held += size
                keys.difference_update(range(a, a + size))
                first, last = runs[i].b, b + size
                missing, extra = len(want) - held, last - first - held
                if last - first > 2 * len(want) or (j > i and not NAMES.isdisjoint(piece[runs[j - 1].b + runs[j - 1].size : b])):
                    break
                if not keys and (best is None or missing + extra < best[2] + best[3]):
                    best = (first, last - 1, missing, extra)
        if best and best[2] + best[3] <= (1 - self.threshold) * len(want) + 1e-9:
            return best
        return None

    def scan(self, text: str) -> Iterator[tuple]:
        for a, b in blocks(text):
            words = tokens(text[a:b])
            size = 2 * self.longest
            for at in range(0, max(1, len(words) - self.longest), self.longest):
                yield from self._piece(a, words[at : at + size], None if at == 0 else at, at + size >= len(words))

    def _piece(self, a: int, words: list[tuple[str, int, int]], at: int | None, last: bool) -> Iterator[tuple]:
        """Winners within a piece, one after the other: what a winner covers is taken out. Those that lie wholly in the half shared with the next piece are left to it."""
        open_ = [(0, len(words))]
        while open_:
            x, y = open_.pop()
            piece = [w for w, _, _ in words[x:y]]
            if not piece:
                continue
            ranked, held = self.reductions(" ".join(piece)), Counter(piece)
            good = [(w[2] + w[3], -r, k, r, w) for r, k in ranked if r > 0 and self.possible(k, held) and (w := self.wording(k, piece))]
            if not good:
                continue
            _, _, k, r, (first, end, missing, extra) = min(good)
            if last or x + first < self.longest:
                yield (a, a + words[x + first][1], a + words[x + end][2], k, r, len(self.words[k]), missing, extra, missing + extra == 0)
            open_ += [(x, x + first), (x + end + 1, y)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = NEAR) -> DataFrame:
    """A row for each license found: place of its block and of its wording, the template, the size reduction and the differences."""
    templates = dict(templates or TEMPLATES)

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in it:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for x in dict.fromkeys(scanner.scan(t.as_py()))]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return texts(docs).where(F.col("text").rlike(CUE)).mapInArrow(lean(find), FOUND)
