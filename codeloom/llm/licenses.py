"""6. License scans: templates as raw zstandard dictionaries, confirmed by wording; size reduction settles ties."""

from __future__ import annotations

import collections
import difflib
import functools
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: A line with one of these may belong to a license notice.
CUES = r"(?i)licen[cs]|copyright|\(c\) *[12]|©|redistribut|warrant(y|ies)|public domain|creative commons|\bCC[ -]?(BY|0)|SPDX|all rights reserved|permission is hereby"
#: Lines without a cue that may stand between two lines of one block.
BRIDGE = 3
#: Share of a template's words that may be missing or changed, and of words added inside it.
TOLERANCE = 0.15

#: License, and its wordings: public notices and texts.
_NOTICES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "MIT",
        (
            "Released under the MIT License.",
            "Licensed under the MIT License.",
            "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ),
    ),
    (
        "Apache-2.0",
        (
            "Licensed under the Apache License, Version 2.0.",
            "Released under the Apache License, Version 2.0.",
            "SPDX-License-Identifier: Apache-2.0",
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ),
    ),
    (
        "GPL-3.0",
        (
            "This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 3.",
            "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ),
    ),
    (
        "GPL-2.0",
        (
            "This work is licensed under the GNU General Public License, version 2.",
            "Licensed under the GNU General Public License, version 2.",
            "SPDX-License-Identifier: GPL-2.0-only",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ),
    ),
    (
        "LGPL-3.0",
        (
            "This work is licensed under the GNU Lesser General Public License, version 3.",
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        ),
    ),
    ("AGPL-3.0", ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only")),
    (
        "BSD-3-Clause",
        (
            "Released under the BSD 3-Clause License.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ),
    ),
    ("ISC", ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.")),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.")),
    ("CC0-1.0", ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.")),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.")),
    ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.")),
    ("Proprietary", ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.")),
)
#: Licenses whose full texts are wordings too; the files are the public ones, with no word changed.
FULL_TEXTS = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Artistic-1.0")


def _with_texts(notices: tuple) -> tuple:
    every = {name: list(wordings) for name, wordings in notices}
    for name in FULL_TEXTS:
        every.setdefault(name, []).append((pkgutil.get_data(__package__, f"license_texts/{name}.txt") or b"").decode())
    return tuple((name, tuple(wordings)) for name, wordings in every.items())


TEMPLATES = _with_texts(_NOTICES)
#: Words of a template from which on differing words may name licenses too: whole texts name several.
LONG = 120
#: Words that name a license: none of them may differ from the template.
NAMES = frozenset("mit apache gnu general lesser affero gpl lgpl agpl bsd isc mozilla mpl unlicense cc0 cc by sa nc nd attribution sharealike noncommercial noderivatives creative commons public domain version v 1 2 3 4 0 clause".split())
_WORD = regex.compile(r"[\p{L}]+|\p{N}+")
_BEFORE = regex.compile(r"(?:^|\n|[.:;]\s)[\s*#/;>-]*\(?$")
_AFTER = regex.compile(r"[.)]\s")
SCHEMA = "doc_id bigint, first_line int, last_line int, license string, template int, reduction int, missing int, added int, exact boolean, differences string"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@functools.cache
def _tools(templates: tuple) -> tuple[zstandard.ZstdCompressor, list[tuple]]:
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    made = []
    for name, wordings in templates:
        for i, text in enumerate(wordings):
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append((name, i, words(text), collections.Counter(words(text)), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return plain, made


common.remembers(_tools.cache_clear)


def wording(block: list[str], template: list[str]) -> tuple[int, int, list[str]]:
    """(words of the template missing, words added between its own, the differences) for the best alignment."""
    runs = [m for m in difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), 0, [*template]
    matched = sum(m.size for m in runs)
    inside = block[runs[0].a : runs[-1].a + runs[-1].size]
    taken = {k for m in runs for k in range(m.a, m.a + m.size)}
    added = [w for k, w in enumerate(inside, runs[0].a) if k not in taken]
    have = {k for m in runs for k in range(m.b, m.b + m.size)}
    missing = [w for k, w in enumerate(template) if k not in have]
    return len(template) - matched, len(added), [*(f"-{w}" for w in missing), *(f"+{w}" for w in added)]


def _common(have: collections.Counter, template: collections.Counter) -> int:
    """Words of the template that the text has, in any order: no alignment matches more."""
    return sum(min(have[w], n) for w, n in template.items())


def _span(have: list[str], template: list[str]) -> tuple[int, int]:
    """The words of ``have`` (begin, end) that the best alignment with the template covers."""
    runs = [m for m in difflib.SequenceMatcher(None, have, template, autojunk=False).get_matching_blocks() if m.size]
    return (runs[0].a, runs[-1].a + runs[-1].size) if runs else (0, 0)


def _places(have: list[str], template: list[str], tolerance: float) -> list[int]:
    """Where the template may begin in ``have``: as its rarest words there say, each start once for some words around."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(have):
        at.setdefault(w, []).append(i)
    slack = max(1, int(tolerance * len(template)))
    # with a share of words missing, some of any slack + 1 of them are still there
    rare = sorted(range(len(template)), key=lambda k: len(at.get(template[k], ())))[: slack + 1]
    starts = sorted({max(0, i - k) for k in rare for i in at.get(template[k], ())})
    out: list[int] = []
    for x in starts:
        if not out or x > out[-1] + slack:
            out.append(x)
    return out


def notices(block: str, templates: tuple = TEMPLATES, tolerance: float = TOLERANCE) -> list[tuple]:
    """All confirmed wordings of a text that do not overlap, each as (begin, end, what :func:`identify` gives).

    Every wording is a raw dictionary: the stretches where it may stand, however long the text is, are compressed with
    it and without, and ranked by the size reduction. In that order they are confirmed by the exact differences in
    wording: at most ``tolerance`` of the wording's words may be missing and as many added, and no differing word may
    name a license or a version (but in whole texts of ``LONG`` words); numbers that count clauses may be left out. A
    confirmed stretch keeps its place from those of lower rank; of equal ones the first stays.
    """
    plain, made = _tools(templates)
    every, found = list(_WORD.finditer(block)), set()
    plainer = [m for m in every if not _clause(block, m)]
    for tokens in (every, plainer) if len(plainer) < len(every) else (every,):
        have = [m.group().lower() for m in tokens]
        counts = collections.Counter(have)
        for k, (name, i, template, bag, packer) in enumerate(made):
            least = (1 - tolerance) * len(template)
            if not template or _common(counts, bag) < least:
                continue
            slack = int(tolerance * len(template)) + 1
            for x in _places(have, template, tolerance):
                a, b = max(0, x - slack), min(len(have), x + len(template) + 3 * slack)
                part = have[a:b]
                if _common(collections.Counter(part), bag) < least:
                    continue
                begin, end = _span(part, template)
                first, last = tokens[a + begin].start(), tokens[a + end - 1].end()
                raw = block[first:last].encode()
                saved = len(plain.compress(raw)) - len(packer.compress(raw))
                found.add((-saved, -len(template), first, last, k, tuple(part[begin:end])))
    out: list[tuple] = []
    for saved, _, first, last, k, part in sorted(found):
        name, i, template = made[k][:3]
        if any(first < y and last > x for x, y, _ in out):
            continue
        missing, added, differ = wording(list(part), template)
        if missing <= tolerance * len(template) and added <= tolerance * len(template) and (len(template) >= LONG or not NAMES & {d[1:] for d in differ}):
            out.append((first, last, (name, i, -saved, missing, added, not differ, " ".join(differ))))
    return sorted(out)


def _clause(text: str, m: regex.Match) -> bool:
    """Whether a number begins a line or sentence and a mark and space follow it: "1. " or "(2) "."""
    return m.end() - m.start() < 3 and m.group().isdigit() and bool(_AFTER.match(text, m.end())) and bool(_BEFORE.search(text[max(0, m.start() - 80) : m.start()]))


def identify(block: str, templates: tuple = TEMPLATES, tolerance: float = TOLERANCE) -> tuple:
    """(license, wording, reduction, missing, added, exact, differences) of the first of the longest :func:`notices`; license None if there is none."""
    found = notices(block, templates, tolerance)
    if found:
        return max(found, key=lambda f: (f[1] - f[0], -f[0]))[2]
    return None, None, 0, None, None, False, None


def scan(docs: DataFrame, templates: tuple = TEMPLATES, cues: str = CUES, bridge: int = BRIDGE, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for every license that a block of lines with cues states, with the lines of its wording.

    A block runs from one line with a cue to the last that follows with at most ``bridge - 1`` other lines in
    between. Wordings are looked for in the lines around it too, as many words as the longest has. A block without a
    confirmed wording (a copyright line, an unknown license) and without a part in a block's wording before it has one
    row with ``license`` null and its own lines. Every line of every text is looked at. No shuffle.

    Nulls: a null or empty text has no blocks; a null doc_id is kept. Repeated rows give repeated results. Ties of rank go to
    the first. An empty table gives no rows. A very long text costs its own size in memory, its blocks the time of their words.
    """
    reach = 2 * max((len(words(x)) for _, wordings in templates for x in wordings), default=0)

    def of(lines: list[str], blocks: list[tuple[int, int]]) -> list[tuple]:
        size = [len(_WORD.findall(x)) for x in lines]
        areas: list[list] = []  # first line, last line, its blocks
        for first, last in blocks:
            a, b = first, last
            room = reach
            while a and room > 0:
                a -= 1
                room -= size[a]
            room = reach
            while b + 1 < len(lines) and room > 0:
                b += 1
                room -= size[b]
            if areas and a <= areas[-1][1]:
                areas[-1][1] = max(areas[-1][1], b)
                areas[-1][2].append((first, last))
            else:
                areas.append([a, b, [(first, last)]])
        out = []
        for a, b, mine in areas:
            text, stated = "\n".join(lines[a : b + 1]), []
            for begin, end, what in notices(text, templates, tolerance):
                stated.append((a + text.count("\n", 0, begin), a + text.count("\n", 0, end), *what))
            none = [(x, y, None, None, 0, None, None, False, None) for x, y in mine if not any(f[0] <= y and f[1] >= x for f in stated)]
            out += sorted(stated + none, key=lambda f: f[:2])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            text, out = batch.column("text"), []
            hits = np.flatnonzero(pc.match_substring_regex(text, cues).to_numpy(zero_copy_only=False))
            taken = text.take(pa.array(hits))
            parts = pc.split_pattern(taken.cast(pa.large_string()), "\n")
            off = np.asarray(parts.offsets).astype(np.int64)
            lines = parts.values
            cue = np.flatnonzero(pc.match_substring_regex(lines, cues).to_numpy(zero_copy_only=False)) if len(lines) else np.zeros(0, np.int64)
            row = np.searchsorted(off, cue, side="right") - 1
            ids = batch.column("doc_id").take(pa.array(hits)).to_pylist()
            for r in np.unique(row).tolist():
                at = cue[row == r] - off[r]
                cuts = np.flatnonzero(np.r_[True, np.diff(at) > bridge])
                blocks = list(zip(at[cuts].tolist(), at[np.r_[cuts[1:], len(at)] - 1].tolist()))
                out += [(ids[r], *f) for f in of(lines.slice(off[r], off[r + 1] - off[r]).to_pylist(), blocks)]
            cols = list(zip(*out)) if out else [[]] * 10
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "first_line", "last_line", "license", "template", "reduction", "missing", "added", "exact", "differences"])

    return common.mapped(common.project(docs), run, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
