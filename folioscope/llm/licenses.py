"""License scans by conditional compression.

Candidate blocks are the lines that hold a cue word with the lines of their paragraph around them, as far as the longest
template reaches. Each block is compressed alone and with every template as a zstandard raw-content dictionary; what a
template saves ranks the templates and drops none. A template is confirmed wherever the block really holds its wording:
at the best local alignment its words occur in order, with at most ``slack`` of them missing and as many inserted, none of
its distinctive words (names, numbers) missing; the exact missing words and the number of inserted ones are reported, with
the exact span of the notice and what the template saves on it. Of confirmed templates whose words overlap the one
that explains most words, less two a difference, wins; all others stand. Blocks over ``window`` characters are read by
windows that overlap by half, so a long text is scanned whole and a notice of up to half a window is never cut.
Templates are the short notices, the paragraphs of the full texts that name their license alone, and SPDX tags. Defined
results: null and empty texts hold no block; a block that no template explains is one candidate without a license; ties
go to the better ranked template, then the earlier name; repeated rows give repeated rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices of common licenses, by SPDX identifier; several wordings each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "WTFPL": ("You just DO WHAT THE FUCK YOU WANT TO.",),
}
#: Paragraphs of full texts.
FULL: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "MPL-2.0": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}
CUES = ("licen", "copyright", "public domain", "permission", "creative commons", "cc by", "cc0", "spdx", "redistribut", "warrant")
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_CUE = re.compile("|".join(CUES), re.IGNORECASE)
#: Words that any notice may hold; the others of a template are distinctive.
_COMMON = frozenset(
    "a an and any as associated at by charge compliance copy documentation either except file files form free granted hereby in international into is license licensed "
    "may not obtaining of or permission person project public published released software source subject terms the this to under use v version work you code".split()
)
#: Words that name a license: the distinctive ones of a template of more than LONG words, beside numbers.
_NAMES = frozenset("affero agpl apache boost bsd cc commons creative eclipse gnu gpl isc lesser lgpl mit mozilla mpl nc sa spdx unencumbered".split())
LONG = 24


def distinctive(need: list[str]) -> set[str]:
    return {w for w in need if (w in _NAMES or w[0].isdigit() if len(need) > LONG else w not in _COMMON)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def alignment(want: list[str], have: list[str], marked: set[str]) -> tuple[int, int, list[str], int, int]:
    """(start, end, missing words, inserted words, cost) of the cheapest way to read want in order somewhere in have.

    A word of want that isn't read costs 1, a distinctive one more than all words together; a word read over costs 1, but
    not before the first or after the last. Of equal costs the earliest end, then the latest start.
    """
    n, heavy = len(want), len(want) + len(have) + 1
    cost = [[0] * (len(have) + 1)]
    for w in want:
        gone, above = heavy if w in marked else 1, cost[-1]
        row = [above[0] + gone]
        for j, h in enumerate(have):
            best = min(above[j + 1] + gone, row[j] + 1)
            row.append(min(best, above[j]) if w == h else best)
        cost.append(row)
    end = j = min(range(len(have) + 1), key=lambda x: cost[n][x])
    i, missing, inserted = n, [], 0
    while i:
        gone = heavy if want[i - 1] in marked else 1
        if j and want[i - 1] == have[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + gone:
            missing.append(want[i - 1])
            i -= 1
        else:
            inserted, j = inserted + 1, j - 1
    return j, end, missing[::-1], inserted, cost[n][end]


def aligned(want: list[str], have: list[str], marked: set[str], most: float) -> list[tuple[int, int, list[str], int]]:
    """(start, end, missing words, inserted words) of want in have, the best around each occurrence of a distinctive word.

    Without distinctive words, around the rarest of all: of one word more than may be missing, one at least is there.
    """
    n, slack, out = len(want), int(most), {}
    rare = sorted(marked or set(want), key=lambda x: (have.count(x), x))
    for w in rare[: 1 if marked else slack + 1]:
        q = want.index(w)
        for p in (p for p, x in enumerate(have) if x == w):
            if p >= q and have[p - q : p - q + n] == want:
                out[p - q] = (p - q, p - q + n, [], 0)
                continue
            low = max(0, p - n - slack)
            start, end, missing, inserted, _ = alignment(want, have[low : p + n + slack + 1], marked)
            if len(missing) <= most and inserted <= most and not marked & set(missing):
                out.setdefault(low + start, (low + start, low + end, missing, inserted))
    return list(out.values())


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], slack: float, window: int):
        self.slack, self.window = slack, window
        self.alone = zstandard.ZstdCompressor(level=9)
        self.each = []
        for name in sorted(templates):
            for text in templates[name]:
                given = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                need = words(text)
                self.each.append((name, zstandard.ZstdCompressor(level=9, dict_data=given), need, distinctive(need)))
        self.reach = max(len(t) for texts in templates.values() for t in texts)

    def saved(self, text: str, i: int, alone: int | None = None) -> float:
        """The share of text's compressed size that template i saves."""
        data = text.lower().encode("utf-8", "replace")
        return 1 - len(self.each[i][1].compress(data)) / (alone or len(self.alone.compress(data)))

    def rank(self, block: str) -> list[int]:
        """Templates, those that save most on the block first; ties to the earlier name."""
        alone = len(self.alone.compress(block.lower().encode("utf-8", "replace")))
        return sorted(range(len(self.each)), key=lambda i: (-self.saved(block, i, alone), i))

    def confirm(self, block: str) -> list[tuple[int, int, str, float, list[str], int]]:
        """(start, end, license, share saved on the notice, missing words, inserted words) of each notice, in order."""
        places = [m.span() for m in _WORD.finditer(block.lower())]
        have = words(block)
        there, found = set(have), []
        for rank, i in enumerate(self.rank(block)):
            name, _, need, marked = self.each[i]
            if marked <= there:
                for start, end, missing, inserted in aligned(need, have, marked, self.slack * len(need)):
                    found.append(((2 * (len(missing) + inserted) - len(need), rank, start), (start, end, i, missing, inserted)))
        taken: list[tuple] = []
        for _, x in sorted(found, key=lambda f: f[0]):
            if all(x[1] <= t[0] or t[1] <= x[0] for t in taken):
                taken.append(x)
        out = []
        for start, end, i, missing, inserted in sorted(taken, key=lambda t: t[0]):
            low, high = places[start][0], places[end - 1][1]
            out.append((low, high, self.each[i][0], self.saved(block[low:high], i), missing, inserted))
        return out

    def blocks(self, text: str):
        """(start, end) of cue lines with their paragraphs' lines as far as the longest template reaches; apart from one another."""
        if not _CUE.search(text):
            return
        lines = [(m.start(), m.end(), bool(_CUE.search(m.group())), not m.group().strip()) for m in re.finditer(r"[^\n]*\n?", text) if m.group()]
        at = None
        for k in [k for k, x in enumerate(lines) if x[2]]:
            low = high = k
            while low and not lines[low - 1][3] and lines[k][0] - lines[low - 1][1] < self.reach:
                low -= 1
            while high + 1 < len(lines) and not lines[high + 1][3] and lines[high + 1][0] - lines[k][1] < self.reach:
                high += 1
            if at and lines[low][0] <= at[1]:
                at = (at[0], lines[high][1])
            else:
                if at:
                    yield at
                at = (lines[low][0], lines[high][1])
        if at:
            yield at

    def scan(self, text: str | None) -> list[tuple[int, int, str | None, float, list[str], int]]:
        """(start, end, license or None, share saved, missing, inserted) of each notice of each block; the block's bounds without one."""
        out = []
        text = text or ""
        if len(text.lower()) != len(text):  # letters that grow in lower case would shift spans
            text = "".join(c if len(c.lower()) == 1 else " " for c in text)
        for start, end in self.blocks(text):
            step, mine = self.window // 2, {}
            for low in range(start, max(start + 1, end - step), step):
                for x in self.confirm(text[low : min(low + self.window, end)]):
                    mine.setdefault((low + x[0], low + x[1], x[2]), x[3:])
            notices = [(*k, *v) for k, v in sorted(mine.items())]
            # what a window cut off gives way to the whole notice that the next window holds
            whole = [x for x in notices if not any(y[0] <= x[0] and x[1] <= y[1] and y[:2] != x[:2] for y in notices)]
            out += whole or [(start, end, None, 0.0, [], 0)]
        return out


@lru_cache(maxsize=1)
def _scanner(slack: float, window: int) -> Scanner:
    names = sorted({*TEMPLATES, *FULL})
    return Scanner({name: (*TEMPLATES.get(name, ()), *FULL.get(name, ()), f"SPDX-License-Identifier: {name}") for name in names}, slack, window)


_SPAN = "array<struct<start:long,end:long,license:string,saved:double,missing:array<string>,inserted:long>>"


def scan(docs: DataFrame, slack: float = 0.1, window: int = 2000) -> DataFrame:
    """doc_id, licenses (sorted identifiers), n_candidates (notices, and blocks without one), spans of each row."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("missing", pa.list_(pa.string())), ("inserted", pa.int64())])

    def run(batches):
        scanner = _scanner(slack, window)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            names = [sorted({x[2] for x in f if x[2]}) for f in found]
            rows = [[dict(zip(("start", "end", "license", "saved", "missing", "inserted"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array([len(f) for f in found], pa.int64()), pa.array(rows, pa.list_(span))], names=["doc_id", "licenses", "n_candidates", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, licenses array<string>, n_candidates long, spans {_SPAN}")
