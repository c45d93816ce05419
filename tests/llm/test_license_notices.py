"""License notices inside longer lines and beside one another."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from folioscope.llm import licenses


def found(text):
    return [x[2] for x in licenses._scanner(0.1, 2000).scan(text)]


@pytest.mark.parametrize("n", [10, 20, 40, 100])
def test_notice_after_other_words_on_its_line(n):
    rnd = random.Random(n)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    assert found(" ".join(words) + " Released under the MIT License. and more") == ["MIT"]
    assert found("released the license under " + " ".join(words) + " Released under the MIT License.") == ["MIT"]


def test_adjacent_notices():
    assert found("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]


def test_every_template_wins_at_its_own_wording():
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert set(found(f"the license of this work: {text} is what holds")) == {name}, text


def test_scan_counts_windows_and_reports_all(spark):
    rows = [(1, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (2, "a license of some kind")]
    got = {r.doc_id: (r.licenses, r.n_candidates, len(r.spans)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text"))).collect()}
    assert got == {1: (["Apache-2.0", "MIT"], 2, 2), 2: ([], 1, 1)}


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def licensed(text):
    return {x for x in found(text) if x}


@pytest.mark.parametrize("width", [30, 72, 10_000])
@pytest.mark.parametrize("text, name", [(MIT, "MIT"), (BSD + THIRD, "BSD-3-Clause"), (BSD, "BSD-2-Clause"), (ISC, "ISC"), (GPL, "GPL-3.0"), ("SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0")])
def test_full_texts_wrapped_and_in_a_line(text, name, width):
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n"))
    assert name in licensed("Some words first.\n\n" + wrapped + "\n\nand after.") <= {name, "BSD-2-Clause"}
    assert name in licensed("words before it " + " ".join(text.split()) + " and after")


def test_changed_words_are_reported():
    text = MIT.replace("merge, publish", "merge, maybe print").replace("free of charge", "of charge")
    hits = [x for x in licenses._scanner(0.1, 2000).scan(text) if x[2] == "MIT"]
    assert any(sorted(x[4]) == ["free", "publish"] and x[5] == 2 for x in hits)
    assert all(text[x[0] : x[1]].startswith("Permission is") for x in hits)
    assert licensed(" ".join(w for i, w in enumerate(GPL.split()) if i % 3)) == set()
    assert licensed(GPL.replace("version 3", "version 9")) == set()


def test_alignment_equals_brute_force():
    from itertools import combinations

    rnd = random.Random(5)
    for _ in range(200):
        want, have = [rnd.choice("abcd") for _ in range(rnd.randint(1, 5))], [rnd.choice("abcd") for _ in range(rnd.randint(1, 7))]
        best = len(want)
        for k in range(1, len(want) + 1):
            for rows in combinations(range(len(want)), k):
                for cols in combinations(range(len(have)), k):
                    if all(want[i] == have[j] for i, j in zip(rows, cols)):
                        best = min(best, len(want) - k + cols[-1] - cols[0] + 1 - k)
        start, end, missing, inserted, cost = licenses.alignment(want, have, set())
        assert cost == best == len(missing) + inserted


def test_templates_rank_by_their_saving():
    scanner = licenses._scanner(0.1, 2000)
    for name, texts in licenses.FULL.items():
        for text in texts:
            first = scanner.rank(text)[:2]
            assert name in {scanner.each[i][0] for i in first}, text
