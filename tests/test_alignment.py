"""Similarity of whole texts against difflib and the plain table, and on texts too long for these."""

import random
import time
from difflib import SequenceMatcher

from folioscope.operators.alignment import distance, ratio


def _plain(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def _changed(rnd, text, letters):
    out = list(text)
    for _ in range(rnd.randrange(1, 12)):
        i, n = rnd.randrange(len(out) + 1), rnd.randrange(8)
        out[i : i + rnd.randrange(8)] = rnd.choices(letters, k=n) if rnd.random() < 0.7 else out[:n]
    return "".join(out)


def test_ratio_and_distance_equal_the_plain_ones():
    rnd = random.Random(5)
    for round_ in range(900):
        letters = ["ab", "abcdefg .", "etaoinshrdlu     .,;QXZ0123456789", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))][round_ % 4]
        a = "".join(rnd.choices(letters, k=rnd.randrange(0, 500)))
        if rnd.random() < 0.2:
            a = a[:40] * 12
        b = _changed(rnd, a, letters) if rnd.random() < 0.8 else "".join(rnd.choices(letters, k=rnd.randrange(0, 500)))
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()
        assert distance(a[:120], b[:120]) == _plain(a[:120], b[:120])
    assert ratio("", "") == 1.0 and ratio("", "x") == 0.0 and distance([], []) == 0


def test_long_texts_are_compared_in_seconds():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("etaoinshrdluq7Z", k=rnd.randrange(2, 9))) for _ in range(900)] + ["end", "then", "open,"] * 30
    text = " ".join(rnd.choices(words, k=20_000))
    other = text.replace("en", "an")
    began = time.process_time()
    assert 0 < ratio(text, other) < 1
    assert distance(text.split(), other.split()) == sum("en" in w for w in text.split())
    assert time.process_time() - began < 30
