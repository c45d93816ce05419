"""Exact similarity of two long texts: difflib's ratio and the edit distance, without their square cost in practice.

``ratio`` finds the blocks of ``difflib.SequenceMatcher(None, a, b)``, its rule for popular characters included, in the same
order. difflib searches the remaining rectangle anew for each block. Here substrings of rare characters have names
(doubling), and places by name are looked up: a rectangle to the left of a block can only hold shorter ones, one to the
right none longer, so that a place is looked at about once for each length.

``distance`` is Levenshtein's by bit vectors (Myers, Hyyro), a column of the table being one integer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from operator import ne

#: Lengths up to which the places of all substrings are kept, and how many tables are kept in all.
_SHORT, _KEPT = 16, 24


class _Places:
    """Where substrings of rare characters of b stand in a and b."""

    def __init__(self, a: str, b: str):
        count, most = Counter(b), len(b) // 100 + 1
        rare = "".join(c for c, n in count.items() if len(b) < 200 or n <= most)
        runs = re.compile(f"[{re.escape(rare)}]+").finditer if rare else lambda _: ()
        self.texts, self.runs = (a, b), [[m.span() for m in runs(text)] for text in (a, b)]
        self.longest = max((end - start for start, end in self.runs[1]), default=0)
        self.code, self.names = {c: k for k, c in enumerate(rare)}, []
        self.tables: dict[int, tuple[list[int], list[list[int]]]] = {}
        self.n = len(b)

    def _named(self, p: int) -> tuple[list[int], list[int]]:
        """Names of the substrings of 2**p characters that start at each place; -1: not all rare, or not in b."""
        if not self.names:
            self.names.append(tuple([self.code.get(c, -1) for c in text] for text in self.texts))
        while len(self.names) <= p:
            half = 1 << (len(self.names) - 1)
            a, b = self.names[-1]
            named: dict[tuple[int, int], int] = {}
            of_b = [named.setdefault((x, y), len(named)) if x >= 0 <= y else -1 for x, y in zip(b, b[half:])]
            self.names.append(([named.get((x, y), -1) for x, y in zip(a, a[half:])], of_b))
        return self.names[p]

    def _short(self, size: int) -> tuple[list[int], list[list[int]]]:
        """As _table for whole texts, by the substrings themselves."""
        (a, b), held = self.texts, {}
        for start, end in self.runs[1]:
            for j in range(start, end - size + 1):
                held.setdefault(b[j : j + size], []).append(j)
        starts = [(i, found) for start, end in self.runs[0] for i in range(start, end - size + 1) if (found := held.get(a[i : i + size]))]
        return [i for i, _ in starts], [found for _, found in starts]

    def _table(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[list[int], list[list[int]]]:
        """Places in a, in order, whose substring of the size is in b, and its places there."""
        p = size.bit_length() - 1
        off, (a, b) = size - (1 << p), self._named(p)
        held: dict[tuple[int, int], list[int]] = {}
        upto = max(blo, bhi - size + 1)
        for j, (x, y) in enumerate(zip(b[blo:upto], b[blo + off : upto + off]), blo):
            if x >= 0 <= y:
                held.setdefault((x, y), []).append(j)
        upto = max(alo, ahi - size + 1)
        starts = [(i, found) for i, pair in enumerate(zip(a[alo:upto], a[alo + off : upto + off]), alo) if (found := held.get(pair))]
        return [i for i, _ in starts], [found for _, found in starts]

    def first(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first place in a[alo:ahi], then in b[blo:bhi], of a common substring of the size."""
        table = self.tables.get(size)
        if table is None:
            if size <= _SHORT:
                table = self.tables[size] = self._short(size)
            elif 4 * (bhi - blo) >= self.n:
                if len(self.tables) >= _KEPT:
                    self.tables.pop(next((k for k in self.tables if k > _SHORT), size), None)
                table = self.tables[size] = self._table(size, 0, len(self.texts[0]), 0, self.n)
            else:
                table = self._table(size, alo, ahi, blo, bhi)
        starts, places = table
        for s in range(bisect_left(starts, alo), len(starts)):
            if starts[s] > ahi - size:
                return None
            own = places[s]
            if (t := bisect_left(own, blo)) < len(own) and own[t] <= bhi - size:
                return starts[s], own[t]
        return None


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib.SequenceMatcher(None, a, b)."""
    places = _Places(a, b)
    total, left = 0, [(0, len(a), 0, len(b), places.longest)]
    while left:
        alo, ahi, blo, bhi, most = left.pop()
        if alo >= ahi or blo >= bhi:
            continue
        size = min(most, ahi - alo, bhi - blo)
        hit = places.first(size, alo, ahi, blo, bhi) if size else None
        if hit is None:
            low, high = 0, size
            while high - low > 1:
                middle = (low + high) // 2
                if found := places.first(middle, alo, ahi, blo, bhi):
                    low, hit = middle, found
                else:
                    high = middle
            size = low
        i, j = hit or (alo, blo)
        end = i + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        shift = j - i
        while end < ahi and end + shift < bhi and a[end] == b[end + shift]:
            end += 1
        total += end - i
        if hit:
            left.append((alo, i, blo, j, size - 1))
            left.append((end, ahi, end + shift, bhi, size))
    return total


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2.0 * matched(a, b) / (len(a) + len(b))


def distance(x: Sequence[str], y: Sequence[str]) -> int:
    """Insertions, deletions and replacements of elements that turn x into y, at least."""
    if len(x) < len(y):
        x, y = y, x
    low, tail = 0, 0
    while low < len(y) and x[low] == y[low]:
        low += 1
    while tail < len(y) - low and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[low : len(x) - tail], y[low : len(y) - tail]
    if not y:
        return len(x)
    if len(x) == len(y) and (replaced := sum(map(ne, x, y))) == (Counter(x) - Counter(y)).total():
        return replaced  # no fewer, as each takes one surplus element away at most
    at: dict[str, bytearray] = {}
    for i, token in enumerate(x):
        if token not in at:
            at[token] = bytearray(i // 8 + 1)
        bits = at[token]
        bits.extend(bytes(i // 8 + 1 - len(bits)))
        bits[i // 8] |= 1 << i % 8
    equal = {token: int.from_bytes(bits, "little") for token, bits in at.items()}
    every = (1 << len(x)) - 1
    up, down, last, found = every, 0, 1 << (len(x) - 1), len(x)
    for token in y:
        same = equal.get(token, 0)
        across = ((((same & up) + up) ^ up) | same) & every
        more, less = down | (every ^ (across | up)), up & across
        found += 1 if more & last else -1 if less & last else 0
        more, less, stay = (more << 1 | 1) & every, (less << 1) & every, same | down
        up, down = less | (every ^ (stay | more)), more & stay
    return found
