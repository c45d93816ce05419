"""Near copies against brute force over exact five-word Jaccard."""

import random
import re

import pytest

from folioscope.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, source string"


def five(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def kept(rows, similarity=0.8):
    sets, up = [five(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted((k[0], k[1]) for k in best.values())


def got(spark, rows, **more):
    out = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out)


def planted(rnd):
    words = [f"w{i}" for i in range(3000)]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(3, 200))] for _ in range(40)]
    for base in texts[:25]:
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy)
    return [(i, " ".join(t), "a") for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard_shingles", [20_000_000, 300])
def test_near_copies_equal_brute_force(spark, shard_shingles):
    rows = planted(random.Random(3)) + [(900, None, "a"), (901, "", "a"), (902, "one two", "a"), (903, "One  two", "a")]
    assert got(spark, rows, shard_shingles=shard_shingles) == kept(rows)


def test_copies_beyond_three_bits_go(spark):
    rows = planted(random.Random(5))
    out = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [k[1] for k in kept(rows)]


def test_null_and_repeated_ids(spark):
    a, b, c = ("red fox jumps over the lazy dog " * 3), "quite another text with seven words", "a third text that nobody has written"
    rows = [(None, a, "x"), (None, a, "y"), (None, b, "x"), (7, b, "x"), (8, a + "x", "x"), (9, c, "x"), (9, "this one shares its number with a third", "y")]
    assert got(spark, rows) == kept(rows) == [(False, 7), (False, 8), (False, 9), (False, 9)]
    assert got(spark, [(None, a, "x"), (None, a, "y")]) == [(True, 0)]


def test_trees_find_near_copies_by_fingerprint(monkeypatch):
    rnd = random.Random(7)
    sets = [near_copies.shingles(t.encode(), 5) for _, t, _ in planted(rnd)]
    far = []
    for i, a in enumerate(sets):
        far += [(near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).bit_count() for b in sets[:i] if near_copies.alike(a, b, 0.8)]
    assert far and 3 < max(far) <= near_copies.reach(0.8) < 32
    links = []
    for radius in (near_copies.reach(0.8), -1):
        monkeypatch.setattr(near_copies, "reach", lambda _, r=radius: r)
        shard = near_copies.Shard(0.8)
        links.append(sum(len(shard.add(i, s, near_copies.bands(s, 0.8).tolist())) for i, s in enumerate(sets)))
    assert links[0] > 20 and links[1] == 0
