"""Texts that hold one another against a comparison of all with all."""

import random

from pyspark.sql import functions as F

from folioscope.operators import containment, reconcile


def _texts(rnd):
    base = ["".join(rnd.choice("abé \n") for _ in range(rnd.randint(24, 700))) for _ in range(12)] + ["a" * 24, "a" * 300, "ab" * 90]
    cut = lambda t: t[(i := rnd.randint(0, len(t) - 24)) : rnd.randint(i + 24, len(t))]
    return base + [cut(t) for t in base for _ in range(6)] + [f"none {i} {t}" for i, t in enumerate(base)] + ["x" + t for t in base] + ["short", "", base[0][:23]]


def test_keys_of_a_part_are_among_those_of_the_whole():
    rnd = random.Random(1)
    for least in (1, 3, 24, 100):
        for t in _texts(rnd):
            b = t.encode()
            for _ in range(5):
                if len(b) >= least:
                    i = rnd.randint(0, len(b) - least)
                    assert containment.sought(b[i : rnd.randint(i + least, len(b))], least) in containment.held(b, least)


def test_a_long_text_meets_few_others():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("red fox jumps over lazy dogs and cats".split()) + str(rnd.randint(0, 999)) for _ in range(300)).encode() for _ in range(60)]
    keys = [set(containment.held(t, 24).tolist()) for t in texts]
    assert sum(int(containment.sought(t, 24)) in k for i, t in enumerate(texts) for j, k in enumerate(keys) if i != j) < 5


def test_pairs_and_lookup_against_all_pairs(spark):
    rnd = random.Random(3)
    texts = _texts(rnd)
    rows = [(i % 3, i, rnd.choice(texts)) for i in range(150)]
    outcomes = [(i % 3, rnd.choice([i, -i]), rnd.choice(texts), rnd.choice(["ok", "bad"])) for i in range(1, 150)]
    want = {}
    for doc, i, raw in rows:
        mine = [o for o in outcomes if o[0] == doc]
        tiers = [[o for o in mine if o[1] == i], [o for o in mine if o[2] == raw], [o for o in mine if len(raw) >= 24 and len(o[2]) >= 24 and (raw in o[2] or o[2] in raw)]]
        at = next((k for k, t in enumerate(tiers, 1) if t), None)
        want[doc, i] = (min(tiers[at - 1], key=lambda o: o[1])[3] if at else None, at)
    r, o = spark.createDataFrame(rows, "doc long, id long, raw string"), spark.createDataFrame(outcomes, "doc long, oid long, text string, outcome string")
    got = {(x.doc, x.id): (x.outcome, x.tier) for x in reconcile.tiered_lookup(r, o).collect()}
    assert got == want and sum(t == 3 for _, t in want.values()) > 10
    none = reconcile.tiered_lookup(r.withColumn("raw", F.lit("short")), o.limit(0)).collect()
    assert len(none) == 150 and {x.tier for x in none} == {None}
