"""Pages grown many at a time against one page after the other."""

import random

from folioscope.functions import layout as ly
from folioscope.operators import clusters as cl

SCHEMA = "doc_id long, page long, ord long, text string, x0 double, y0 double, x1 double, y1 double, left double, right double, seed0 double, seed2 double, target boolean"


def plain(rows, close=28.0, reach=24.0, band=16.0):
    """rows of one page by ord, each (ord, number, fragment, prose, x0, y0, x1, y1, left, right, seed0, seed2, target)."""
    if not any(r[-1] for r in rows):
        return []
    gap = lambda a, b: max(0.0, a[5] - b[7], b[5] - a[7])
    t = next(r for r in rows if r[-1])
    foreign = [r for r in rows if r[1] and t[1] and r[1] != t[1]]
    inside = [r for r in rows if r[4] <= t[6] + 8 and r[6] >= r[8] - 1 and r[4] <= r[9] + 1 and r not in foreign]
    taken, before = [t], 0
    while len(taken) != before:
        before, low, high = len(taken), min(r[4] for r in taken), max(r[6] for r in taken)
        for r in [r for r in inside if r[2] and r not in taken]:
            d = min(gap(r, x) for x in taken)
            other = min((gap(r, x) for x in foreign), default=float("inf"))
            shared = min(r[6], r[11] + 8) - max(r[4], r[10] - 8)
            on_seed = shared > 0 and shared >= min(6.0, 0.2 * max(1.0, r[6] - r[4]))
            if d <= reach and other + 1 >= d and (r[4] <= high + close and r[6] >= low - close or on_seed):
                taken.append(r)
    mid = lambda r: 0.5 * (r[5] + r[7])
    return sorted({r[0] for r in taken} | {r[0] for r in inside if not r[3] and abs(mid(r) - mid(t)) <= band})


def test_pages_of_any_size_equal_a_plain_loop(spark, monkeypatch):
    rnd, rows = random.Random(4), []
    for p in range(160):
        n = rnd.choice([1, 2, 3, 5, 8, 9, 40])
        goal = rnd.choice([None, *range(n)])
        for i in range(n):
            x, y = rnd.uniform(0, 300), rnd.uniform(0, 30 * n)
            text = rnd.choice(["x = 1 (3)", "a + b (4)", "y_1 = 2", "word", "this is where the model that is known as prose goes on", None])
            rows.append((None if p == 0 else p // 3, p % 3, i, text, x, y, x + rnd.uniform(1, 200), y + 12, 20.0, 400.0, 60.0, 200.0, None if i % 7 == 6 and i != goal else i == goal))
    d = spark.createDataFrame(rnd.sample(rows, len(rows)), SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # pages lie across batches
    try:
        got = sorted((str(r.doc_id), r.page, r.ord) for r in cl.clusters(d).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known, pages = d.select("*", ly.line_number(d.text).alias("number"), ly.math_fragment(d.text).alias("fragment"), ly.prose(d.text).alias("prose")).collect(), {}
    for r in sorted(known, key=lambda r: r.ord):
        pages.setdefault((str(r.doc_id), r.page), []).append((r.ord, r.number or "", bool(r.fragment), bool(r.prose), r.x0, r.y0, r.x1, r.y1, r.left, r.right, r.seed0, r.seed2, bool(r.target)))
    want = sorted((*k, i) for k, v in pages.items() for i in plain(v))
    assert got == want and len(want) > 150


def test_lines_are_not_grown_page_by_page(spark):
    plan = cl.clusters(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
