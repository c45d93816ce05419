"""Mined rules against a brute-force search of all token sets, and on pages that would make plain mining explode."""

import random
from itertools import combinations

from folioscope.llm import urls


def brute(rows, support, confidence, lift, longest):
    """The rules (token set, confidence) by the module's definition, by trying every set."""
    n, bad = len(rows), sum(b for _, b in rows)
    where = {}
    for i, (toks, _) in enumerate(rows):
        for t in toks:
            where.setdefault(t, set()).add(i)
    groups = {}
    for t, at in where.items():
        groups.setdefault(frozenset(at), set()).add(t)
    hit = lambda at: sum(rows[i][1] for i in at)
    items = {at: ts for at, ts in groups.items() if hit(at) >= support * n and hit(at) * n > len(at) * bad}
    found = {}
    for size in range(1, longest + 1):
        for combo in combinations([a for a in items if size == 1 or hit(a) < len(a)], size):
            at = frozenset.intersection(*combo)
            if hit(at) >= support * n and at and hit(at) >= max(confidence, lift * bad / n) * len(at):
                found[frozenset(combo)] = hit(at) / len(at)
    kept = {c: x for c, x in found.items() if not any(found.get(frozenset(s), -1) >= x for k in range(1, len(c)) for s in combinations(c, k))}
    return {(frozenset().union(*[items[a] for a in c]), round(x, 9)) for c, x in kept.items()}


def test_rules_equal_brute_force(spark):
    seen = 0
    for seed in range(4):
        rnd = random.Random(seed)
        rows = []
        for _ in range(300):
            toks = {t for t in "abcdefgh" if rnd.random() < 0.35} | ({"x1", "x2", "x3"} if rnd.random() < 0.2 else set()) | {f"own{rnd.randint(0, 500)}"}
            p = 0.9 if {"a", "b", "c"} <= toks or {"d", "x1"} <= toks else 0.7 if {"e", "f"} <= toks else 0.08
            rows.append((sorted(toks), rnd.random() < p))
        rules, known = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support=0.02)
        got, same = rules.collect(), {}
        for r in known.collect():
            same.setdefault(r.item, set()).add(r.token)
        want = brute(rows, 0.02, 0.6, 1.5, 3)
        assert {(frozenset().union(*[same[x] for x in r.need]), round(r.confidence, 9)) for r in got} == want and all(r.filed in r.need for r in got)
        seen += len(want)
    assert seen > 4


def test_many_tokens_in_copies_of_a_url(spark):
    rows = [(i, "http://spam.test/" + "/".join(f"p{chr(97 + j)}" for j in range(26)) + "?x=y&z=w#top") for i in range(200)]
    rows += [(1000 + i, "http://spam.test/" + "/".join(f"p{chr(97 + j)}" for j in range(26) if (i * 7 + j) % 9) + "?x=y&z=w") for i in range(200)]
    rows += [(5000 + i, f"http://good{i % 9}.org/news/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 5000), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert all((v == "block") == (i < 5000) for i, v in got.items()) and len(got) == 700


def test_empty_tables(spark):
    pages, labels = (spark.createDataFrame([], s) for s in ("page_id long, url string", "doc_id long, quality int"))
    assert urls.judge(pages, labels).count() == 0
    some = spark.createDataFrame([(1, "http://a.b/c" + "/d" * 100_000), (1, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(some, labels).collect()] == ["allow", "allow"]
