"""Disclosing terms against a brute-force version of the same definitions."""

import math
import random
import re

import pytest

from folioscope.llm import pii

WORD = re.compile(r"[^\W_]{2,}")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return {w.lower() for w in WORD.findall(text)}


def near(text, start, end, reach):
    """Whole words with all their letters within reach, none that touches the entity."""
    out = set()
    for m in re.finditer(r"[^\W_]+", text):
        if len(m.group()) >= 2 and (max(0, start - reach) <= m.start() and m.end() < start or m.start() > end and m.end() <= min(len(text), end + reach)):
            cut = m.start() == start - reach > 0 or m.end() == end + reach < len(text)
            if not cut:
                out.add(m.group().lower())
    return out


def brute(rows, reach, share, least):
    texts, found, names = {}, {}, {}
    for t in rows:
        texts[t or ""] = texts.get(t or "", 0) + 1
    for t in texts:
        spans = [("email", m) for m in MAIL.finditer(t)] + [("phone", m) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        for kind, m in spans:
            mine = [f"{kind}:{m.group().lower()}"]
            own = set()
            if kind == "email":
                local = m.group().split("@")[0]
                pooled = re.sub("[^a-z]+", "", local.lower())
                mine += ["mailbox:" + pooled] if len(pooled) > 1 else []
                own = {w for w in words(local) if not w.isdigit()} & words(MAIL.sub("\n", t))
            for e in mine:
                names.setdefault(e, set()).add(t)
                for w in near(t, m.start(), m.end(), reach) | own:
                    x = found.setdefault((e, w), [set(), False])
                    x[0].add(t)
                    x[1] |= w in own
    n, out = len(rows), set()
    count = lambda ts: sum(texts[t] for t in ts)
    for (e, w), (ts, own) in found.items():
        size, anywhere = count(names[e]), count([t for t in texts if w in words(t)])
        if (len(ts) >= least or own) and size < n and 1 + math.log(count(ts) / anywhere) / math.log(n / size) >= share - 1e-12:
            out.add((w, e))
    return out


@pytest.mark.parametrize("reach", [9, 40])
def test_terms_equal_brute_force(spark, reach):
    rnd = random.Random(reach)
    people = [f"{a}.{b}" for a in ("jane", "omar", "li", "ève") for b in ("doe", "roe")]
    rows = [None, "", None]
    for _ in range(140):
        who = rnd.choice(people)
        parts = [f"w{rnd.randint(0, 25)}" for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice([f"{who}@{rnd.choice(['x.org', 'y.com'])}", f"{who}{rnd.randint(1, 3)}@z.io", who.replace(".", " "), who.split(".")[0].title(), f"secret{rnd.randint(0, 4)} +1 222 333 444{rnd.randint(0, 3)}"]))
        rows.append(" ".join(parts))
    rows += rows[10:20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {(r.term, r.entity) for r in pii.disclosing(docs, reach=reach, share=0.6).collect()}
    want = brute(rows, reach, 0.6, 2)
    assert got == want and len(want) > 5


def test_a_word_that_the_reach_cuts_is_no_term(spark):
    rows = [(i, "mother " + "x" * 5 + f" a@b.org tail{i}") for i in range(4)] + [(9 + i, f"her word {i}") for i in range(30)]
    terms = {r.term for r in pii.disclosing(spark.createDataFrame(rows, "doc_id long, text string"), reach=9).collect()}
    assert "her" not in terms and "mother" not in terms and "xxxxx" in terms


def test_rare_owner_is_found_in_one_text(spark):
    rows = [(0, "Ask Zoltan first. " + "word " * 200 + "zoltan.kovacs7@mail.org"), (1, "Zoltan")] + [(i, "word and word") for i in range(2, 400)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), share=0.8).collect()}
    assert [(s.kind, s.start) for s in found[0]] == [("email", 1018), ("term", 4)] and [s.kind for s in found[1]] == ["term"]
    assert all(not found[i] for i in range(2, 400))
