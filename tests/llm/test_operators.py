"""The training-data operators against brute force, and on awkward input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import decontam, licenses, mixing, neighbours, pii, queries, simhash, substrings, token_counts, toxicity, urls

SF = "/root/testdata/sf0.01"
AWKWARD = [
    (1, None, None, None), (None, "no id here at all", "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, "same text twice " * 20, "en", "a"), (4, "same text twice " * 20, "en", "a"),
    (5, "same text twice " * 20, "fr", None), (6, "x" * 200_000, "en", "b"), (7, "word " * 60_000, "en", "b"), (8, "a@b.co +1 (222) 333-4444 1.2.3.4 4111 1111 1111 1111", "en", "b"), (9, "émoji 😀 ñ", "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["score", "fp", "size", "key", "pi", "bucket", "tokens", "node", "rank", "shard", "spans", "base", "n", "rule", "host", "_spans", "_key", "_kept", "_id", "_t", "row", "text_", "k", "source_size", "taken"]


def awkward(spark, rows=AWKWARD):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(score, label):
    rank, pos = score.rank().to_numpy(), label.to_numpy() == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# ---- 1 license scans


def test_licenses(spark):
    rows = [(1, "Intro.\nReleased under the MIT License.\nMore.", "", ""), (2, "Licensed under CC BY-NC 4.0.", "", ""), (3, "This license talk names none.", "", ""), (4, "licensed under the apache license, version 2.0", "", ""), (5, "Licensed under CC BY 4.0.", "", ""), (6, "under the GNU General Public License, version 4", "", ""), (7, ("licenses are many " * 200) + "Released under the MIT License.", "", "")]
    got = {r.doc_id: (r.licenses, r.n_candidates) for r in licenses.scan(awkward(spark, rows)).collect()}
    assert got[1] == (["MIT"], 1) and got[2] == (["CC-BY-NC-4.0"], 1) and got[3] == ([], 1) and got[4][0] == ["Apache-2.0"] and got[5][0] == ["CC-BY-4.0"] and got[6][0] == [] and got[7][0] == ["MIT"]


# ---- 2 toxicity


def test_toxicity_held_out(spark):
    labels = table(spark, "labels")
    docs = table(spark, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()
    held = scored[scored.held_out]
    assert auc(held.score, held.toxic) > 0.8 and len(held)


def test_toxicity_uses_no_held_out_label(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.slot, b.slot) and np.allclose(a.weight, b.weight) and a.bias == b.bias


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(awkward(spark), toxicity.fit(awkward(spark), none)).collect()} == {0}


# ---- 3 nearest neighbours


def test_recall(spark):
    emb = table(spark, "embeddings")
    got = neighbours.nearest(emb).toPandas()
    pdf = emb.toPandas()
    v, ids = np.stack([np.array(x, float) for x in pdf.embedding]), pdf.vec_id.to_numpy()
    at, hits = {i: n for n, i in enumerate(ids)}, []
    for q, g in got.groupby("query_id"):
        s = v @ v[at[q]]
        want = [ids[x] for x in np.lexsort((ids, -s)) if ids[x] != q][:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [s[at[x]] for x in g.vec_id])
        hits.append(len(set(want) & set(g.vec_id)) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_neighbours_awkward(spark):
    one = [1.0, 0.0]
    rows = [(i, one) for i in range(0, 60)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (120, [2.0, 1.0, 0.0]), (121, [0.0, 1.0, 1.0]), (140, [1.0]), (None, one), (20, one), (160, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))).toPandas()
    assert set(got.query_id) == {0, 20, 40, 120}
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(range(1, 21))
    assert list(got[got.query_id == 120].vec_id) == [121]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 4 token counts


def test_token_counts_match_the_tokenizer():
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = token_counts.load_vocabulary()
    floor = min(s for _, s in vocabulary)
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", floor) for i in range(256)), *vocabulary], 0, True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rnd, counter = random.Random(1), token_counts.Counter(vocabulary)
    alphabet = ["the", " ", "  ", "\n", "é", "日本", "😀", "▁", "x", "Und", "1234", "\u0301", "ing", "qz"]
    for text in [*("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)), "a" * 3000]:
        assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)


# ---- 5 mixing


def best_sum(sizes, budget):
    """The largest sum of some of sizes up to budget."""
    reached = 1
    for x in sizes:
        reached |= reached << x
    return (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_fit_counts_is_exact_where_lengths_allow():
    rnd = random.Random(2)
    for _ in range(300):
        lengths = np.array(sorted(rnd.sample(range(1, 30), rnd.randint(1, 6))))
        counts = np.array([rnd.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rnd.randint(0, total)
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((lengths * take).sum())
        assert got == best_sum(np.repeat(lengths, counts).tolist(), budget)
    big = mixing.fit_counts(np.array([100_000, 90_001, 7]), np.array([50, 50, 3]), 4_321_000)
    assert 0 <= 4_321_000 - (big * [100_000, 90_001, 7]).sum() < 100_000


def test_mix(spark):
    docs = table(spark, "documents")
    got = mixing.mix(docs).toPandas().sort_values("doc_id", ignore_index=True)
    text = docs.toPandas().set_index("doc_id")
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", text.text[i])) for i in got.doc_id] == list(got["size"])
    got["source"] = [text.source[i] for i in got.doc_id]
    sums = got.groupby("source").agg(S=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    weight, cap = np.array([(3, 1, 2)[i % 3] for i in range(len(sums))], float), 2.0 * sums.S.to_numpy()
    target, free, pool = np.zeros(len(sums)), np.ones(len(sums), bool), 1.5 * sums.S.sum()
    while True:
        share = (pool - target[~free].sum()) * weight / weight[free].sum()
        over = free & (share > cap)
        if not over.any():
            break
        target[over], free = cap[over], free & ~over
    target[free] = share[free]
    assert np.allclose(target, sums.target) and (got.taken <= 2 * got["size"]).all()
    for source, row in sums.iterrows():
        whole, rest = divmod(int(np.floor(row.target + 0.5)), int(row.S))
        want = whole * row.S + best_sum(got["size"][got.source == source].tolist(), rest)
        assert row.taken == want and abs(row.taken - row.target) < 3
    again = mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id", ignore_index=True)
    assert (again.taken == got.taken).all()


# ---- 6 decontamination


def brute_overlap(want, have, span=13, share=0.8):
    """Agreeing tokens of the best window over all alignments; 0 if it doesn't reach share."""
    size, best = min(span, len(want)), 0
    for shift in range(-len(want), len(have)):
        same = [0 <= shift + j < len(have) and have[shift + j] == w for j, w in enumerate(want)]
        best = max([best, *(sum(same[k : k + size]) for k in range(len(want) - size + 1))])
    return best if size and best >= share * size - 1e-9 else 0


def test_decontamination(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [[rnd.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 30, 60)]
    noise = lambda n: [rnd.choice([f"z{i}" for i in range(99)]) for _ in range(n)]
    rows = [(900, None, "", ""), (901, "", "", ""), (902, " ".join(noise(400)), "", "")]
    for i in range(250):
        item = list(rnd.choice(items[4:]))
        low = rnd.randint(0, max(0, len(item) - 8))
        item = item[low : low + rnd.randint(4, 20)]
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = "other"
        rows.append((i, " ".join(x.upper() + "," for x in noise(rnd.randint(0, 9)) + item + noise(rnd.randint(0, 9))), "", ""))
    rows += rows[:30]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, None), (77, "-")], "item_id long, text string")
    got = sorted((r.doc_id, r["items"], r.overlap, r.contaminated) for r in decontam.overlaps(awkward(spark, rows), bench).collect())
    want = []
    for d, text, _, _ in rows:
        have = re.findall("[a-z0-9]+", (text or "").lower())
        each = [brute_overlap(x, have) for x in items]
        want.append((d, [i for i, n in enumerate(each) if n], max(each), any(each)))
    assert got == sorted(want) and sum(w[3] for w in want) > 100
    kept = decontam.keep_clean(awkward(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[3])
    assert decontam.keep_clean(awkward(spark, rows), bench.limit(0)).count() == len(rows)


def test_masks_miss_nothing():
    from itertools import combinations

    for share in (0.8, 0.7):
        for size in range(1, 21):
            wrong = decontam.allowed(size, share)
            chosen = decontam.masks(size, wrong)
            for bad in combinations(range(size), wrong):
                assert any(all(t + p not in bad for p in m) for m in chosen for t in range(size - m[-1])), (size, bad)


def test_long_text_tokens():
    text = ("Aé1 " * 100_000 + "b" * 300_000 + " end").encode()
    small = decontam.tokens(b"a\xc3\xa91 x " + b"b" * 300_000 + b" END")
    got = decontam.tokens(text)
    assert len(got) == 100_002 and (got[:100_000] == small[0]).all() and got[-2] == small[2] and got[-1] == small[3]


# ---- 7 repeated substrings


def brute_repeats(rows, width=50):
    first, out = {}, []
    for d, t in rows:
        for j in range(len(t) - width + 1):
            k = t[j : j + width]
            first[k] = min(first.get(k, 1 << 64), substrings.LAST if d is None else d)
    for d, t in rows:
        gone, end = bytearray(len(t)), 0
        for j in range(len(t) - width + 1):
            if first[t[j : j + width]] < (substrings.LAST if d is None else d):
                gone[max(end, j) : j + width] = b"\1" * (j + width - max(end, j))
                end = j + width
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_substrings(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 300))) for _ in range(30)]
    rows = []
    for _ in range(150):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(base)
            a = rnd.randint(0, len(p))
            text += p[a : rnd.randint(a, len(p))] + rnd.choice(["", "é", "zz"])
        rows.append((rnd.choice([None, *range(100)]), text, "", ""))
    rows += [(200, "ab" * 100, "", ""), (201, "ab" * 300_000, "", ""), (5, None, "", "")]
    got = sorted(map(tuple, queries.repeats(awkward(spark, rows)).collect()), key=str)
    assert got == brute_repeats([(r[0], (r[1] or "").encode()) for r in rows])
    for r in substrings.remove_repeats(awkward(spark, [(1, "a" * 30 + "é" * 40, "", ""), (2, "zz" + "a" * 30 + "é" * 40 + "y", "", "")])).collect():
        assert (bytes(r.kept), [tuple(x) for x in r.removed]) == (b"zzy", [(2, 112)]) if r.doc_id == 2 else not r.removed


def test_merge_equals_sorting():
    rnd = random.Random(5)
    texts = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(50, 76))).encode() for _ in range(300)})
    keep, substrings.SHARD_BYTES = substrings.SHARD_BYTES, 900
    try:
        got = substrings.least_by_window(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.arange(len(texts)), 20)
    finally:
        substrings.SHARD_BYTES = keep
    first: dict = {}
    windows = [(i, t[j : j + 20]) for i, t in enumerate(texts) for j in range(len(t) - 19)]
    for i, w in windows:
        first.setdefault(w, i)
    assert got.tolist() == [first[w] for _, w in windows]


# ---- 8 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
    return kind != "card" or 16 <= len(digits) <= 19 and luhn % 10 == 0


def test_personal_data_base(spark):
    rnd = random.Random(6)
    bits = ["a", "b@", "1", "2", "3.", "4", "+", "-", " ", "(", ".", "@", "1234567890123456", "é", "x.y", "😀", "_", "4111 1111 1111 1111 ", "a@b.co", "1.2.3.4", "+1 222 333 4444"]
    rows = AWKWARD + [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))), "", "") for i in range(1500)] + [(9000, "1 " * 20_000, "", ""), (9001, "a@b.cc " * 5000, "", "")]
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.personal_data(awkward(spark, rows)).collect())
    want = []
    for r in rows:
        found = {k: [m for m in re.finditer(p, r[1] or "") if valid(k, m.group())] for k, p in PATTERNS.items()}
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
        want.append((str(r[0]), *(len(ms) for ms in found.values()), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)


def test_disclosing_terms(spark):
    rows = [(i, f"Call Jane on jane@x.com please {w}", "", "") for i, w in enumerate(("today", "soon", "now"))] + [(3 + i, "Call Bob on bob@y.org please today", "", "") for i in range(3)]
    rows += [(10 + i, f"words today soon now please call on {i}", "", "") for i in range(60)] + [(99, "Jane was here", "", ""), (100, None, "", "")]
    docs = awkward(spark, rows)
    spans = {r.doc_id: r.spans for r in queries.personal_data(docs).collect()}
    assert spans[0] == "email:13:23,term:5:9" and spans[3] == "email:12:21,term:5:8" and spans[99] == "term:0:4" and spans[20] == "" and spans[100] == ""
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.sanitise(docs).collect()}
    assert clean[0] == ("Call [TERM] on [EMAIL] please today", 35) and clean[99][0] == "[TERM] was here" and clean[100] == (None, None) and clean[20][0] == rows[16][1]


# ---- 9 URL filter


def test_url_filter(spark):
    spam = [(i, f"http://shop{i % 7}.test/pills/{i}?ref=spam") for i in range(60)] + [(100 + i, f"https://a{i % 9}.test/news/{i}") for i in range(200)]
    odd = [(900, "http://X.NET/a"), (901, "https://www.example.net/en/1?q"), (902, "http://b.example.com/de/"), (903, "ftp://w.org/fr/x#y"), (904, None), (905, "no url"), (906, "http://net"), (907, "http://z.test/pills/?ref=spam"), (907, "http://z.test/pills/?ref=spam"), (908, "x://fakenet/")]
    pages = spark.createDataFrame(spam + odd, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("bad", F.lit(1))
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i, _ in spam if i % 2 == 0] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert urls.judge(pages, labels).count() == len(spam) + len(odd)
    assert got[900] == ("x.net", "/a", "net/", "block") and got[901][2:] == ("example.net/en/", "allow") and got[902][2:] == ("example.com/de/", "block") and got[903] == ("w.org", "/fr/x", "org/fr/", "allow")
    assert got[904] == ("", "", None, "allow") and got[905] == ("", "", None, "allow") and got[906] == ("net", "", None, "allow") and got[907][2:] == (None, "block") and got[908][3] == "allow"
    assert all(got[i][3] == "block" for i in range(60)) and all(got[100 + i][3] == "allow" for i in range(200))
    assert {r.verdict for r in urls.judge(pages, labels.limit(0)).collect()} == {"allow", "block"}


# ---- 10 SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids, radius=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), 1 << 64), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(spark):
    rows = AWKWARD + [(100 + r.doc_id, r.text, "", "") for r in table(spark, "documents").limit(300).collect()]
    got = simhash.near_duplicates(awkward(spark, rows)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = classes(fps, [r[0] for r in rows])
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(str((r[0], f"{f:016x}", c)) for r, f, c in zip(rows, fps, want))


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_links_lose_nothing(spark, shard_rows):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for _ in range(rnd.randint(1, 4)):
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randint(0, 63)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), shard_rows)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [roots.get(s, s) for s in signed] == classes_signed(fps, signed)


def classes_signed(fps, signed):
    return classes(fps, signed)


def test_components_on_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (300, 302), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[302] == 300 and len(got) == 204


# ---- all


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    docs = awkward(spark)
    docs = docs.limit(0) if empty else docs
    labels, bench = table(spark, "labels"), table(spark, "benchmark")
    n = 0 if empty else len(AWKWARD)
    for out in (licenses.scan(docs), toxicity.score(docs, toxicity.fit(docs, labels)), token_counts.token_counts(docs), mixing.mix(docs), decontam.overlaps(docs, bench), substrings.remove_repeats(docs), queries.personal_data(docs), simhash.near_duplicates(docs)):
        assert out.count() == n
    for out in (toxicity.keep_clean(docs, labels), decontam.keep_clean(docs, bench), pii.sanitise(docs), simhash.keep_one(docs)):
        assert out.columns == docs.columns and out.count() <= n
    if not empty:
        kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
        assert sorted(x for x in kept if x is not None) == [1, 4, 6, 7, 8, 9] and kept.count(None) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    docs = table(spark, "documents")
    labels = table(spark, "labels")
    items = [ascii_tokens(r.text) for r in table(spark, "benchmark").collect()]
    grams = {tuple(x[i : i + 3]) for x in items for i in range(len(x) - 2)}  # of a window that agrees, some three in a row do
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for _, t in rows)]
    rows = [r for r, c in zip(rows, near_classes(sets, [d for d, _ in rows])) if r[0] == c]
    clean = {}
    for d, text in rows:
        have = ascii_tokens(text)
        if not any(tuple(have[i : i + 3]) in grams for i in range(len(have))) or not any(brute_overlap(x, have) for x in items):
            clean[d] = text
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(clean) and {"text", "lang", "source", "n_chars", "taken"} <= set(got.columns)
    assert abs(got.taken.sum() / got["size"].sum() - 1.5) < 0.01
    for d, text, size, chars in zip(got.doc_id, got.text, got["size"], got.n_chars):
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and chars == len(text)
        mails = [m.group() for m in re.finditer(PATTERNS["email"], clean[d])]
        assert not any(m in text for m in mails) and text.count("[EMAIL]") >= bool(mails) and (text == clean[d] or "[" in text)


def ascii_tokens(text):
    """Runs of ASCII letters and digits and of bytes over 0x7F, A-Z lower-cased."""
    return [t.decode("latin-1") for t in re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())]


def near_classes(sets, ids, similarity=0.8):
    up, seen = list(range(len(sets))), {}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in {j for x in a for j in seen.get(x, ())}:
            if find(i) != find(j) and len(a & sets[j]) >= similarity * len(a | sets[j]):
                up[find(i)] = find(j)
        for x in a:
            seen.setdefault(x, []).append(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), 1 << 64), d)
    return [least[find(i)] for i in range(len(sets))]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, tmp_path, empty):
    import corpus_pipeline

    docs = awkward(spark).limit(0) if empty else awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        (table(spark, name).limit(0) if empty else table(spark, name)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == ([] if empty else [1, 4, 6, 7, 8, 9]) and len(got) == (0 if empty else 7)


def test_queries_are_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] == [n for n in sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)", n)[1]))]
    assert len(queries.QUERIES) == 11 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
