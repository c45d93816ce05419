"""The runs of windows that op7 compares: what is sent to the merge, and that batches of anchors lose nothing."""

import random

import numpy as np
import pyarrow as pa

from folioscope.llm import _anchors, substrings


def compared(texts):
    """Whether each run that round 2 sends is to be merged, all documents in groups of their own and one bucket."""
    tables = [pa.table({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t], pa.binary()), "pi": pa.array([i], pa.int32())}) for i, t in enumerate(texts)]
    replies = substrings._answer_1(pa.concat_tables([substrings._round_1(1, 50, 24)(t) for t in tables]))
    mine = lambda i: replies.filter(pa.array(replies.column("pi").to_numpy() == i))
    sent = pa.concat_tables([substrings._round_2(1, 50, 24)(t, mine(i)) for i, t in enumerate(tables)])
    out = []
    for payload in substrings._answer_2(sent).column("payload").to_pylist():
        k = next(k for k in range(len(payload)) if 8 * k + (k + 7) // 8 == len(payload))
        out += np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 * k), count=k).tolist()
    return out


def around(rnd, phrase):
    return [bytes(rnd.choices(b"abcdefgh", k=90)) + phrase + bytes(rnd.choices(b"abcdefgh", k=90)) for _ in range(40)]


def test_runs_without_a_common_window_are_not_merged():
    rnd = random.Random(8)
    short = compared(around(rnd, b"thirty-six bytes of a common phrase."))  # a common gram, but no common window
    assert len(short) > 40 and not any(short)
    assert any(compared(around(rnd, b"a phrase that is longer than fifty bytes, by a dozen or so...")))


def test_equal_windows_have_an_equal_key():
    rnd = random.Random(9)
    base = [bytes(rnd.choices(b"ab c", k=200)) for _ in range(6)]
    texts = []
    for _ in range(80):
        a = rnd.randint(0, 120)
        texts.append(rnd.choice(base)[a : a + rnd.randint(50, 80)] + b"x" * rnd.randint(0, 60) + rnd.choice(base)[rnd.randint(0, 120) :])
    for width, gram in ((50, 24), (30, 8), (24, 24)):
        text, first, size, place, anchor = _anchors.anchors(texts, width, gram)
        seen, windows = {}, 0
        for t, f, s, p, a in zip(text.tolist(), first.tolist(), size.tolist(), place.tolist(), anchor.tolist()):
            word, at = _anchors.words(texts[t]), lambda x: np.array([x])
            assert f <= p and p + gram <= f + s <= f + 2 * width - gram
            key = int(_anchors.keys(word, at(f), at(s), at(p), width, gram)[0])
            content = int(_anchors.contents(word, at(f), at(s), width, gram)[0])
            for j in range(f, f + s - width + 1):
                windows += 1
                seen.setdefault(texts[t][j : j + width], []).append((a, key, content, texts[t][f : f + s]))
        assert windows == sum(max(0, len(x) - width + 1) for x in texts)
        for held in seen.values():
            anchor0, key0, _, _ = held[0]
            for a, key, content, run in held:
                assert a == anchor0
                assert any((key >> k) & 0xFFFF and (key >> k) & 0xFFFF == (key0 >> k) & 0xFFFF for k in range(0, 64, 16))
                assert all((content == c) == (run == r) for _, _, c, r in held[:5])


def test_batches_of_anchors_equal_one_merge(monkeypatch):
    rnd = random.Random(10)
    texts, anchor = [], []
    for a in range(30):
        base = bytes(rnd.choices(b"ab", k=24)) + bytes(rnd.choices(bytes(range(97, 123)), k=60))
        own = sorted({base[rnd.randint(0, 9) : rnd.randint(64, 84)] for _ in range(rnd.choice([1, 3, 40]))})
        texts += own
        anchor += [a] * len(own)
    body, lens, doc = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.arange(len(texts))
    doc = doc[::-1].copy()
    first: dict = {}
    windows = [((a, t[j : j + 50]), d) for a, t, d in zip(anchor, texts, doc.tolist()) for j in range(len(t) - 49)]
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    for merged, shard in ((1 << 15, 1 << 14), (700, 300), (1, 1)):
        monkeypatch.setattr(substrings, "MERGE_BYTES", merged)
        monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
        assert substrings.by_anchor(body, lens, doc, np.array(anchor), 50).tolist() == [first[w] for w, _ in windows]


def test_many_different_symbols_fall_back():
    """Over 65,536 different runs of eight bytes, so that the merge takes fewer symbols a round."""
    body = np.random.default_rng(3).integers(97, 123, 70 * 1500, np.uint8)
    body[70 * 1400 :] = body[: 70 * 100]
    lens, doc = np.full(1500, 70), np.arange(1500)
    got = substrings.least_by_window(body, lens, doc, 50).reshape(1500, 21)
    assert (got == np.where(doc < 1400, doc, doc - 1400)[:, None]).all()
