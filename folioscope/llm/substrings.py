"""Exact removal of repeated 50-byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller doc_id; strings are
judged on the input. Four rounds over documents dealt to groups by a hash of doc_id (about 8 MB of text each), all
reading one shuffle of the texts:

1. every window of ``width`` bytes gets a content-defined anchor; the anchors that occur in two documents are found
   from one hash per anchor and group;
2. for these, the run of windows around an anchor is named by (anchor, content). Equal runs need no comparison: their
   least doc_id answers for all. With it go four short hashes, each of the bytes that a range of the run's windows has in
   common; two runs with an equal window have one of them equal. Runs that share one with a different run go on;
3. their bytes, each different run once, meet in buckets by anchor. A bucket takes whole anchors at a time, cuts their
   runs into shards, makes each shard's Burrows-Wheeler transform and merges these by interleave refinement: starting
   from one shard after the other, every round moves each entry to where the symbols before it send it (eight symbols a
   round, two where they are too many kinds), and splits the intervals in which entries agree. After ``width`` symbols
   the intervals are the groups of equal ``width``-byte strings; no suffix is sorted again. The least doc_id in an
   interval answers for its windows;
4. the answers come back to the groups, which remove.

A group sends a repeated anchor or run once, whatever the number of its copies, so a hot passage costs a bucket one
entry a group. Nothing is capped. Defined results: null text is empty; a null doc_id ranks after all others; rows with
one doc_id never remove from each other; texts under ``width`` bytes stay whole, longer
ones are read whole, however long; repeated rows and ties in doc_id give a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._anchors import anchors, contents, keys, words
from folioscope.llm.common import parts

LAST = np.iinfo(np.int64).max
#: Bytes of text in a group of documents, on average.
GROUP_BYTES = 8 << 20
#: Bytes of a shard that is transformed at once.
SHARD_BYTES = 1 << 14
#: Bytes of the shards that are merged together; an anchor is never split.
MERGE_BYTES = 1 << 15
#: Bits of an anchor that round 1 leaves out.
_DROPPED = np.uint64(14)
_SEND = "bucket int, pi int, payload binary"
_BACK = "pi int, bucket int, kind int, payload binary"


# ---- transforms -----------------------------------------------------------------------------------------------------


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key)
    step = np.empty(len(key), bool)
    step[0] = False
    got = key[order]
    step[1:] = got[1:] != got[:-1]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step)
    return rank, int(step.sum()) + 1


def transform(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(positions, columns) of the rotations of the strings text[start:end] of one shard, sorted by width symbols or more.

    columns[k] holds the k symbols before each rotation, as one number, for k of 2, 4 and 8. Doubling from 8 symbols
    stops at width: a merge that goes no further counts rotations by prefixes, whatever the order of equal ones.
    """
    n = len(text)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[starts] = starts, ends - 1
    key, hop, back, columns = text.astype(np.uint64), after, before, {}
    for k in (2, 4, 8):
        key = (key << np.uint64(4 * k)) | key[hop]
        hop, back = hop[hop], back[back]
        columns[k] = key[back]
    rank, kinds = _ranks(key)
    depth = 8
    while kinds < n and depth < width:
        rank, kinds = _ranks(rank * np.uint64(kinds) + rank[hop])
        hop = hop[hop]
        depth *= 2
    position = np.argsort(rank, kind="stable")
    return position, {k: x[position] for k, x in columns.items()}


def merge(columns: list[dict[int, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave shard transforms: (shard, interval) of each merged entry; entries of an interval agree in width symbols.

    A round takes as many symbols as sort as numbers of 16 bits: 8 or 4 by their rank where there are few different ones, else 2.
    """
    lens = [len(c[2]) for c in columns]
    steps, left = [], width
    for k in (8, 4):
        if left >= k:
            values, symbols = np.unique(np.concatenate([c[k] for c in columns]), return_inverse=True)
            if len(values) <= 1 << 16:
                steps += [symbols.astype(np.uint16)] * (left // k)
                left %= k
    steps += [np.concatenate([c[2] for c in columns]).astype(np.uint16)] * (left // 2)
    shard = np.repeat(np.arange(len(columns), dtype=np.uint16 if len(columns) > 255 else np.uint8), lens)
    interval = np.zeros(len(shard), np.int32)
    change = np.empty(len(shard), bool)
    for column in steps:
        symbol = np.empty_like(column)
        symbol[np.argsort(shard, kind="stable")] = column
        source = np.argsort(symbol, kind="stable")
        shard, interval, symbol = shard[source], interval[source], symbol[source]
        change[0] = False
        np.not_equal(symbol[1:], symbol[:-1], out=change[1:])
        change[1:] |= interval[1:] != interval[:-1]
        interval = np.cumsum(change, dtype=np.int32)
    return shard, interval


def least_by_window(text: np.ndarray, lens: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window of each string (in order), the least doc among the strings that hold the same bytes.

    text: the strings one after the other; doc: one number a string. width must be even.
    """
    bounds = np.concatenate(([0], np.cumsum(lens + 1)))
    held = np.full(bounds[-1], 255, np.uint8)  # no UTF-8 text holds this byte
    own = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
    inside = np.arange(len(held), dtype=np.int32) - bounds[own].astype(np.int32)
    held[inside < lens[own]] = text
    place, columns, at = [], [], 0
    while at < len(lens):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SHARD_BYTES, "right")) - 1)
        low = bounds[at]
        position, column = transform(held[low : bounds[upto]], bounds[at:upto] - low, bounds[at + 1 : upto + 1] - low, width)
        place.append(position + low)
        columns.append(column)
        at = upto
    shard, interval = merge(columns, width)
    position = np.empty(len(held), np.int64)
    position[np.argsort(shard, kind="stable")] = np.concatenate(place)
    whole = inside <= lens[own] - width
    value = np.where(whole, doc[own], LAST)[position]
    first = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    found = np.empty(len(held), np.int64)
    found[position] = np.minimum.reduceat(value, first)[interval]
    return found[whole]


def by_anchor(text: np.ndarray, lens: np.ndarray, doc: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """least_by_window of strings in the order of their anchors, whole anchors of up to MERGE_BYTES at once: only those of one anchor hold equal windows."""
    bounds, begin = np.concatenate(([0], np.cumsum(lens + 1))), np.concatenate(([0], np.cumsum(lens)))
    cuts = np.append(np.flatnonzero(_firsts(anchor)), len(lens))
    out, at = [], 0
    while cuts[at] < len(lens):
        upto = max(at + 1, int(np.searchsorted(bounds[cuts], bounds[cuts[at]] + MERGE_BYTES, "right")) - 1)
        a, b = cuts[at], cuts[upto]
        out.append(least_by_window(text[begin[a] : begin[b]], lens[a:b], doc[a:b], width))
        at = upto
    return np.concatenate(out)


# ---- rounds ---------------------------------------------------------------------------------------------------------


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of anchors, so entries in the anchors' order are in the buckets' order too."""
    return ((anchor >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
        for x in columns[1:]:
            new[1:] |= x[1:] != x[:-1]
    return new


class _Group:
    """Anchors of a group's documents in their order, which all rounds share."""

    def __init__(self, left: pa.Table, n: int, width: int, gram: int):
        self.n, self.width, self.gram = n, width, gram
        self.null = left.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.ids = left.column("doc_id").fill_null(int(LAST)).to_numpy()
        self.texts = [x or b"" for x in left.column("text").to_pylist()]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes + 1)))  # a byte between texts ends a span
        text, first, size, place, anchor = anchors(self.texts, width, gram)
        order = np.argsort(anchor)
        self.anchor, self.text, self.size = anchor[order], text[order], size[order]
        self.start, self.place = self.base[self.text] + first[order], self.base[self.text] + place[order]
        self.doc = self.ids[self.text] if len(order) else np.zeros(0, np.int64)

    def shared(self, replies: pa.Table) -> np.ndarray:
        """Entries whose anchor another document holds."""
        short = self.anchor >> _DROPPED
        first = np.flatnonzero(_firsts(short))
        mask = np.zeros(len(first), bool)
        if len(first):
            bucket = _bucket(short[first] << _DROPPED, self.n)
            mask |= np.minimum.reduceat(self.doc, first) != np.maximum.reduceat(self.doc, first)
            for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
                low, high = np.searchsorted(bucket, [b, b + 1])
                mask[low:high] |= np.unpackbits(np.frombuffer(payload, np.uint8), count=high - low).astype(bool)
        return np.flatnonzero(np.repeat(mask, np.diff(np.append(first, len(short)))))

    def runs(self, entry: np.ndarray):
        """Of the entries chosen: (entries by run, first of each run there, run of each entry, content of each run); runs by anchor, content."""
        content = contents(words(b"\xff".join(self.texts)), self.start[entry], self.size[entry], self.width, self.gram)
        order = np.lexsort((content, self.anchor[entry]))
        entry, content = entry[order], content[order]
        new = _firsts(self.anchor[entry], content)
        return entry, np.flatnonzero(new), np.cumsum(new) - 1, content[new]


def _sent(pi: int, bucket: np.ndarray, payloads) -> pa.Table:
    """A row for each bucket; payloads(low, high) of its part. bucket is sorted."""
    names, low = np.unique(bucket, return_index=True)
    high = np.append(low[1:], len(bucket))
    data = [payloads(a, b) for a, b in zip(low.tolist(), high.tolist())]
    return pa.table({"bucket": pa.array(names, pa.int32()), "pi": pa.array(np.full(len(names), pi), pa.int32()), "payload": pa.array(data, pa.binary())})


def _replied(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table({"pi": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def _five(value: np.ndarray) -> bytes:
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(payload: bytes) -> np.ndarray:
    out = np.zeros((len(payload) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(payload, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _planes(value: np.ndarray) -> bytes:
    """Numbers of 8 bytes, all first bytes first, which compresses better."""
    return np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(payload: bytes, count: int, offset: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(payload, np.uint8, 8 * count, offset).reshape(8, -1).T).view("<i8").ravel()


def _quads(payload: bytes) -> np.ndarray:
    k = len(payload) // 32
    return np.concatenate((np.frombuffer(payload, "<u8", 3 * k).reshape(3, k), _from_planes(payload, k, 24 * k).view(np.uint64)[None]))


def _round_1(n, width, gram):
    def run(table: pa.Table) -> pa.Table:
        short = np.sort(anchors([x or b"" for x in table.column("text").to_pylist()], width, gram)[-1] >> _DROPPED)
        short = short[_firsts(short)]
        return _sent(table.column("pi")[0].as_py(), _bucket(short << _DROPPED, n), lambda a, b: _five(short[a:b]))

    return run


def _answer_1(table: pa.Table) -> pa.Table:
    """Which anchors occur in more than one group."""
    bucket, payloads = table.column("bucket")[0].as_py(), [_from_five(x) for x in table.column("payload").to_pylist()]
    every = np.sort(np.concatenate(payloads))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for pi, own in zip(table.column("pi").to_pylist(), payloads):
        at = np.searchsorted(twice, own)
        hit = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == own) if len(twice) else np.zeros(len(own), bool)
        if hit.any():
            rows.append((pi, bucket, 1, np.packbits(hit).tobytes()))
    return _replied(rows)


def _round_2(n, width, gram):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, np.zeros(0, np.int64), None)
        group = _Group(left, n, width, gram)
        entry, first, _, c = group.runs(group.shared(right))
        least = np.minimum.reduceat(group.doc[entry], first) if len(first) else np.zeros(0, np.int64)
        e = entry[first]
        a = group.anchor[e]
        key = keys(words(b"\xff".join(group.texts)), group.start[e], group.size[e], group.place[e], width, gram)
        pack = lambda x, y: a[x:y].tobytes() + c[x:y].tobytes() + key[x:y].tobytes() + _planes(least[x:y])
        return _sent(left.column("pi")[0].as_py(), _bucket(a, n), pack)

    return run


def _several(by: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether entries with an entry's ``by``, which stand together, have more than one content."""
    first = np.flatnonzero(_firsts(by))
    if not len(first):
        return np.zeros(0, bool)
    return np.repeat(np.minimum.reduceat(content, first) != np.maximum.reduceat(content, first), np.diff(np.append(first, len(by))))


def _answer_2(table: pa.Table) -> pa.Table:
    """For each run sent: the least document that holds it, and whether a different run may hold one of its windows."""
    bucket, sent = table.column("bucket")[0].as_py(), [_quads(x) for x in table.column("payload").to_pylist()]
    a, c, key, doc = np.concatenate(sent, axis=1)
    doc = doc.view(np.int64)
    order = np.lexsort((c, a))
    first = np.flatnonzero(_firsts(a[order], c[order]))
    one = order[first]
    some, many = one[_several(a[one], c[one])], np.zeros(len(first), bool)
    at = np.flatnonzero(_several(a[one], c[one]))
    for k in range(0, 64, 16):
        own = (key[some] >> np.uint64(k)) & np.uint64(0xFFFF)
        has = np.flatnonzero(own)
        by = (a[some[has]] & ~np.uint64(0xFFFF)) | own[has]
        turn = np.argsort(by)
        many[at[has[turn[_several(by[turn], c[some[has[turn]]])]]]] = True
    times = np.diff(np.append(first, len(a)))
    answer, merged = np.empty(len(a), np.int64), np.empty(len(a), bool)
    answer[order] = np.repeat(np.minimum.reduceat(doc[order], first), times)
    merged[order] = np.repeat(many, times)
    rows, low = [], 0
    for pi, own in zip(table.column("pi").to_pylist(), sent):
        upto = low + own.shape[1]
        rows.append((pi, bucket, 2, _planes(answer[low:upto]) + np.packbits(merged[low:upto]).tobytes()))
        low = upto
    return _replied(rows)


def _answers(group: _Group, right: pa.Table):
    """(entries by run, first, run of entry, content, least document by run, whether a run is to be compared)."""
    kind = right.column("kind").to_numpy()
    entry, first, run, content = group.runs(group.shared(right.filter(pa.array(kind == 1))))
    bucket = _bucket(group.anchor[entry[first]], group.n)
    least, many = np.full(len(first), LAST), np.zeros(len(first), bool)
    mine = right.filter(pa.array(kind == 2))
    for b, payload in zip(mine.column("bucket").to_pylist(), mine.column("payload").to_pylist()):
        low, high = np.searchsorted(bucket, [b, b + 1])
        least[low:high] = _from_planes(payload, high - low)
        many[low:high] = np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 * (high - low)), count=high - low)
    return entry, first, run, content, least, many


def _round_3(n, width, gram):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, np.zeros(0, np.int64), None)
        group = _Group(left, n, width, gram)
        entry, first, _, content, _, many = _answers(group, right)
        least = np.minimum.reduceat(group.doc[entry], first)[many] if len(first) else np.zeros(0, np.int64)
        e, content, data = entry[first][many], content[many], b"\xff".join(group.texts)
        spans = [data[f : f + s] for f, s in zip(group.start[e].tolist(), group.size[e].tolist())]

        def pack(x, y):
            head = np.stack((group.anchor[e[x:y]], content[x:y], least[x:y].view(np.uint64), group.size[e[x:y]].view(np.uint64)))
            return np.uint64(y - x).tobytes() + head.tobytes() + b"".join(spans[x:y])

        return _sent(left.column("pi")[0].as_py(), _bucket(group.anchor[e], n), pack)

    return run


def _answer_3(width):
    def run(table: pa.Table) -> pa.Table:
        """The least document for each window of the runs sent."""
        bucket, heads, bodies = table.column("bucket")[0].as_py(), [], []
        for payload in table.column("payload").to_pylist():
            k = int(np.frombuffer(payload, "<u8", 1)[0])
            heads.append(np.frombuffer(payload, "<u8", 4 * k, 8).reshape(4, k))
            bodies.append(np.frombuffer(payload, np.uint8, offset=8 + 32 * k))
        a, c, doc, size = np.concatenate(heads, axis=1)
        doc, size = doc.view(np.int64), size.astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        body = np.concatenate(bodies)
        order = np.lexsort((c, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])))
        first = np.flatnonzero(new)
        one = order[first]  # one sender of each run
        lens = size[one]
        start = np.concatenate(([0], np.cumsum(lens)))
        text = body[np.repeat(begin[one] - start[:-1], lens) + np.arange(start[-1])]
        least = by_anchor(text, lens, np.minimum.reduceat(doc[order], first), a[one], width)
        windows = lens - width + 1
        at = np.concatenate(([0], np.cumsum(windows)))
        which = np.empty(len(a), np.int64)
        which[order] = np.cumsum(new) - 1
        rows, low = [], 0
        for pi, head in zip(table.column("pi").to_pylist(), heads):
            w = which[low : low + head.shape[1]]
            n = windows[w]
            pick = np.repeat(at[w] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            rows.append((pi, bucket, 3, _planes(least[pick])))
            low += head.shape[1]
        return _replied(rows)

    return run


def _round_4(n, width, gram):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Group(left, n, width, gram)
        entry, first, of, _, least, many = _answers(group, right)
        sizes, base, start = group.sizes, group.base, group.start
        gone = np.zeros(base[-1] + 1, np.int32)
        whole = entry[~many[of] & (least[of] < group.doc[entry])]
        np.add.at(gone, start[whole], 1)
        np.add.at(gone, start[whole] + group.size[whole], -1)
        # runs that were compared: their windows' answers stand in the order in which the runs were sent
        bucket = _bucket(group.anchor[entry[first]][many], n)
        windows = group.size[entry[first]][many] - width + 1
        at = np.concatenate(([0], np.cumsum(windows)))
        answer = np.full(at[-1], LAST)
        mine = right.filter(pa.array(right.column("kind").to_numpy() == 3))
        for b, payload in zip(mine.column("bucket").to_pylist(), mine.column("payload").to_pylist()):
            low, high = np.searchsorted(bucket, [b, b + 1])
            answer[at[low] : at[high]] = _from_planes(payload, len(payload) // 8)
        place = np.cumsum(many) - 1
        some = np.flatnonzero(many[of])
        r = place[of[some]]
        n_windows = windows[r]
        offset = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        value = answer[np.repeat(at[r], n_windows) + offset]
        e = np.repeat(entry[some], n_windows)
        hit = value < group.doc[e]
        np.add.at(gone, start[e[hit]] + offset[hit], 1)
        np.add.at(gone, start[e[hit]] + offset[hit] + width, -1)
        mask = np.cumsum(gone, out=gone) > 0
        del gone
        edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), mask[:-1].view(np.int8), np.zeros(1, np.int8)))))
        low, high = edge[::2], edge[1::2]
        of = np.searchsorted(base, low, "right") - 1
        counts = np.bincount(of, minlength=len(sizes))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(low - base[of]), pa.array(high - base[of])], names=["start", "end"])
        kept = [np.frombuffer(text, np.uint8)[~mask[b : b + len(text)]].tobytes() if k else text for text, b, k in zip(group.texts, base[:-1].tolist(), counts.tolist())]
        return pa.table({"doc_id": pa.array(group.ids, pa.int64(), mask=group.null), "n_bytes": pa.array(sizes), "removed": pa.ListArray.from_arrays(offsets, spans), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 24) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs of bytes, end exclusive) and kept (the bytes left, one after the other) of each row."""
    if width % 2 or not 8 <= gram <= width:
        raise ValueError("width must be even and no less than gram, gram no less than 8")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), math.ceil(total / GROUP_BYTES))
    dealt = rows.withColumn("pi", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(n)).cast("int")).repartition(n, "pi")
    groups = lambda: dealt.groupBy("pi")
    met = lambda sent: sent.repartition(n, "bucket").groupBy("bucket")
    back = lambda replies: replies.repartition(n, "pi")

    shared = back(met(groups().applyInArrow(_round_1(n, width, gram), _SEND)).applyInArrow(_answer_1, _BACK))
    runs = back(met(groups().cogroup(shared.groupBy("pi")).applyInArrow(_round_2(n, width, gram), _SEND)).applyInArrow(_answer_2, _BACK))
    known = back(shared.unionByName(runs))
    windows = met(groups().cogroup(known.groupBy("pi")).applyInArrow(_round_3(n, width, gram), _SEND)).applyInArrow(_answer_3(width), _BACK)
    return groups().cogroup(back(known.unionByName(windows)).groupBy("pi")).applyInArrow(
        _round_4(n, width, gram), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
