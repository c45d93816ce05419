"""Near copies by word shingles: documents whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.

Words as in ``simhash``; fewer words than ``width`` make one shingle, no words (null included) the empty set, which is a
copy of itself alone. Shingles are compared as 64-bit hashes. Equal sets are one node. A node's SimHash fingerprint has
64 bits, each 1 if set in over half of its shingles' hashes. Fingerprints meet in BK-trees, and a tree is searched within the
radius that a pair right at the similarity exceeds with a probability of at most ``MISS`` (29 bits at 0.8, so op10's
pigeonhole shards, made for 3 bits, can't deal the trees). A tree holds the nodes of one min-hash band; the number of
bands follows from the similarity, such that a pair right at it shares none with a probability of at most ``MISS``, and
more similar pairs still less. What a tree finds is then compared exactly, by the whole sets. Texts travel only for nodes that have a candidate, once for each pair of sub-shards: what bands connect forms
a shard, and a shard with over ``shard_shingles`` shingles is dealt to salted sub-shards, each pair of which meets in one
task. In a task a node is not compared with those already in its component, which keeps dense groups near linear.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import components, parts, stored

SEED = 42
MISS = 1e-6
#: Min-hashes of a band.
ROWS = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 512


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    h = each[:n].copy()
    for k in range(1, width):
        h = h * _P + each[k : n + k]
    return np.unique(_mixed(h))


def band_count(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


@lru_cache(maxsize=4)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.RandomState(SEED)
    a, b = (rnd.randint(0, 1 << 32, n, np.uint64) << np.uint64(32) | rnd.randint(0, 1 << 32, n, np.uint64) for _ in range(2))
    return a[:, None], (b | np.uint64(1))[:, None]


def bands(found: np.ndarray, similarity: float) -> np.ndarray:
    """A key for each band of min-hashes; the empty set has none."""
    n = band_count(similarity)
    if not len(found):
        return np.zeros(0, np.int64)
    flip, mul = _seeds(n * ROWS)
    least = np.full(n * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[None, at : at + _CHUNK] ^ flip) * mul).min(axis=1))
    key = np.arange(n, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed((key ^ least[k::ROWS]) * _P + np.uint64(1))
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < similarity * len(large) - 1e-9:
        return False
    both = np.concatenate((small, large))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def fingerprint(found: np.ndarray) -> int:
    """SimHash of shingle hashes."""
    counts = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=4)
def reach(similarity: float, sizes: int = 24) -> int:
    """The radius that a pair of fingerprints at the similarity exceeds with a probability of at most ``MISS``.

    A bit differs most often for small sets, which are enumerated; large ones tend to the angle between them over pi.
    """
    worst = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    coin = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in range(sizes + 1)]
    for a in range(1, sizes + 1):
        for b in range(a, sizes + 1):
            both = max(0, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))
            if both <= a:
                odds = 0.0
                for k, p in enumerate(coin[both]):
                    one = sum(q for j, q in enumerate(coin[a - both]) if 2 * (k + j) > a)
                    other = sum(q for j, q in enumerate(coin[b - both]) if 2 * (k + j) > b)
                    odds += p * (one * (1 - other) + other * (1 - one))
                worst = max(worst, odds)
    tail, radius = 0.0, 64
    while radius and (tail := tail + math.comb(64, radius) * worst**radius * (1 - worst) ** (64 - radius)) <= MISS:
        radius -= 1
    return radius


class Shard:
    """Nodes taken one by one; what an added node is alike to, one of each component at least.

    Each band has a BK-tree of its nodes' fingerprints; children are keyed by Hamming distance to their parent. A search
    follows only edges within the radius and skips subtrees that belong to the searcher's component.
    """

    def __init__(self, similarity: float):
        self.similarity, self.radius = similarity, reach(similarity)
        self.names, self.sets, self.prints, self.up, self.trees = [], [], [], [], {}

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, name: int, found: np.ndarray, keys: list[int]) -> list[int]:
        me, hits, tried, find, radius, prints = len(self.names), [], set(), self.find, self.radius, self.prints
        mine = fingerprint(found) if len(found) else 0
        self.names.append(name)
        self.sets.append(found)
        prints.append(mine)
        self.up.append(me)
        for key in keys:
            tree = self.trees.get(key)
            # a tree's entries: node -> [whether its subtree is of its component, children by distance]
            stack = [next(iter(tree))] if tree else []
            while stack:
                i = stack.pop()
                whole, kids = tree[i]
                same = find(i) == find(me)
                if whole and same:
                    continue
                d = (prints[i] ^ mine).bit_count()
                if d <= radius and not same and i not in tried:
                    tried.add(i)
                    if alike(self.sets[i], found, self.similarity):
                        hits.append(self.names[i])
                        self.up[find(me)] = find(i)
                stack.extend(child for at, child in kids.items() if -radius <= at - d <= radius)
        for key in keys:
            tree = self.trees.setdefault(key, {})
            i = next(iter(tree), None)
            while i is not None:
                entry = tree[i]
                if entry[0] and find(i) != find(me):
                    entry[0] = False
                d = (prints[i] ^ mine).bit_count()
                if d not in entry[1]:
                    entry[1][d] = me
                    break
                i = entry[1][d]
            tree[me] = [True, {}]
        return hits


def _signatures(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(_id, _t, node, n, bands) of each row; _t stands for the text."""

    def run(batches):
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
                sizes.append(len(found))
                keys.append(bands(found, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_t", "node", "n", "bands"])

    return docs.select(*_key(), F.col("text").cast("binary").alias("text")).mapInArrow(run, "_id long, _t long, node long, n long, bands array<long>")


def _key():
    return F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t")


def _edges(docs: DataFrame, own: DataFrame, width: int, similarity: float, shard_shingles: int) -> DataFrame:
    """(a, b) between nodes that are alike: a spanning set of each shard's."""
    nodes = own.groupBy("node").agg(F.min("_t").alias("_t"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("m"), F.count("*").alias("size")).where("size > 1").select("band", "m")
    roots = components(banded.join(least, "band").select(F.col("node").alias("a"), F.col("m").alias("b")))
    members = stored(nodes.join(roots, "node"))
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / shard_shingles).cast("int").alias("s")).where("s > 0")
    salted = (
        members.join(sizes, "root")
        .withColumn("me", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        .select("_t", "node", "bands", "root", "me", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
        .select("_t", "root", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "node", "bands")
    )
    texts = docs.select(F.xxhash64("text").alias("_t"), F.col("text").cast("binary").alias("text")).join(members.select("_t"), "_t", "left_semi").dropDuplicates(["_t"])

    def run(batches):
        at = shard = None
        for batch in batches:
            a, b = [], []
            for root, i, j, node, keys, text in zip(*(batch.column(k) for k in range(6))):
                if (key := (root.as_py(), i.as_py(), j.as_py())) != at:
                    at, shard = key, Shard(similarity)
                for hit in shard.add(node.as_py(), shingles(text.as_py(), width), keys.as_py()):
                    a.append(node.as_py())
                    b.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = salted.join(texts, "_t").select("root", "i", "j", "node", "bands", "text").repartition(parts(docs.sparkSession), "root", "i", "j")
    return dealt.sortWithinPartitions("root", "i", "j", "node").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_shingles: int = 20_000_000) -> DataFrame:
    """docs without near copies: of what chains of near copies connect, the row of the smallest doc_id stays.

    Rows without a doc_id come last; of rows with one doc_id, one of the least text hash stays.
    """
    own = stored(_signatures(docs, width, similarity))
    roots = components(_edges(docs, own, width, similarity, shard_shingles)).withColumnRenamed("root", "linked")
    first = own.select("_id", "_t", "node").join(roots, "node", "left").groupBy(F.coalesce("linked", "node").alias("root")).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_t")).alias("x"))
    first = first.select(F.col("x._id").alias("_kept"), F.col("x._t").alias("_text"))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_key())
    mine = keyed["_id"].eqNullSafe(first["_kept"]) & keyed["_t"].eqNullSafe(first["_text"])
    return keyed.join(first, mine, "left_semi").dropDuplicates(["_id", "_t"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
