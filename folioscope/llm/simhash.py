"""SimHash near-duplicates, linked by BK-trees.

Fingerprint: words are runs of anything but ASCII white space, A-Z lower-cased; shingles are 3 words with repeats (fewer
words: the whole sequence); each shingle counts with its XXH64 (seed 42); a bit is 1 if set in over half of them. No
words, null included: fingerprint 0, linked like any other.

Links: two fingerprints within 3 bits agree, of four 16-bit blocks, in at least one; and in the remaining 48 bits, of
four 12-bit blocks, in at least one. Each distinct fingerprint therefore goes to 16 shards (table, block, sub-block),
and every pair within reach meets in one of them: nothing is lost and there is no cap. In a shard a BK-tree takes the
fingerprints one by one; a search follows only edges within the radius, and skips subtrees that already belong to the
searcher's component, which keeps dense groups near linear. A shard over ``shard_rows`` is dealt to salted sub-shards,
each pair of which meets in one task. Shard trees travel by shuffle, not by broadcast: their total grows with the
corpus. Rows: repeated rows give repeated result rows; a null doc_id keeps its fingerprint and takes no part in the
smallest doc_id (component_id is null only if no member has an id); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import near_copies
from folioscope.llm.common import components, parts, stored

SEED = 42
RADIUS = 3


def fingerprint(text: bytes | None, width: int = 3) -> int:
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view = memoryview(joined)
    counts, total = np.zeros(64, np.int64), n - width + 1
    for at in range(0, total, 8192):
        upto = min(at + 8192, total)
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Tree over distinct 64-bit integers; children are keyed by Hamming distance to their parent."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.keys, self.kids, self.up, self.whole = radius, [], [], [], []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, key: int) -> list[int]:
        """Insert key; return keys within the radius, one at least of each component that it touches."""
        keys, kids, whole, radius, find = self.keys, self.kids, self.whole, self.radius, self.find
        me = len(keys)
        keys.append(key)
        kids.append({})
        self.up.append(me)
        whole.append(True)
        if not me:
            return []
        hits, stack = [], [0]
        while stack:
            i = stack.pop()
            if whole[i] and hits and find(i) == find(me):
                continue
            d = (keys[i] ^ key).bit_count()
            if d <= radius and find(i) != find(me):
                hits.append(keys[i])
                self.up[find(i)] = find(me)
            stack.extend(child for at, child in kids[i].items() if -radius <= at - d <= radius)
        i, mine = 0, find(me)
        while True:
            if whole[i] and find(i) != mine:
                whole[i] = False
            d = (keys[i] ^ key).bit_count()
            if d not in kids[i]:
                kids[i][d] = me
                return hits
            i = kids[i][d]


def _links(batches):
    """Rows sorted by shard; a tree for each shard."""
    shard, tree, a, b = None, None, [], []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        for k, i, j, fp in zip(*cols):
            if (k, i, j) != shard:
                shard, tree = (k, i, j), BKTree()
            for hit in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
                a.append(fp)
                b.append(hit - (1 << 64) if hit >> 63 else hit)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []


def _shards():
    """The 16 shard keys of column fp."""
    block = lambda x, at, bits: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    fp, keys = F.col("fp"), []
    for t in range(4):
        rest = [block(fp, 16 * u, 16) for u in range(4) if u != t]
        rest = rest[0].bitwiseOR(F.shiftleft(rest[1], 16)).bitwiseOR(F.shiftleft(rest[2], 32))
        for s in range(4):
            keys.append(F.lit((4 * t + s) << 28).cast("long").bitwiseOR(F.shiftleft(block(fp, 16 * t, 16), 12)).bitwiseOR(block(rest, 12 * s, 12)))
    return F.array(*keys)


def links(distinct: DataFrame, shard_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) within the radius: a spanning set of each shard's links."""
    keyed = distinct.select("fp", F.explode(_shards()).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    salted = (
        keyed.join(sizes, "shard")
        .withColumn("s", F.ceil(F.col("n") / shard_rows).cast("int"))
        .withColumn("me", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        .select("shard", "fp", "me", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
        .select("shard", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "fp")
    )
    n = parts(distinct.sparkSession)
    return salted.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row of docs."""
    own = stored(fingerprints(docs))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(groups, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates by the rule for stages: shingles of ``width`` words, Jaccard similarity at least ``similarity``."""
    return near_copies.keep_one(docs, width, similarity)
