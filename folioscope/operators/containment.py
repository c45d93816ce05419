"""Pairs of texts of which one may hold the other, found by content-defined anchors instead of comparing all with all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter over the keys that are sought; 8 MB. Where it fills up it spares less work and loses nothing.
BITS = 26
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sizes(least: int) -> tuple[int, int]:
    """Bytes of a gram and grams of a window of the first tier, powers of two; together they fit into ``least`` bytes."""
    gram = 1 << (max(1, 2 * least // 3).bit_length() - 1)
    return gram, 1 << ((least - gram + 1).bit_length() - 1)


def _longer(h: np.ndarray, have: int, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes from those of ``have`` bytes."""
    while have < size:
        h = _mixed(h[:-have] * _OTHER + h[have:])
        have *= 2
    return h


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    have = 1
    while have < wide:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return h


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


def _tiers(n: int, least: int) -> int:
    gram, wide = _sizes(least)
    return ((n + 1) // (gram + wide)).bit_length()


def sought(text: bytes, least: int) -> int:
    """The key that every text holding ``text`` has among its ``held``: the least gram of the first window of its last tier."""
    gram, wide = (x << (_tiers(len(text), least) - 1) for x in _sizes(least))
    return int(_longer(_bytes(text[: gram + wide - 1]), 1, gram).min())


def held(text: bytes, least: int) -> np.ndarray:
    """The least grams of all windows of the text, of each tier: grams and windows double from one to the next; some repeat."""
    (gram, wide), h, have, out = _sizes(least), _bytes(text), 1, []
    for _ in range(_tiers(len(text), least)):
        h = _longer(h, have, gram)
        low = _least(h, wide)
        out.append(low[np.concatenate(([True], low[1:] != low[:-1]))])
        have, gram, wide = gram, 2 * gram, 2 * wide
    return np.concatenate(out)


def _of(key: np.ndarray, doc, side) -> np.ndarray:
    """The key within a document, for what is sought on one side."""
    return _mixed(key ^ np.asarray(doc, np.int64).view(np.uint64) ^ np.asarray(side, np.uint64) * _OTHER)


def _needles(least: int):
    def run(batches):
        for batch in batches:
            keys = _of(np.array([sought(t, least) for t in batch.column(3).to_pylist()], np.uint64), batch.column(1).to_numpy(), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys.view(np.int64))], names=["side", "d", "h", "key"])

    return run


def _hay(least: int, filter_):
    def run(batches):
        bits = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            found = [held(t, least) for t in batch.column(3).to_pylist()]
            rows = np.repeat(np.arange(len(found)), np.array([len(x) for x in found], np.int64))
            keys = np.concatenate([*found, np.zeros(0, np.uint64)])
            keys = _of(keys, batch.column(1).to_numpy()[rows], 1 - batch.column(0).to_numpy()[rows].astype(np.int64))
            at = keys >> np.uint64(64 - BITS)
            on = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            rows = pa.array(rows[on])
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:3]), pa.array(keys[on].view(np.int64))], names=["side", "d", "h", "key"])

    return run


def pairs(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """left, right (doc, text) -> distinct (d, a, b): all pairs of a document's texts of which one may hold the other.

    d, a and b are xxhash64 of doc, left's and right's text. Texts have ``least`` characters or more. A text is sought by
    one key and found among the keys of all windows of the other side's, so no pair is lost; the caller compares the texts.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark, kind = left.sparkSession, "side int, d long, h long, key long"
    texts = [t.select(F.lit(side).alias("side"), F.xxhash64("doc").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")) for side, t in enumerate((left, right))]
    both = texts[0].unionByName(texts[1])
    needles = both.mapInArrow(_needles(least), kind)
    at = F.shiftrightunsigned("key", 64 - BITS) + 1  # bitmap functions count from 1
    parts = needles.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = bytearray(1 << (BITS - 3))
    for p in parts:
        bits[(p.n - 1) * 4096 : p.n * 4096] = p.bits
    hay = both.mapInArrow(_hay(least, spark.sparkContext.broadcast(bytes(bits))), kind)
    one, other = needles.select("d", "key", F.col("side").alias("s"), F.col("h").alias("x")), hay.select("d", "key", F.col("h").alias("y"), (1 - F.col("side")).alias("s"))
    met = one.distinct().join(other.distinct(), ["d", "key", "s"])
    return met.select("d", F.expr("if(s = 0, x, y)").alias("a"), F.expr("if(s = 0, y, x)").alias("b")).distinct()
