"""Benchmark decontamination by spaced seeds.

Tokens are runs of ASCII letters and digits and of bytes over 0x7F, A-Z lower-cased. A document is contaminated if, on
some alignment with a benchmark item, a window of ``span`` item tokens (the whole item if shorter) agrees in at least
``share`` of them. A fixed mask keeps some positions of a window and ignores the rest, so a substituted word at an
ignored position leaves the seed's hash as it was. The masks of a window size are chosen such that, wherever the
substitutions that ``share`` allows fall, one mask lies between them at some place: no overlap is missed
(``masks`` builds them, a test enumerates all patterns). Items of every length are searched; those of under 5 tokens
must agree whole.

Seeds of documents and of items meet in an equi-join on the hash; each carries the tokens around it, so a pair is
compared where it meets. Before that, documents' seeds are held against a bitmap of the items' (``BITS`` bits, a fixed
size, however large the benchmark), which only spares the join most seeds that have no partner. Texts are known by two
64-bit hashes, so copies of a text are compared once. Defined results: null or empty text is clean; texts are read
whole, however long; a null or repeated item counts by its own item_id (null ids are reported as -1), an item without
tokens never; of several overlaps with equal agreement any is the best; repeated documents give repeated rows; an empty
benchmark finds nothing; extra columns may have any name.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

#: Positions that a mask keeps, at most.
WEIGHT = 6
#: Masks of a window size, at most, where fewer positions can make it so.
FEW = 4
#: Bits of the bitmap, two of which stand for a seed.
BITS = 26
_P = 0x9E3779B97F4A7C15
_FORM = np.zeros(256, np.uint64)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FORM[_c] = _c
_FORM[65:91] = np.arange(97, 123)
_BLOCK = 1 << 17


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, m, np.uint64)))) for m in (_P, inverse))


def tokens(text: bytes | None) -> np.ndarray:
    """64-bit hash of each token, in order."""
    text = text or b""
    if len(text) <= _BLOCK:
        return _tokens(text)
    found, at = [], 0
    while at < len(text):
        end = min(at + _BLOCK, len(text))
        while end < len(text) and _FORM[text[end]]:  # whole tokens, however long
            end += 1
        found.append(_tokens(text[at:end]))
        at = end
    return np.concatenate(found)


def _tokens(text: bytes) -> np.ndarray:
    size = max(_BLOCK, 1 << len(text).bit_length())
    power, inverse = _powers(size)
    w = _FORM[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], w != 0, [False]))))
    start, end = edge[::2], edge[1::2]
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * power[: len(w)])))
    h = (run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _seeds(toks: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(toks) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, sum(1 << p for p in mask), np.uint64)
    for at in mask:
        h = (h ^ toks[at : at + n]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def allowed(size: int, share: float) -> int:
    """Substitutions that a window may hold."""
    return size - math.ceil(share * size - 1e-9)


@lru_cache(maxsize=None)
def masks(size: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks such that any ``wrong`` positions of ``size`` leave one of them whole at some place.

    The heaviest (up to WEIGHT) of which FEW do, chosen one by one for what they add; of large windows the run that must be left.
    """
    run = -(-(size - wrong) // (wrong + 1))
    if not wrong or size > 16:
        return (tuple(range(min(run, WEIGHT) if wrong else min(size, WEIGHT))),)
    patterns = [sum(1 << p for p in c) for c in combinations(range(size), wrong)]
    for weight in range(min(WEIGHT, size - wrong), run, -1):
        left, found = set(patterns), []
        each = {}
        for rest in combinations(range(1, size), weight - 1):
            m = sum(1 << p for p in (0, *rest))
            places = [m << t for t in range(size - rest[-1] if rest else size)]
            each[(0, *rest)] = {x for x in patterns if any(not x & y for y in places)}
        while left and len(found) < FEW:
            best = max(sorted(each), key=lambda k: len(each[k] & left))
            found.append(best)
            left -= each[best]
        if not left:
            return tuple(found)
    return (tuple(range(run)),)


def _marks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - BITS), (h >> np.uint64(8)) & np.uint64((1 << BITS) - 1)


def _around(toks: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The tokens from span - 1 before each place to span - 1 after it; 0 where there is none."""
    padded = np.zeros(len(toks) + 2 * span - 2, np.uint64)
    padded[span - 1 : span - 1 + len(toks)] = toks
    return padded[at[:, None] + np.arange(2 * span - 1)]


def _bytes(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * 8
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)] if len(rows) else [], pa.binary(size)).cast(pa.binary())


def _signed(h) -> pa.Array:
    return pa.array(np.asarray(h, np.uint64).view(np.int64), pa.int64())


_ITEM = "h long, item long, size int, around binary"
_DOC = "h long, k1 long, k2 long, around binary"


def item_seeds(benchmark: DataFrame, span: int, share: float) -> DataFrame:
    """(h, item, size of its windows, around) of each seed of each item."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toks = tokens(text)
                size = min(span, len(toks))
                for mask in masks(size, allowed(size, share)) if size else ():
                    h = _seeds(toks, mask)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(np.full(n, item), pa.int64()), pa.array(np.full(n, size), pa.int32()), _bytes(_around(toks, np.arange(n), span))], names=["h", "item", "size", "around"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _ITEM)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of seeds' hashes: 2 ** BITS bits, gathered in buckets of 4 KB."""
    low = F.shiftrightunsigned("h", 8).bitwiseAND(F.lit((1 << BITS) - 1))
    marks = seeds.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS), low)).alias("x")).select((F.col("x") + 1).alias("x"))
    rows = marks.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _document_seeds(docs: DataFrame, seeds: DataFrame, span: int, share: float) -> DataFrame:
    """(h, k1, k2, around) of the seeds of each different text whose bits are set in the items' bitmap."""
    used = sorted({m for r in seeds.select("size").distinct().collect() for m in masks(r["size"], allowed(r["size"], share))})  # span sizes at most
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def run(batches):
        for batch in batches:
            for k1, k2, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                toks = tokens(text.as_py())
                for mask in used:
                    own = _seeds(toks, mask)
                    bits, (x, y) = sent.value, _marks(own)
                    at = np.flatnonzero((bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1)
                    at = at[((bits[y[at] >> np.uint64(3)] >> (y[at] & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    for low in range(0, len(at), 16384):
                        part = at[low : low + 16384]
                        rows = np.unique(np.concatenate((own[part, None], _around(toks, part, span)), axis=1), axis=0)
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([_signed(rows[:, 0].copy()), pa.array(np.full(n, k1.as_py()), pa.int64()), pa.array(np.full(n, k2.as_py()), pa.int64()), _bytes(rows[:, 1:])], names=["h", "k1", "k2", "around"])

    return docs.select(*_keys(docs), docs["text"].cast("binary").alias("text")).mapInArrow(run, _DOC).distinct()


def _keys(docs: DataFrame) -> list[F.Column]:
    return [F.xxhash64(docs["text"]).alias("k1"), F.xxhash64(F.lit(1), docs["text"]).alias("k2")]


def _agreement(span: int, share: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 2 * span - 1) for i in (4, 5))
            size = batch.column(3).to_numpy()
            best = np.zeros(len(size), np.int64)
            there = np.pad(np.cumsum(b != 0, axis=1), ((0, 0), (1, 0)))
            same = np.pad(np.cumsum((a == b) & (b != 0), axis=1), ((0, 0), (1, 0)))
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                whole = there[rows, s:] - there[rows, :-s] == s
                best[rows] = np.where(whole, same[rows, s:] - same[rows, :-s], 0).max(axis=1)
            hit = np.flatnonzero(best >= share * size - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(hit)) for i in range(3)] + [pa.array(best[hit])], names=["k1", "k2", "item", "agree"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 13, share: float = 0.8) -> DataFrame:
    """(k1, k2, items, overlap): each different text that overlaps the benchmark, by its two hashes."""
    seeds = stored(item_seeds(benchmark, span, share).distinct())
    met = _document_seeds(docs, seeds, span, share).alias("d").join(seeds.alias("i"), "h").select("k1", "k2", "item", "size", F.col("d.around").alias("a"), F.col("i.around").alias("b"))
    found = met.mapInArrow(_agreement(span, share), "k1 long, k2 long, item long, agree long")
    return found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("agree").alias("overlap"))


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = 13, share: float = 0.8) -> DataFrame:
    """doc_id, contaminated, items (benchmark item_ids, ascending), overlap (most agreeing tokens of a window) per row."""
    found = stored(contaminated(docs, benchmark, span, share))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_keys(docs)).join(found, ["k1", "k2"], "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, span: int = 13, share: float = 0.8) -> DataFrame:
    """docs without the rows that overlap the benchmark; all columns stay."""
    found = stored(contaminated(docs, benchmark, span, share).select("k1", "k2"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_keys(docs))
    return rows.join(found, ["k1", "k2"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
