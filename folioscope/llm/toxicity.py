"""Toxicity: linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

Features: presence of lower-cased character n-grams (3 to 6 characters, white space as one space), hashed to 2**18
buckets. From labelled rows, r = log of the smoothed ratio of a bucket's document rate in toxic and in other rows; the
buckets whose r stands out most from chance are kept and a logistic regression is fitted to presence times r.

The fit takes at most ``per_class`` labelled rows of each class, those of smallest hash of doc_id, whatever the size of
the input; counts are weighted back to the classes' true sizes, so scores keep the corpus' rate. Everything else covers
all rows and whole texts. Defined results: null or empty text is scored by its lack of any n-gram; a doc_id labelled
more than once is toxic if any label says so; null labels don't teach; with no labelled row of one class every score is
that of the other class (0 without any label); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

BITS = 18
SIZES = (3, 4, 5, 6)
_MUL = np.uint32(0x9E3779B1)
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # bucket -> feature, -1 if dropped
    weight: np.ndarray  # by feature: fitted weight times log-count ratio
    bias: float


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _buckets(text: str | None, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, or their features where slot is given. Long texts go by overlapping blocks."""
    chars = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32)
    found = []
    for at in range(0, max(1, len(chars) - max(SIZES) + 1), _BLOCK):
        part = chars[at : at + _BLOCK + max(SIZES) - 1]
        h = part * _MUL
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MUL + part[n - 1 :]
            if n in SIZES:
                b = ((h ^ (h >> np.uint32(16))) * _MUL + np.uint32(n)) * _MUL >> np.uint32(32 - BITS)
                if slot is not None:
                    b = slot[b]
                    b = b[b >= 0]
                found.append(b)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _count(batches):
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            seen[toxic, _buckets(text.as_py())] += 1
    yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])


def _present(slot):
    def run(batches):
        for batch in batches:
            rows = [_buckets(t.as_py(), slot).astype(np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], names=["toxic", "found"])

    return run


def _minimise(f, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0, grad @ q
        while True:
            new_value, new_grad = f(x - step * q)
            if new_value <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = -step * q, new_grad - grad
        x, done = x + s, value - new_value < 1e-7 * max(1.0, abs(value))
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        value, grad = new_value, new_grad
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 20_000, ridge: float = 1.0) -> Model:
    """Fit to rows of docs that labels marks and that aren't held out."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        top = known.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = top if chosen is None else chosen.union(top)
    # at most 2 * per_class ids: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    rows = stored(rows)
    seen = np.zeros((2, 1 << BITS), np.int64)
    n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    slot = np.full(1 << BITS, -1, np.int32)
    if not n[0] or not n[1]:
        return Model(slot, np.zeros(0), 30.0 if n[1] else -30.0)
    for part in rows.coalesce(8).mapInArrow(_count, "seen binary").toLocalIterator():
        seen += np.frombuffer(part["seen"], np.int32).reshape(2, -1)
    rate = (seen + 0.5) / (np.array([[n[0]], [n[1]]]) + 1.0)
    ratio = np.log(rate[1] / rate[0])
    stand = np.abs(ratio) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    stand[seen.sum(axis=0) < 4] = 0
    best = np.argsort(-stand, kind="stable")[:features]
    best = best[stand[best] > 3.0]
    slot[best] = np.arange(len(best))
    ratio = ratio[best]

    mark, lens, ids = [], [], []
    for r in rows.mapInArrow(_present(slot), "toxic int, found binary").toLocalIterator():
        f = np.frombuffer(r["found"], np.int32).astype(np.uint16)
        mark.append(r["toxic"])
        lens.append(len(f))
        ids.append(f)
    mark, lens, ids = np.array(mark), np.array(lens), np.concatenate([*ids, np.zeros(0, np.uint16)])
    ends = np.cumsum(lens)
    weigh = np.where(mark == 1, total[1] / n[1], total[0] / n[0])
    weigh = weigh / weigh.mean()

    def loss(v):
        value, grad, w = 0.5 * ridge * (v[:-1] @ v[:-1]), np.append(ridge * v[:-1], 0.0), v[:-1] * ratio
        for low in range(0, len(mark), 256):  # by blocks of rows: the driver holds little beside the features
            part = slice(low, low + 256)
            of, y, k = np.repeat(np.arange(len(lens[part])), lens[part]), mark[part], weigh[part]
            own = ids[ends[low] - lens[low] : ends[part][-1]]
            z = np.bincount(of, weights=w[own], minlength=len(y)) + v[-1]
            value += (k * (np.logaddexp(0, z) - y * z)).sum()
            err = k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad[:-1] += np.bincount(own, weights=err[of], minlength=len(best)) * ratio
            grad[-1] += err.sum()
        return value, grad

    v = _minimise(loss, np.zeros(len(best) + 1))
    return Model(slot, v[:-1] * ratio, float(v[-1]))


def _scorer(model):
    def run(batches):
        m = model.value
        for batch in batches:
            z = np.array([m.weight[_buckets(t.as_py(), m.slot)].sum() + m.bias for t in batch.column("text")], np.float64)
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. The model has a fixed size: 2**18 slots and at most ``features`` weights."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        m = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            clean = [bool(m.weight[_buckets(t.as_py(), m.slot)].sum() + m.bias < limit) for t in column]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
