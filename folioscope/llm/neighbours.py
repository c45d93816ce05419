"""Approximate nearest neighbours: a small-world graph per shard, shard results merged.

Equal vectors are indexed once, with the k + 1 smallest ids that hold them (more can't be among k neighbours), so a very
common vector is one point. Distinct vectors are dealt to shards of at most about ``shard_rows``; each shard's graph is
stored as rows with flat neighbour arrays. Queries go to every shard and are answered in blocks as they stream past;
candidates are scored in double precision on the original vectors, and the best of all shards are kept.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part;
of rows that repeat a vec_id the least vector counts; only vectors of the query's dimension are candidates; with fewer
candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import parts, stored
from folioscope.llm.hnsw import Graph

_INDEX = "shard int, dims int, node int, vector array<double>, ids array<long>, links array<int>, entry int"
_FOUND = "query_id long, vec_id long, score double"


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one a vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _build(links: int, effort: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vector", key=lambda s: s.map(tuple), ignore_index=True)
        vectors = np.stack(pdf["vector"].to_list()).astype(np.float64)
        graph = Graph.build(vectors, links, effort, seed=int(pdf["shard"].iloc[0]))
        flat = np.concatenate([x for x in graph.layers], axis=1)  # layer 0, then those above
        return pd.DataFrame({"shard": pdf["shard"], "dims": pdf["dims"], "node": np.arange(len(pdf), dtype=np.int32), "vector": pdf["vector"], "ids": pdf["ids"], "links": list(flat), "entry": graph.entry})

    return run


def build(rows: DataFrame, k: int = 20, shard_rows: int = 20_000, least_shards: int = 12, links: int = 16, effort: int = 64) -> tuple[DataFrame, int]:
    """The index as rows, stored, and its number of shards."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    distinct = stored(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most
    shards = max(least_shards, math.ceil(distinct.count() / shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("dims", F.size("vector"))
    return stored(dealt.groupBy("shard", "dims").applyInPandas(_build(links, effort), _INDEX)), shards


class _Shard:
    def __init__(self, parts_: list[dict], links: int):
        t = {name: np.concatenate([p[name] for p in parts_]) if name != "ids" else [x for p in parts_ for x in p[name]] for name in ("vector", "links", "ids")}
        self.vectors, self.ids = t["vector"], t["ids"]
        flat, wide = t["links"], links * 2
        layers = [flat[:, :wide], *[flat[:, x : x + links] for x in range(wide, flat.shape[1], links)]]
        self.graph = Graph(self.vectors, [np.ascontiguousarray(x) for x in layers], int(parts_[0]["entry"]))
        self.n = np.array([len(x) for x in self.ids])
        self.flat = np.array([i for x in self.ids for i in x], np.int64)
        self.start = np.cumsum(self.n) - self.n

    def answer(self, query_id: np.ndarray, queries: np.ndarray, k: int, effort: int):
        found = self.graph.search(queries, effort)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.zeros(len(row))
        for d in range(queries.shape[1]):  # in order, in double precision: equal vectors score the same everywhere
            score += queries[row, d] * self.vectors[node, d]
        n = self.n[node]
        row, score = np.repeat(row, n), np.repeat(score, n)
        vec = self.flat[np.repeat(self.start[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        other = vec != query_id[row]
        row, score, vec = row[other], score[other], vec[other]
        by = np.lexsort((vec, -score, row))
        row, score, vec = row[by], score[by], vec[by]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
        return query_id[row[keep]], vec[keep], score[keep]


def _search(k: int, effort: int, links: int, block: int = 256):
    def matrix(column, dtype):
        return np.array(column.to_pylist(), dtype) if len(column) else np.zeros((0, 0), dtype)

    def run(batches):
        """Rows by shard and dimension: first its index, then the queries."""
        at, index, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                part, key = batch.slice(low, high - low), tuple(keys[low].tolist())
                if key[:2] != at:
                    at, index, shard = key[:2], [], None
                if key[2] == 0:
                    index.append({"vector": matrix(part.column("vector"), np.float64), "links": matrix(part.column("links"), np.int32), "ids": part.column("ids").to_pylist(), "entry": part.column("entry")[0].as_py()})
                    continue
                if shard is None:
                    if not index:  # no vector of this dimension in this shard
                        continue
                    shard, index = _Shard(index, links), index[:1]
                ids, queries = part.column("node").to_numpy(zero_copy_only=False), matrix(part.column("vector"), np.float64)
                for x in range(0, len(ids), block):
                    q, v, s = shard.answer(ids[x : x + block], queries[x : x + block], k, effort)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 20_000, least_shards: int = 12, effort: int = 200, links: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = stored(valid(embeddings))
    index, shards = build(rows, k, shard_rows, least_shards, links)
    asked = rows.where(F.col("vec_id") % every == 0)
    columns = lambda kind, node, ids, links_, entry: ["shard", "dims", F.lit(kind).alias("kind"), node.cast("long").alias("node"), "vector", ids.alias("ids"), links_.alias("links"), entry.alias("entry")]
    known = index.select(*columns(0, F.col("node"), F.col("ids"), F.col("links"), F.col("entry")))
    null = lambda t: F.lit(None).cast(t)
    sent = asked.select("vec_id", "vector", F.size("vector").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sent = sent.select(*columns(1, F.col("vec_id"), null("array<long>"), null("array<int>"), null("int")))
    met = known.unionByName(sent).repartition(max(shards, parts(spark)), "shard", "dims").sortWithinPartitions("shard", "dims", "kind", "node")
    found = met.mapInArrow(_search(k, effort, links), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
