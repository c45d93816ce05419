"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges for which components() adds a task.
TASK_EDGES = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread: cuts the lineage and survives lost executors. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node that has an edge; root is the smallest node.

    Alternating large-star and small-star rounds, each a min-aggregation (combined map-side) and an equi-join with
    one row per key on one side, so that a node with very many edges is split by the skew join. Every round is
    checkpointed to the shared folder; rounds grow with the logarithm of the longest path. Tasks grow with the edges, not
    with the partitions set: what the driver keeps of tasks is much of its memory.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    seen = pairs.count()
    few = lambda df, n=6 + seen // TASK_EDGES: df.coalesce(n)  # noqa: E731; rounds make no more edges than there were
    pairs = few(pairs)
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = few(few(both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = few(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = few(small.union(few(low.select("a", F.col("m").alias("b")))).distinct()).checkpoint()
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components() did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(few(pairs.select("b", "b").distinct()))
