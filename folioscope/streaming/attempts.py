"""Attempt logs as streams. Every function takes a streaming (or batch) DataFrame with doc, ord, accepted, seconds, ts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct(stream: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Attempts, accepts and seconds by window of time; late rows count until the watermark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.sum("seconds").alias("seconds"))


def sessions(stream: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Attempts of a document by session."""
    return stream.withWatermark("ts", delay).groupBy("doc", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


_STATE = "n long, n_accepted long, average double, most double, tripped boolean"


def running_state(stream: DataFrame, start: float = 2.65, alpha: float = 0.3, clip: float = 3.0, limit: float = 300.0) -> DataFrame:
    """Per document and micro-batch: attempts, accepts, clipped moving average, greatest cost, and a breaker that stays tripped.

    Rows of a batch are folded in order; the state is five numbers a document, whatever its length.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, won, average, most, tripped = state.get if state.exists else (0, 0, start, 0.0, False)
        rows = pd.concat(list(frames)).sort_values("ord")
        for accepted, seconds in zip(rows["accepted"], rows["seconds"]):
            n, won, most = n + 1, won + int(accepted), max(most, float(seconds))
            tripped = bool(tripped or seconds > limit)
            if accepted:
                average = alpha * min(float(seconds), clip * average) + (1 - alpha) * average
        state.update((n, won, average, most, tripped))
        yield pd.DataFrame([(*key, n, won, average, most, tripped)], columns=["doc", "n", "n_accepted", "average", "most", "tripped"])

    rows = stream.select("doc", "ord", "accepted", "seconds")
    return rows.groupBy("doc").applyInPandasWithState(fold, f"doc long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def merged(stream: DataFrame, table: str, key: list[str]):
    """A streaming query that appends each micro-batch's new keys to a Parquet folder, at most once a key."""

    def write(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(key)
        try:
            known = spark.read.parquet(table).select(*key)
        except Exception as e:  # noqa: BLE001  no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(known, key, "left_anti")
        new.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write)
