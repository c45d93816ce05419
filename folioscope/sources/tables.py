"""Readers for the driver's tables and the attempt log that ``events`` stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, ord (from 1), class, accepted, seconds, ts, page, event_id: one row an attempt, in order of time."""
    events = load(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("doc"), F.row_number().over(order).alias("ord"), F.col("event_type").alias("class"), (F.col("event_type") == "purchase").alias("accepted"),
        F.col("value").alias("seconds"), "ts", F.from_json("props", "k INT")["k"].alias("page"), "event_id",
    )


#: The same in DuckDB, for oracles.
ATTEMPTS_SQL = """attempts AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS class,
  event_type = 'purchase' AS accepted, value AS seconds, ts, CAST(json_extract(props, '$.k') AS INT) AS page, event_id FROM events)"""
