"""Exact percentiles agree with a plain sort, for few and many rows, ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators.benchmark import nearest_ranks


def plain(values, percent):
    ordered = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
    return ordered[round(percent / 100 * (len(ordered) - 1))]


@pytest.mark.parametrize("n, values, nulls", [(1, 10, 0.0), (13, 100, 0.0), (9_999, 10**6, 0.1), (10_001, 10**6, 0.0), (40_000, 10**6, 0.1), (40_000, 3, 0.0), (40_000, 10**6, 0.7), (20, 5, 1.0)])
def test_nearest_ranks(spark, n, values, nulls):
    random.seed(n)
    rows = [("k", None if random.random() < nulls else random.randrange(values)) for _ in range(n)]
    got = nearest_ranks(spark.createDataFrame(rows, "k string, v long"), "k", "v", (50, 95)).collect()
    own = [v for _, v in rows]
    assert [tuple(r) for r in got] == [("k", plain(own, 50), plain(own, 95))]


def test_no_rows(spark):
    assert nearest_ranks(spark.range(0).select(F.lit("k").alias("k"), F.col("id").alias("v")), "k", "v", (50,)).count() == 0
