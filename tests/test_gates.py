"""Rounding of scores against DuckDB's."""

import duckdb

from folioscope.functions import gates as g

#: Totals of documents whose sixth digit lies at a half: Spark's round goes by the decimal, DuckDB's by the scaled double.
HALVES = [1.0268125, 0.7502624999999999, 1.0268125000000001, 1.0242375, 0.7502625000000003, 1.0295625, -1.0268125, -0.7502624999999999, 0.0, 2.5e-07, 1.5]


def test_scores_round_as_in_the_oracle(spark):
    rows = spark.createDataFrame([(x,) for x in [*HALVES, None]], "x double")
    got = [r.y for r in rows.select(g.rounded(rows["x"], 6).alias("y")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in [*HALVES, None]]
