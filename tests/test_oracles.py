"""Every query with an oracle agrees with DuckDB at sf0.01."""

import math
import os

import duckdb
import pytest

from folioscope.plans import PLANS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(name, plan) for plan in PLANS for name in plan.ORACLES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name, plan", CASES, ids=[n for n, _ in CASES])
def test_agrees(spark, con, name, plan):
    df = plan.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    cur = con.execute(plan.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([[plain(r[i]) for i in at] for r in cur.fetchall()], key=str)
    assert got


def test_rules_are_idempotent(spark):
    from folioscope.plans.structure import QUERIES

    assert QUERIES["l01_rewrite_rules"](spark, SF).where("not idempotent").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_verdict_does_not_depend_on_order(spark):
    from pyspark.sql import functions as F

    from folioscope.functions.text import check
    from folioscope.operators.quality import verdict

    a = [check("x", F.lit("pass")), check("y", F.lit("warn")), check("z", F.lit("fail"), blocking=False), check("e", F.lit("skip"))]
    row = spark.range(1).select(verdict(F.array(*a)).alias("a"), verdict(F.array(*a[::-1])).alias("b"), verdict(F.array(a[3])).alias("c"), verdict(F.array(a[0], check("f", F.lit("fail")))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("DONE_WITH_WARNINGS", "DONE_WITH_WARNINGS", "DONE_WITH_WARNINGS", "INCOMPLETE")


def test_sessions_split_only_after_a_longer_gap(spark):
    from folioscope.operators.attempts import sessions

    rows = spark.sql("SELECT 1 AS doc, ord, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts FROM VALUES (1, 0), (2, 7200), (3, 14401) t(ord, s)")
    assert sorted((r.first_ord, r.last_ord) for r in sessions(rows).collect()) == [(1, 2), (3, 3)]
