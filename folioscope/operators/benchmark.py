"""Benchmark slices, nearest-rank percentiles, report deltas, gates, sweeps, votes and confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Accuracy of the sketch that brackets a percentile, and half the width of the bracket, both as shares of the rows.
ACCURACY, REACH = 10_000, 0.0005
#: Up to so many rows the bracket is all of a key's values, as one row is then a larger share than the bracket's width.
FEW = 10_000


def nearest_ranks(rows: DataFrame, key: str, value: str, percents: tuple[int, ...], **also: Column) -> DataFrame:
    """key, p<percent>...: exact nearest-rank percentiles (half to even, nulls first) of a number for each key, and aggregates.

    A mergeable sketch brackets each percentile; in a second pass the values below a bracket are counted and those inside
    it, one row a distinct value, are ranked. So no key's rows are sorted in one task, however many it has.
    """
    place = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    around = [x for p in percents for x in (max(0.0, p / 100 - REACH), min(1.0, p / 100 + REACH))]
    keep = {f"_{name}": column for name, column in also.items()} | {"_n": F.count("*")}
    bounds = rows.groupBy(key).agg(F.percentile_approx(place, around, ACCURACY).alias("_b"), F.min(place).alias("_min"), F.max(place).alias("_max"), *[c.alias(name) for name, c in keep.items()])

    def part(i):
        few = F.col("_n") <= FEW
        low, high = F.when(few, F.col("_min")).otherwise(F.col("_b")[2 * i]), F.when(few, F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        return F.when(F.col("_p") <= high, F.struct(F.lit(i).alias("i"), (F.col("_p") >= low).alias("inside"), F.when(F.col("_p") >= low, F.col("_v")).alias("v")))

    met = rows.select(key, F.col(value).alias("_v"), place.alias("_p")).join(bounds, key)
    counted = met.select(key, *keep, F.explode(F.array(*[part(i) for i in range(len(percents))])).alias("_r")).where("_r is not null")
    counted = counted.groupBy(key, "_r.i", "_r.inside", "_r.v").agg(F.count("*").alias("_c"), *[F.first(name).alias(name) for name in keep])
    ranked = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key, "i").orderBy("inside", "v")))
    reached = lambda i, p: F.col("inside") & (F.col("i") == i) & (F.col("_upto") > F.bround(F.lit(p / 100.0) * (F.col("_n") - 1), 0))
    found = [F.min(F.when(reached(i, p), F.struct("_upto", "v")))["v"].alias(f"p{p}") for i, p in enumerate(percents)]
    return ranked.groupBy(key).agg(*[F.first(f"_{name}").alias(name) for name in also], *found)


def slices(cases: DataFrame, *by: str) -> DataFrame:
    """cases: passed, latency and the columns by. Cases, pass rate and p50 / p95 latency, over all and by each column."""
    parts = F.explode(F.array(F.lit("overall"), *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in by])).alias("slice")
    each = cases.select(parts, "passed", "latency").where("slice is not null")
    return nearest_ranks(each, "slice", "latency", (50, 95), cases=F.count("*"), pass_rate=F.avg(F.col("passed").cast("int")))


def match_summary(reports: DataFrame, *keys: str) -> DataFrame:
    """exact, edit_ratio, compile_ok -> formulas, rate of exact ones, mean edit ratio and rate of those that compile."""
    mean = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 4).alias(name)
    return reports.withColumns({c: F.col(c).cast("int") for c in ("exact", "compile_ok")}).groupBy(*keys).agg(F.count("*").alias("n"), mean("exact", "exact_rate"), mean("edit_ratio", "mean_edit_ratio"), mean("compile_ok", "compile_rate"))


def delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two (slice, value) reports -> baseline, candidate and delta of each slice; a missing one counts 0."""
    both = baseline.select("slice", F.col("value").alias("b")).join(candidate.select("slice", F.col("value").alias("c")), "slice", "full")
    b, c = F.coalesce("b", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    return both.select("slice", b.alias("baseline"), c.alias("candidate"), (c - b).alias("delta"))


def change_gate(deltas: DataFrame, overall: float = 0.0, each: float = 0.05) -> DataFrame:
    """One row: whether a change may go in, and the first reason against it. Slices named suite:* are exempt."""
    bad = F.min(F.expr(f"if(slice <> 'overall' and slice not like 'suite:%' and delta < -{each}, slice, null)"))
    total = F.min(F.expr("if(slice = 'overall', delta, null)"))
    found = deltas.agg(total.alias("total"), bad.alias("bad"))
    reason = F.when(F.col("total").isNull(), "missing_overall").when(F.col("total") < -overall, "overall_regression").when(F.col("bad").isNotNull(), F.concat(F.lit("slice_regression:"), F.col("bad"))).otherwise("ok")
    return found.select((reason == "ok").alias("allowed"), reason.alias("reason"))


def confusion(scored: DataFrame) -> DataFrame:
    """accepted, expected -> counts and rates; rates are over all cases."""
    n = lambda e: F.sum(F.expr(f"if({e}, 1, 0)"))
    return scored.agg(F.count("*").alias("n"), n("accepted and expected").alias("tp"), n("accepted and not expected").alias("fp"), n("not accepted and expected").alias("fn"), n("not accepted and not expected").alias("tn")).select(
        "*", F.expr("try_divide(tp + tn, n)").alias("accuracy"), F.expr("try_divide(tp, tp + fp)").alias("precision_"), F.expr("try_divide(tp, tp + fn)").alias("coverage")
    )


def sweep(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """score, expected -> per threshold: accepts, precision, coverage, false accepts and whether it passes the release gate."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    per = scored.select("score", "expected", t).groupBy("threshold").agg(
        F.sum(F.expr("if(score >= threshold, 1, 0)")).alias("accepts"), F.sum(F.expr("if(score >= threshold and expected, 1, 0)")).alias("true_accepts"), F.sum(F.expr("if(expected, 1, 0)")).alias("positives"), F.count("*").alias("n")
    )
    wrong = F.col("accepts") - F.col("true_accepts")
    return per.select(
        "threshold", "accepts", wrong.alias("false_accepts"), F.expr("try_divide(true_accepts, accepts)").alias("precision_"), F.expr("try_divide(true_accepts, positives)").alias("coverage"),
        (F.expr("coalesce(try_divide(true_accepts, accepts) >= 0.99, false)") & (wrong <= F.greatest(F.lit(1.0), 0.01 * F.col("n")))).alias("passes"),
    )


def majority(votes: DataFrame) -> DataFrame:
    """id, a, b, c -> decision of two of three (dual: a and b agree), with the value agreed on."""
    two = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a") == F.col("c"), F.col("a")).when(F.col("b") == F.col("c"), F.col("b"))
    return votes.select("id", (F.col("a") == F.col("b")).alias("dual"), two.isNotNull().alias("two_of_three"), two.alias("value"))


def histogram(rows: DataFrame, column: str, categories: tuple[str, ...]) -> DataFrame:
    """Counts of fixed categories, 0 where none."""
    fixed = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return fixed.join(rows.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("k")), "category", "left").select("category", F.coalesce("k", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group: a fixed stratified pick."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def upsert(base: DataFrame, patch: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """base with patch's rows: patched where a key exists (nulls keep the old value), appended otherwise."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(p, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
