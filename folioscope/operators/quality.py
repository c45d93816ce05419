"""Verdicts and reports over checks, document profiles and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx

#: Worst first; the worst contribution decides.
VERDICTS = ("FAILED", "INCOMPLETE", "DONE_WITH_WARNINGS", "DONE_VERIFIED")


def contribution(check: Column) -> Column:
    """A check's place in VERDICTS; null if it was skipped."""
    failed = F.when(check["fatal"], 0).when(check["blocking"], 1).otherwise(2)
    return F.when(check["status"] == "fail", failed).when(check["status"] == "warn", 2).when(check["status"] == "pass", 3)


def verdict(checks: Column) -> Column:
    """The worst contribution, whatever the order; all skipped: warnings."""
    worst = F.array_min(F.transform(checks, contribution))
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.coalesce(worst, F.lit(2)) + 1)


def report(checked: DataFrame) -> DataFrame:
    """Per document: verdict, counts by status, blocking failures and warnings. checked: doc_id, checks."""
    number = lambda s: F.size(F.filter("checks", lambda c: c["status"] == s)).cast("long").alias(f"n_{s}")
    ids = lambda keep: F.array_join(F.transform(F.filter("checks", keep), lambda c: c["check_id"]), ",")
    status = verdict(F.col("checks"))
    blocking = F.when(status.isin("FAILED", "INCOMPLETE"), ids(lambda c: (c["status"] == "fail") & c["blocking"])).otherwise("")
    return checked.select("doc_id", status.alias("status"), *[number(s) for s in ("pass", "warn", "fail", "skip")], blocking.alias("blocking_failures"), ids(lambda c: c["status"].isin("warn", "fail")).alias("warnings"))


def page_profile(pages: DataFrame) -> DataFrame:
    """doc_id, text, and more -> the signals of a page."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(tx.strip(t)).cast("long")
    return pages.select("doc_id", n.alias("text_chars"), (n < tx.SCAN_CHARS).alias("scan_like"), tx.formula_like(t).alias("formula_like"), tx.looks_table(t).alias("table_like"), tx.language(t).alias("language"))


def document_profile(pages: DataFrame) -> DataFrame:
    """Pages with source (the document they belong to) -> ratios per document."""
    signals = pages.select("doc_id", "source").join(page_profile(pages), "doc_id")
    share = lambda c: F.avg(F.col(c).cast("int"))
    return signals.groupBy("source").agg(
        F.count("*").alias("page_count"), (1 - share("scan_like")).alias("text_layer_ratio"), share("scan_like").alias("scan_ratio"), share("formula_like").alias("formula_density"),
        share("table_like").alias("table_density"), F.least(F.lit(1.0), 0.3 * share("table_like")).alias("layout_complexity"),
    )


def route(profile: DataFrame) -> DataFrame:
    """Document ratios -> parser and recovery routes by threshold."""
    return profile.select(
        "source", F.when(F.col("scan_ratio") >= 0.7, "scan_parser").otherwise("text_parser").alias("parser"), F.when(F.col("formula_density") >= 0.25, "specialist").otherwise("on_demand").alias("formula"),
        F.when(F.col("table_density") >= 0.25, "specialist").otherwise("on_demand").alias("table_route"),
    )


def page_fallbacks(profiled: DataFrame) -> DataFrame:
    """Pages that need a capability, the first of scan, table, formula."""
    need = F.when(F.col("scan_like"), "vision_page").when(F.col("table_like"), "table_structure").when(F.col("formula_like"), "formula_recognition")
    return profiled.select("doc_id", need.alias("capability")).where("capability is not null")
