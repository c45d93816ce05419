"""Choosing among providers, modes and repairs: filters, ranks and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(providers: DataFrame, capability: str, preferred: tuple[str, ...] = (), network: bool | None = None, experimental: bool = False) -> DataFrame:
    """Providers that can serve a capability, ranked by preference, then stable before experimental, then registration."""
    fit = F.array_contains("capabilities", capability) & F.col("installed") & F.col("enabled") & F.col("available")
    if not experimental:
        fit = fit & ~F.col("experimental")
    if network is False:
        fit = fit & ~F.col("network_required")
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("id")) if preferred else F.lit(0)
    place = F.when(place > 0, place).otherwise(len(preferred) + 1)
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(place, "experimental", "ord"))
    return providers.where(fit).select("scope", "id", rank.alias("rank"))


def provider_status(installed: Column, enabled: Column, available: Column, healthy: Column) -> Column:
    return F.when(~installed, "not_installed").when(~enabled, "disabled").when(~available, "unavailable").when(~healthy, "unhealthy").otherwise("ok")


def promotion(rows: DataFrame, gates: tuple[str, ...], blocked: tuple[str, ...]) -> DataFrame:
    """id, current, target (levels), one boolean a gate, license, experimental, benchmark_ok -> allowed and the reasons against."""
    top = F.col("target") >= 3
    why = [F.when(F.col("target") <= F.col("current"), "not_an_upgrade"), *[F.when(~F.coalesce(F.col(g), F.lit(False)), f"gate:{g}") for g in gates]]
    why += [F.when(top & F.lower("license").isin(*blocked), "license_blocked"), F.when(top & F.col("experimental"), "still_experimental"), F.when(top & ~F.coalesce("benchmark_ok", F.lit(False)), "benchmark_required")]
    reasons = F.filter(F.array(*why), lambda x: x.isNotNull())
    return rows.select("id", (F.size(reasons) == 0).alias("allowed"), F.array_join(reasons, ",").alias("reasons"))


def plan(checks: DataFrame, capabilities: dict[str, str], budget: int = 8) -> DataFrame:
    """doc_id, check_id, status, blocking -> repair requests of a document, worst first, one a capability, at most ``budget``."""
    severity = F.when((F.col("status") == "fail") & F.col("blocking"), 0).when(F.col("status") == "fail", 1).otherwise(2)
    table = F.create_map(*[F.lit(x) for p in capabilities.items() for x in p])
    wanted = checks.where(F.col("status").isin("fail", "warn")).withColumn("capability", F.try_element_at(table, F.col("check_id"))).where("capability is not null").withColumn("severity", severity)
    one = wanted.groupBy("doc_id", "capability").agg(F.min(F.struct("severity", "check_id")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("m.severity", "m.check_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= budget).select("doc_id", "capability", F.col("m.check_id").alias("check_id"), "rank")


def page_mode(count: Column, cached: Column, unit: float = 2.65, page: float = 40.0, load: float = 0.0, safety: float = 1.2, least: int = 8) -> Column:
    """How to redo a page: nothing, from the cache, one formula, formulas in a batch, or the whole page if that is cheaper with a margin."""
    return F.when(count <= 0, "skip").when(cached, "page_reuse").when(count == 1, "formula").when(count < least, "formula_batch").when((load + page) * safety < load + count * unit, "page").otherwise("formula_batch")


def copy_consensus(rounds: DataFrame) -> DataFrame:
    """doc_id, ord, text -> the text that most rounds agree on (ties: the first seen), whether stable, and why not.

    Two agreeing rounds are stable; else lengths that differ by more than max(800, 8 %) are called unstable.
    """
    valid = rounds.where("trim(text) <> ''").withColumn("h", F.sha2(F.trim("text"), 256))
    per = valid.groupBy("doc_id", "h").agg(F.count("*").alias("k"), F.min("ord").alias("first"), F.max(F.length(F.trim("text"))).alias("n"))
    best = per.groupBy("doc_id").agg(F.max(F.struct(F.col("k"), (-F.col("first")).alias("early"), F.col("h"))).alias("b"), F.sum("k").alias("rounds"), F.min("n").alias("low"), F.max("n").alias("high"))
    drift = (F.col("rounds") >= 2) & (F.col("high") - F.col("low") > F.greatest(F.lit(800), F.floor(F.col("high") * 0.08)))
    return best.select("doc_id", F.left("b.h", F.lit(16)).alias("hash"), (F.col("b.k") >= 2).alias("stable"), F.when(F.col("b.k") >= 2, "").when(drift, "EXTRACTION_UNSTABLE").otherwise("").alias("failure"))


def page_sequence(found: Column, first: Column, last: Column) -> dict[str, Column]:
    """Missing, extra and repeated page numbers of an array, and whether it is in order."""
    want = F.sequence(first, last)
    return {
        "missing": F.size(F.array_except(want, found)).cast("long"), "extra": F.size(F.array_except(found, want)).cast("long"),
        "repeated": (F.size(found) - F.size(F.array_distinct(found))).cast("long"), "in_order": found == F.array_sort(found),
    }
