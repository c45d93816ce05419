"""Matching rows of two sides: cascades, first-wins indexes, neighbours, merges, classification ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(probe: DataFrame, build: DataFrame, key: str, tiers: list[tuple[str, ...]], build_id: str, order: str) -> DataFrame:
    """For each probe row the build row of the first tier of columns that finds one; a build row is used once, by the first probe.

    On each tier's columns the build side is reduced to its first row by ``order``, so every join has one row a key.
    """
    out = probe
    for i, columns in enumerate(tiers):
        w = Window.partitionBy(*columns).orderBy(order, build_id)
        side = build.where(F.coalesce(*[F.col(c).isNotNull() for c in columns])).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*columns, F.col(build_id).alias(f"_m{i}"))
        out = out.join(side, list(columns), "left")
    found = F.coalesce(*[F.col(f"_m{i}") for i in range(len(tiers))])
    tier = F.coalesce(*[F.when(F.col(f"_m{i}").isNotNull(), F.lit(i)) for i in range(len(tiers))])
    out = out.withColumn("match", found).withColumn("tier", tier).where("match is not null")
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("match").orderBy("tier", key))).where("_r = 1").select(key, "match", "tier")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def enriched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right, and right's rows with no partner as well; says which sides a key has."""
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full").withColumn("side", side).drop("_l", "_r")


def error_class(error: Column, success: Column) -> Column:
    """First of an ordered taxonomy of error texts."""
    e = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *xs: [e.contains(x) for x in xs]
    any_ = lambda *xs: has(*xs)[0] if len(xs) == 1 else F.greatest(*has(*xs))
    return (
        F.when(success & (e == ""), "ok").when((e == "") & ~success, "result_bad").when(any_("oom", "out of memory"), "oom").when(any_("timeout", "timed out"), "timeout").when(any_("cuda", "cublas", "cudnn"), "device_error")
        .when(any_("load") & any_("model", "weight"), "load_error").when(any_("runtimeerror", "runtime error"), "runtime_error").when(any_("unavailable", "backend"), "unavailable").otherwise("result_bad")
    )


def failure_class(reason: Column, raw: Column, selected: Column, accepted: Column) -> Column:
    """Attribution of a rejected attempt from its comma-separated reasons."""
    parts = F.transform(F.split(F.lower(F.coalesce(reason, F.lit(""))), "[,|]"), lambda x: F.trim(x))
    has = lambda *xs: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in xs]))
    none, mathy = F.trim(selected) == "", raw.rlike(r"[=\\^_{}]")
    extract = has("no_equation_blocks", "no_matching_equation_block", "formula_not_found_in_ocr", "empty")
    return (
        F.when(accepted & ~none, "accepted").when(has("ocr_context_conflict"), "context_strong_conflict").when(has("ocr_context_insufficient"), "context_insufficient")
        .when(has("identity_content_conflict", "identity_unresolved"), "identity_failure").when(has("multi_formula_alignment_ambiguous"), "alignment_failure")
        .when(extract & (F.trim(raw) != "") & mathy & none, "extraction_failure").when(extract & (F.length(F.trim(raw)) < 3), "recognition_failure").when(extract, "extraction_failure")
        .when(has("ocr_still_invalid", "ocr_truncated", "no_significant_gain", "latex_invalid", "high_corruption"), "validation_failure").otherwise("unknown")
    )


def layer(detected: Column, geometry: Column, crop: Column, read: Column, exact: Column, accepted: Column, correct: Column, written: Column) -> Column:
    """The first layer of a pipeline that failed."""
    t = lambda c: F.coalesce(c, F.lit(False))
    wrong = t(accepted) & t(~correct)
    return (
        F.when(~detected, "DETECTION_FAILURE").when(~geometry, "GEOMETRY_FAILURE").when(~crop, "CROP_CLIPPED").when(~read & ~exact, F.when(wrong, "GATE_FALSE_ACCEPT").otherwise("OCR_FAILURE"))
        .when(exact & t(~accepted), "GATE_FALSE_REJECT").when(wrong, "GATE_FALSE_ACCEPT").when(t(accepted) & t(~written), "WRITEBACK_FAILURE").when(read & ~exact & t(correct), "POSTPROCESS_FAILURE")
        .when(exact, "OK").otherwise("OCR_FAILURE")
    )


#: Failure class -> action.
ACTIONS = {
    "CLIPBOARD_STALE": "recopy", "CLIPBOARD_TRUNCATED": "recopy", "COPY_NOT_FIRED": "recopy", "EXTRACTION_UNSTABLE": "recopy", "DOM_CAPTURE_FAILED": "recopy", "GENERATION_INCOMPLETE": "continue",
    "PAGE_CONTENT_SUSPECT": "page_retry", "EXTRACTION_CONFLICT": "page_retry", "PAGE_MARKER_MISSING": "page_retry", "FORMULA_INTEGRITY_FAILED": "page_retry",
}


def action(failure: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(failure)), F.lit("full_batch"))
