"""Steps of recovery: what to try next, why an attempt failed, which block to take, and what failures cost."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import layout as ly
from folioscope.functions import text as tx
from folioscope.functions import transcript as tr
from folioscope.operators import blocks as bl

# Fixed values that results depend on.
CAPTION = r"(?i)^(?:\*\*)?\s*Figure\s+(\d+)\s*[\.:：]\s*(?:\*\*)?"
TAG = r"\\tag\{|^\s*\(\d+[a-z]?\)\s*$"
MATHY = r"[=\\^_{}]|\$\$|(?<![A-Za-z])(?:TP|FP|FN|TN|TPR|FPR|MSE|Bias)(?![A-Za-z])"
SAFE_TYPES = ("unicode_math", "decimal_split", "malformed_delimiter")
GATE_REASONS = ("insufficient_without_strong_evidence", "ocr_context_insufficient", "low_gain", "syntax_invalid")
READ_REASONS = ("no_equation_blocks", "ocr_result_bad", "ocr_empty", "ocr_timeout", "no_ocr")
WRITE_REASONS = ("writeback", "identity", "page_mismatch", "candidate_id")


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(x) for x in values])


def next_step(failure: Column, hint: Column, format_only: Column, soft_only: Column, pages: Column, retried: Column, recopied: Column, paged: Column, subbed: Column, formatted: Column, retries: Column) -> Column:
    """struct(action, pages): the escalation ladder for a failed batch; pages are distinct and ascending."""
    none = F.array().cast("array<int>")
    pending = F.array_except(pages, F.when(paged & (F.size(retried) == 0), pages).otherwise(retried))
    target = F.when(F.size(pending) > 0, pending).when(paged & ~subbed, pages).otherwise(none)
    joined = F.size(target).between(2, 5) & (F.array_max(target) - F.array_min(target) + 1 == F.size(target))
    step = lambda action, on: F.struct(F.lit(action).alias("action"), on.alias("pages"))
    return (
        F.when(failure == "MODEL_DEGENERATION", step("full_batch", pages)).when(format_only & ~formatted, step("format_fix", none)).when((hint == "recopy") & ~recopied, step("recopy", none))
        .when(soft_only, step("accept_warnings", none)).when(F.size(pending).between(1, 3), step("page_retry", pending)).when(joined & ~subbed, step("sub_batch", target))
        .when(retries >= 2, step("full_batch", pages)).when(F.size(pending) > 0, step("page_retry", F.slice(pending, 1, 3))).otherwise(step("full_batch", pages))
    )


def anomaly(failure: Column, gate: Column, raw: Column, selected: Column, skip: Column, method: Column, accepted: Column, replaced: Column, salvaged: Column) -> Column:
    """struct(is_anomaly, anomaly, actionability, reason) of an attempt, by the first rule that fits."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(F.trim(text(failure)) == "", "unknown").otherwise(F.trim(failure))
    why, chosen, skipped = text(gate), F.trim(text(selected)) != "", text(skip)
    made = lambda flag, name, act, reason: F.struct(F.lit(flag).alias("is_anomaly"), name.alias("anomaly"), act.alias("actionability"), reason.alias("reason"))
    yes = lambda name, act, reason: made(True, F.lit(name), F.lit(act), reason if isinstance(reason, Column) else F.lit(reason))
    no = lambda reason: made(False, F.lit(""), F.lit("low"), F.lit(reason))
    clean = chosen & ~why.rlike("ocr_context_conflict|ocr_still_invalid|ocr_truncated") & ~accepted
    return (
        F.when(accepted & replaced, no("accepted")).when((kind == "context_strong_conflict") | why.contains("ocr_context_conflict"), yes("ocr_bad_output", "low", "strong_context_conflict_gate_ok"))
        .when((kind == "extraction_failure") & text(raw).rlike(MATHY) & ~chosen, yes("extractor_missed_valid_raw", "high", "raw_mathy_but_no_latex"))
        .when(skipped.isin("candidate_page_mismatch", "eq_order_monotonic_conflict") | skipped.startswith("semantic_context_conflict"), yes("writeback_alignment_blocked", "high", skipped))
        .when(clean & (why.rlike("no_significant_gain|insufficient") | (kind == "validation_failure")), yes("gate_false_negative", "high", "selected_cleanish_but_rejected"))
        .when(kind == "identity_failure", yes("identity_ambiguous", "medium", kind)).when(kind == "alignment_failure", yes("alignment_ambiguous", "medium", kind))
        .when(kind == "recognition_failure", yes("ocr_bad_output", "medium", kind)).when(kind == "unknown", yes("unexpected_pipeline_state", "high", "unknown_class"))
        .when(
            kind.isin("extraction_failure", "validation_failure", "context_insufficient"),
            made(True, F.concat(F.lit("recovery_"), kind), F.when(salvaged & ~chosen, "high").otherwise("medium"), F.when(text(method) == "", kind).otherwise(method)),
        )
        .when(~accepted, yes("unexpected_pipeline_state", "low", kind)).otherwise(no("skip"))
    )


def severe(text: Column, corruption: Column, hallucinated: Column) -> Column:
    t = F.trim(text)
    return (corruption >= 0.8) | (F.regexp_count(t, F.lit("quad")) >= 8) | (F.length(t) > 400) | hallucinated


def model_route(hard: Column, corruption: Column, backend: Column, preset: Column, specialist: Column, vlm: Column, lean: Column, prefer: Column) -> Column:
    """Which model a corrupted formula goes to. A specialist backend weighs preset, severity and what is available."""
    first, large, off = F.lit("specialist_primary"), F.lit("vlm_fallback"), F.lit("abstain")
    small_then_large = F.when(specialist, first).when(vlm, large).otherwise(off)
    by_preset = (
        F.when(preset == "fast", F.when(specialist, first).otherwise(off)).when(hard & vlm, large)
        .when(hard & (preset != "quality"), F.when(specialist, first).otherwise(off)).otherwise(small_then_large)
    )
    older = F.when(vlm & (lean | hard | (prefer & (corruption >= 0.5))), "deepseek_direct").otherwise("unimernet")
    return F.when(backend == "k5_specialist", by_preset).otherwise(older)


def failure_stage(known: Column, reasons: Column, issues: Column, crop: Column, page: Column, box: Column, attempts: Column, status: Column) -> Column:
    """Where a formula failed first: geometry, crop_prose, ocr, gate or writeback. reasons are comma-separated."""
    listed = F.coalesce(issues, F.lit(""))
    parts = F.transform(F.split(F.when(F.coalesce(reasons, F.lit("")) == "", listed).otherwise(reasons), ","), lambda x: F.trim(x))
    has = lambda *names: F.arrays_overlap(parts, _texts(*names))
    kind = F.lower(F.coalesce(crop, F.lit("")))
    read = has(*READ_REASONS) | F.exists(parts, lambda p: p.startswith("ocr_") & (p != "ocr_context_insufficient"))
    return (
        F.when(F.coalesce(known, F.lit("")) != "", known).when(F.coalesce(page, F.lit(0)).eqNullSafe(0) | ~box, "geometry").when(kind.isin("likely_prose", "likely_table") | listed.contains("crop_hits"), "crop_prose")
        .when(kind == "likely_too_small", "geometry").when(has("ocr_context_conflict", *GATE_REASONS), "gate").when(read, "ocr").when(has(*WRITE_REASONS), "writeback")
        .when(has("no_bbox", "docling_formula_not_decoded"), "ocr").when((attempts > 0) & (status == "recovery_failed"), "gate").otherwise("ocr")
    )


def repair_method(kind: Column, severity: Column, mode: Column, enabled: Column, geometry: Column, vision: Column, reasoning: Column) -> Column:
    eyes = F.when(vision, "vision").otherwise("safe")
    by_severity = F.when(severity < 0.20, "keep").when(severity < 0.45, F.when(geometry, "geometry").otherwise("safe")).when(severity < 0.70, eyes).otherwise(F.when(reasoning, "reasoning").otherwise(eyes))
    return F.when(~enabled, "keep").when(mode == "safe", F.when(kind.isin(*SAFE_TYPES), "safe").otherwise("keep")).otherwise(by_severity)


def running_scores(attempts: DataFrame, recent: int = 6) -> DataFrame:
    """doc, ord, delta, total: the static score of each attempt, corrected by what was seen before it.

    attempts has doc, ord, page, source, numbered, accepted, class and score. Only windows by document; a streak is the
    distance to the last attempt of another class.
    """
    past = lambda *by: Window.partitionBy("doc", *by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("accepted").cast("int")
    number_won = F.when(F.col("numbered"), won)
    done = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    seen = attempts.withColumn("done", done)
    streak = lambda kind: F.col("done") - F.coalesce(F.max(F.when(F.coalesce(F.col("class") != kind, F.lit(True)), F.col("done") + 1)).over(past()), F.lit(0))
    seen = seen.select(
        "doc", "ord", "score", "numbered", "done", F.avg(won).over(past("page")).alias("page_rate"), F.count("*").over(past("page")).alias("page_n"), F.avg(number_won).over(past()).alias("number_rate"),
        F.count(number_won).over(past()).alias("number_n"), F.when(F.col("source") != "", F.avg(won).over(past("source"))).alias("source_rate"),
        F.coalesce(F.avg(won).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(-recent, -1)), F.lit(0.5)).alias("recent_rate"),
        streak("extraction_failure").alias("missed"), streak("context_strong_conflict").alias("clashed"),
    )
    add = lambda when, n: F.when(when, n).otherwise(0.0)
    c = F.col
    delta = (
        add(c("page_rate") >= 0.5, 0.55 + 0.35 * c("page_rate")) - add((c("page_rate") == 0) & (c("page_n") >= 2), 0.45)
        + add(c("numbered") & (c("number_rate") >= 0.5), 0.5) - add(c("numbered") & (c("number_rate") == 0) & (c("number_n") >= 2), 0.35) + add(c("source_rate") >= 0.5, 0.25)
        + add(c("missed") >= 2, F.when(c("numbered"), -0.25 * F.least(F.lit(3), c("missed") - 1)).otherwise(0.35)) + add(c("clashed") >= 2, F.when(c("numbered"), 0.3).otherwise(-0.4))
        + add((c("recent_rate") <= 0.2) & (c("done") >= 3) & c("numbered") & (c("number_rate") > 0), 0.2)
    )
    return seen.select("doc", "ord", F.round(delta, 4).alias("delta"), F.round(c("score") + delta, 4).alias("total"))


def memory_totals(memory: DataFrame) -> DataFrame:
    """by, value, occurrences, seconds, fingerprints, repeated: what failures cost by class, anomaly and actionability.

    memory has a row for each fingerprint; every row goes to its three groups in one pass, combined before the shuffle.
    """
    text = lambda name, empty: F.when(F.coalesce(name, F.lit("")) == "", empty).otherwise(F.col(name))
    pair = lambda by, value: F.struct(F.lit(by).alias("by"), value.alias("value"))
    groups = F.array(pair("class", text("class", "unknown")), pair("anomaly", F.coalesce("anomaly", F.lit(""))), pair("actionability", text("actionability", "low")))
    each = memory.select(F.explode(groups).alias("g"), F.coalesce("occurrences", F.lit(1)).alias("n"), F.coalesce("seconds", F.lit(0.0)).alias("s")).select("g.*", "n", "s").where("not (by = 'anomaly' and value = '')")
    return each.groupBy("by", "value").agg(F.sum("n").alias("occurrences"), F.round(F.sum("s"), 3).alias("seconds"), F.count("*").alias("fingerprints"), F.count_if(F.col("n") > 1).alias("repeated"))


def costliest(memory: DataFrame, k: int = 20) -> DataFrame:
    """The k fingerprints that cost most seconds (ties: more occurrences, then the fingerprint)."""
    return memory.orderBy(F.desc(F.coalesce("seconds", F.lit(0.0))), F.desc("occurrences"), "fingerprint").limit(k).select("fingerprint", "occurrences", "seconds")


def formula_tags(found: DataFrame) -> DataFrame:
    """doc_id, source_ord, target_ord: a formula block and the text block right after it that is its tag."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    after = found.select("doc_id", "ord", "kind", F.lead("kind").over(w).alias("k"), F.lead("content").over(w).alias("c"), F.lead("ord").over(w).alias("n"))
    return after.where((F.col("kind") == "formula") & (F.col("k") == "text") & tx.strip(F.coalesce("c", F.lit(""))).rlike(TAG)).select("doc_id", F.col("n").alias("source_ord"), F.col("ord").alias("target_ord"))


def with_figure_markers(docs: DataFrame, back: int = 6) -> DataFrame:
    """Texts with a marker before each figure caption that has neither marker nor image in the ``back`` lines before it.

    The marker names the page of the last page marker (1 before any) and counts the markers put on that page.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    page = F.regexp_extract("line", tr.PAGE_MARK, 1)
    near = F.max(F.col("line").contains(f"{tr.MARK}:FIGURE") | F.col("line").contains("![")).over(w.rowsBetween(-back, -1))
    rows = bl.lines(docs).select(
        "doc_id", "pos", "line", F.coalesce(F.last(F.when(page != "", page.cast("int")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)).alias("page"),
        (tx.strip(F.col("line")).rlike(CAPTION) & ~F.coalesce(near, F.lit(False))).alias("bare"),
    )
    nth = F.sum(F.col("bare").cast("int")).over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    mark = F.concat(F.lit(f"<!-- {tr.MARK}:FIGURE:p"), pad(F.col("page"), 4), F.lit(":f"), pad(nth, 2), F.lit(" -->\n\n"))
    rows = rows.select("doc_id", "pos", F.when(F.col("bare"), F.concat(mark, "line")).otherwise(F.col("line")).alias("line"), F.col("bare").cast("int").alias("put"))
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.sum("put").alias("put"))


def chosen_block(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, method, ord: the block that answers each question, by the first way that finds one.

    asked has doc_id, number, mention (offset of the first mention of the number, or null) and labels (in order of
    preference); blocks has doc_id, ord, at, number, label and content. Ways: the exact number if the block looks like a
    formula, the first block after the mention, a label (as such, else in the content), the only block there is.
    """
    b = blocks.select("doc_id", "ord", "at", F.col("number").alias("_number"), F.col("label").alias("_label"), F.coalesce("content", F.lit("")).alias("_content"))
    rows = asked.join(b, "doc_id", "left").withColumn("_q", ly.block_quality(F.col("_content"))).withColumn("_n", F.count("ord").over(Window.partitionBy("doc_id")))
    spot = lambda fits: F.transform("labels", lambda x, i: F.when(fits(x), i))
    by_label, by_text = F.array_min(spot(lambda x: x == F.col("_label"))), F.array_min(spot(lambda x: F.lower("_content").contains(F.lower(x))))
    label = F.least(by_label * 2, by_text * 2 + 1)
    known = F.coalesce("number", F.lit("")) != ""
    way = (
        F.when(F.col("ord").isNull(), None).when(known & (F.col("_number") == F.col("number")) & (F.col("_q") >= 0), 0).when(known & (F.col("at") >= F.col("mention")), 1)
        .when(label.isNotNull(), 2).when(F.col("_n") == 1, 3)
    )
    first = [F.col("_w").asc_nulls_last(), F.when(F.col("_w") == 0, -F.col("_q")), F.when(F.col("_w") == 0, F.length("_content")), F.when(F.col("_w") == 2, label), "ord"]
    best = rows.withColumn("_w", way).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*first))).where("_r = 1")
    method = F.coalesce(F.get(_texts("exact_number", "number_nearby", "label_match", "order_fallback"), F.col("_w")), F.lit("none"))
    return best.select("doc_id", method.alias("method"), F.when(F.col("_w").isNotNull(), F.col("ord")).alias("ord"))


def column_bounds(lines: DataFrame) -> DataFrame:
    """doc_id, page, left, right: the text column around a page's seed box (seed0, seed2), from the lines that lie in it.

    lines has doc_id, page, text, x0, y0, x1, y1, page_w, page_h, seed0 and seed2; one aggregation with a map-side part.
    """
    c = F.col
    body = (c("y0") > c("page_h") * 0.07) & (c("y1") < c("page_h") * 0.93) & (c("x1") - c("x0") > 20.0)
    wide = body & (c("x1") - c("x0") >= 0.48 * c("page_w"))
    right = body & (c("x0") > c("page_w") * 0.40) & ~tx.strip(F.coalesce("text", F.lit(""))).rlike(r"^[\(（]\s*\d{1,3}[a-z]?\s*[\)）]$")
    left = body & (c("x1") < c("page_w") * 0.58)
    ends = [f(F.when(cond, c(x))).alias(f"{x}_{name}") for name, cond in (("wide", wide), ("right", right), ("left", left)) for f, x in ((F.min, "x0"), (F.max, "x1"))]
    per = lines.groupBy("doc_id", "page").agg(F.max("page_w").alias("w"), F.max("seed0").alias("s0"), F.max("seed2").alias("s2"), F.count_if(wide).alias("n"), *ends)
    in_right = (0.5 * (c("s0") + c("s2")) >= c("w") * 0.48) & c("x0_right").isNotNull()
    pick = lambda x, seed: F.when(c("n") >= 3, c(f"{x}_wide")).when(in_right, c(f"{x}_right")).otherwise(F.coalesce(c(f"{x}_left"), seed))
    return per.select("doc_id", "page", F.greatest(F.lit(0.0), pick("x0", c("s0") - 72.0) - 8.0).alias("left"), F.least(c("w"), pick("x1", c("s2") + 16.0) + 8.0).alias("right"))


def band_lines(lines: DataFrame, columns: DataFrame, pad: float = 10.0) -> DataFrame:
    """The formula lines that touch a page's seed band (seed1, seed3) and lie in its column."""
    c = F.col
    near = lines.join(columns, ["doc_id", "page"]).where((c("y1") >= c("seed1") - pad) & (c("y0") <= c("seed3") + pad) & (c("x1") >= c("left") - 1.0) & (c("x0") <= c("right") + 1.0))
    return near.where(ly.math_fragment(c("text"))).select("doc_id", "page", "ord")


# ---- Spans with offsets: look-behind and overlaps need the matches one after the other

PROTECTED = (
    ("fenced_code", re.compile(r"```[\s\S]*?```|~~~[\s\S]*?~~~")),
    ("inline_code", re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("image", re.compile(r"!\[[^\]]*\]\([^)]*\)")),
    ("url", re.compile(r"https?://[^\s<>\"']+")),
    ("html", re.compile(r"<[A-Za-z][^>]*>")),
    ("yaml", re.compile(r"\A---\s*\n[\s\S]*?\n---\s*(?:\n|$)")),
)
DISPLAY = re.compile(r"\$\$[\s\S]+?\$\$")
INLINE = re.compile(r"(?<!\$)\$(?!\$)([^$]+)(?<!\$)\$(?!\$)")


def protected_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what rewriting must leave alone; of overlapping regions the first, then the longest."""
    found = [(m.start(), -m.end(), kind) for kind, pattern in PROTECTED for m in pattern.finditer(text)]
    kept, upto = [], -1
    for start, end, kind in sorted(found, key=lambda x: x[:2]):
        if start >= upto:
            kept.append((start, -end, kind))
            upto = -end
    return kept


def math_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of display spans, then of inline spans that don't begin in one."""
    display = [m.span() for m in DISPLAY.finditer(text)]
    inside, found = iter([*display, (len(text) + 1, len(text) + 1)]), []
    low, high = next(inside)
    for m in INLINE.finditer(text):
        while m.start() >= high:
            low, high = next(inside)
        if m.start() < low:
            found.append((*m.span(), "inline"))
    return [(a, b, "display") for a, b in display] + found


def spans(docs: DataFrame, find, around: tuple[int, int] = (0, 0)) -> DataFrame:
    """doc_id, start, end, kind, content of what find sees in each text (null: nothing), with the characters around it: before, after."""
    schema = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "kind": pa.string(), "content": pa.string(), "before": pa.string(), "after": pa.string()}
    left, right = around

    def run(batches):
        for batch in batches:
            rows = [(i, a, b, kind, t[a:b], t[max(0, a - left) : a], t[b : b + right]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, kind in find(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.values())], names=list(schema))

    found = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in schema.items()))
    return found if any(around) else found.drop("before", "after")


FORMAT_ISSUES = (("latex_inline", re.compile(r"\\\(.*?\\\)", re.DOTALL)), ("latex_display", re.compile(r"\\\[.*?\\\]", re.DOTALL)), ("single_line_display", re.compile(r"\$\$[^\n$]*\$\$")))
PROSE_WORDS = re.compile(r"(?i)\b(?:we|the|and|for|with|from|that|this|is|are|was|were|associated|corresponds|including|construct|dataset)\b")
TEXT_ISSUES = (
    ("decimal_split", re.compile(r"(?<![\w.])\d+\s+\.\s+\d+(?![\w.])")),
    ("suspicious_subscript", re.compile(r"\\(?:pm|le|ge|in|times|cdot)_\{[^}]+\}")),
    ("hat_corruption", re.compile(r"ˆ\s*[A-Za-z]")),
    ("detached_script", re.compile(r"(?<![A-Za-z\\$])([A-Za-z])\s*\(\s*[A-Za-z0-9]+\s*\)\s*[A-Za-z0-9]\b")),
    ("split_math_word", re.compile(r"\b(?:Pr\s+e\s+c|R\s+e\s+c|F\s+1)\b")),
    ("display_contamination", re.compile(r"\$\$[\s\S]{0,200}?\\text\{[^}]{20,}\}")),
)


def format_issues_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of delimiters that want rewriting, by kind."""
    return [(*m.span(), kind) for kind, pattern in FORMAT_ISSUES for m in pattern.finditer(text)]


def text_issues_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what looks broken in a text, prose inside maths included."""
    prose = [(a, b, "prose_in_math") for a, b, _ in math_of(text) if PROSE_WORDS.search(re.sub(r"\\text\s*\{[^}]*\}", "", text[a:b].strip("$")))]
    return [(*m.span(), kind) for kind, pattern in TEXT_ISSUES for m in pattern.finditer(text)] + prose


def without_orphan_markers(text: Column) -> Column:
    """A figure marker right after an image line goes, with the blank lines after it."""
    blank = r"(?:[^\S\n]*+\n)*+"
    return F.regexp_replace(text, rf"(?m)^([^\n]*!\[[^\]\n]*\]\([^)\n]+\)[^\n]*\n{blank})[^\n]*{tr.FIGURE_MARK}[^\n]*(?:\n{blank}|$)", "$1")


def placed_of(text: str) -> str:
    """Invented image addresses as figure markers of the page they stand on."""
    image = r"https?://example\.com/fig(?:ure)?[_-]?(\d+)\."
    page = 1

    def mark(m: re.Match) -> str:
        nonlocal page
        if m[1]:
            page = int(m[1])
            return m[0]
        return f"<!-- {tr.MARK}:FIGURE:p{page:04d}:f{int(m[2] or m[3]):02d} -->"

    return re.sub(rf"(?i){tr.PAGE_MARK}|!\[[^\]]*\]\(\s*{image}[^)]+\)|{image}(?:png|jpe?g|gif|webp)", mark, text)
