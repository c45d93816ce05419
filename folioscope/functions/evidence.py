"""Evidence about formulas: what their context says, how formula-like a span is, what a crop holds, cache keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import gates as g
from folioscope.functions.text import count, strip

# Fixed values that results depend on.
INTRO = r"\beq\.?\b|using|defined as|given by|calculated|follows|score"
ERROR_METRIC = r"\bmse\b|bias.?variance|expected mse|mean squared"
MATH_OPS = r"[=+\-/*^_<>≤≥≈≠∈∉⊂⊃∪∩×±∞→←∂∑∫√⋅·]"
UNICODE_MATH = r"[∈∉⊂⊃∪∩×±∞≤≥≈≠→←∂∑∫√⋅·πΠσΣαβγδελμθωϕφψ]|ˆ|˛|[\x{1D400}-\x{1D7FF}]"
VARIABLE = r"(?i)\b(?:p_?i|n_?b|x_?i|y_?i|TPR|FPR|F1|TP|FP|TN|FN|ECE|Brier|conf|acc|IMD|TMA\d*)\b"
JUNK = r"˛|nb=\{|pi\s|n\s+b\s*=|b\s*-1B|1\|\s*n"
STOP_WORDS = (
    "the a an and or but if then else when while for from with without into onto upon over under about after before between among against through during until that this these those there here "
    "is are was were be been being have has had do does did can could may might must shall should will would we you they he she it of to in on at by as"
).split()
CROP_MATH = r"[=+\-*/^_{}\\()\[\]<>∑∫αβγπΠ]"
REFERENCE_CUE = (
    r"(?i)(?:\bunlike\b|\bsee\b|cf\.?|\bcompare\b|according\s+to|\bfrom\b|in\s+(?:eq|equation)|as\s+(?:in|shown\s+in)|demonstrated\s+in|discussed\s+in|described\s+in|"
    r"refer(?:ring)?\s+to|based\s+on|\bagainst\b|\bversus\b|\bvs\.?)\s*$"
)
METRIC_CUE = r"(?i)\b(?:TPR|FPR|Precision|Recall|F1|MSE|RMSE|MAE|AUC|ROC|Bias|Variance)\s*$"

#: Styled letters and digits (a Unicode block) and what they stand for, by the compatibility rule.
_STYLED = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x1D400, 0x1D800)}
_STYLED = {a: b for a, b in _STYLED.items() if a != b and len(b) == 1}


def folded(text: Column) -> Column:
    """Styled mathematical letters as plain ones."""
    return F.translate(text, "".join(_STYLED), "".join(_STYLED.values()))


def context_mismatch(body: Column, before: Column) -> Column:
    """Reasons why a formula does not fit the sentence that leads to it; formulas in that sentence don't count."""
    prose = F.regexp_replace(F.regexp_replace(before, r"\$\$[\s\S]*?\$\$", " "), r"(?<!\$)\$(?!\$)(?:\\.|[^$\\])+?\$(?!\$)", " ")
    context, low, size = F.lower(prose), F.lower(body), F.length(g.bare(body))
    intro = context.rlike(INTRO)
    brier = low.rlike(r"wein|probabin|out\s+comes") | (body.rlike(r"\\text\s*\{[^}]{15,}") & low.rlike(r"\\sum|brier"))
    f1 = low.contains("c a r") | body.rlike(r"(?i)\\Pr\s+e\s+c|F\s*1\s*&") | ((size < 20) & ~low.contains("f1"))
    rate = lambda pattern, short: intro & context.rlike(pattern) & ~low.contains(short) & (size < 40)
    found = F.array(
        F.when(intro & context.contains("recall") & ~low.rlike("recall|tp|fn|frac|=") & (size < 30), "context_mismatch_recall"),
        F.when(intro & context.rlike(r"\bf1\b|f1-score|f1 score|f1@0") & f1, "context_mismatch_f1"),
        F.when(intro & context.rlike(r"\bbrier\s+score\b|mean squared error between outcomes") & brier, "context_mismatch_brier"),
        F.when(rate(r"\btpr\b|true positive rate", "tp"), "context_mismatch_tpr"), F.when(rate(r"\bfpr\b|false positive rate", "fp"), "context_mismatch_fpr"),
        F.when(context.rlike(ERROR_METRIC) & low.rlike(r"\bomega\b|\\hbar\b") & ~low.rlike("mse|bias|variance|epsilon"), "semantically_suspicious"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def validated(text: Column, before: Column, longest: int = 300) -> Column:
    """struct(valid, severity, issues): corruption, mismatch with the context and length of a formula, its fences aside."""
    t = strip(F.coalesce(text, F.lit("")))
    display, inline = t.startswith("$$") & t.endswith("$$") & (F.length(t) >= 4), t.startswith("$") & t.endswith("$") & (F.length(t) >= 2) & ~t.startswith("$$")
    body = strip(F.when(display, F.substring(t, F.lit(3), F.length(t) - 4)).when(inline, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    quality, mismatch = g.corruption(body), context_mismatch(body, F.coalesce(before, F.lit("")))
    wrong, long = F.size(mismatch) > 0, F.length(body) > longest
    worst = F.greatest(quality["corruption"], F.when(wrong, 0.85).otherwise(0.0), F.when(long, 0.7).otherwise(0.0))
    known = F.filter(F.split(quality["reasons"], ","), lambda x: x != "")
    issues = F.concat(known, mismatch, F.when(long, F.array(F.lit("too_long"))).otherwise(F.array().cast("array<string>")))
    made = F.struct((quality["valid"] & ~wrong).alias("valid"), F.greatest(worst, 1 - quality["syntax"], F.when(wrong, 0.7).otherwise(0.0)).alias("severity"), issues.alias("issues"))
    return F.when(body == "", F.struct(F.lit(False).alias("valid"), F.lit(1.0).alias("severity"), F.array(F.lit("empty")).alias("issues"))).otherwise(made)


def span_score(text: Column) -> Column:
    """How much a bare span looks like a formula that was left without delimiters, 0 to 1."""
    t = strip(text)
    ops, words = count(t, MATH_OPS), F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))) / F.greatest(F.lit(1), F.size(words))
    add = lambda cond, n: F.when(cond, n).otherwise(0.0)
    unicode, many = t.rlike(UNICODE_MATH), F.size(words) >= 4
    score = (
        F.least(F.lit(0.35), 0.08 * ops) + add(unicode, 0.25) + add(t.rlike(VARIABLE), 0.2) + add(count(t, r"[{}\[\]]") >= 2, 0.15) + add(t.rlike(JUNK), 0.35) + add(t.rlike(r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*\S"), 0.15)
        + add(many & (stop < 0.25), 0.2) - add(many & (stop > 0.55) & (ops == 0) & ~unicode, 0.25) - add(t.contains("$"), 0.5)
    )
    return F.when(F.length(t) < 4, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def crop_class(clip: Column, height: Column) -> Column:
    """What the text below a crop says it holds: a table, prose, too little, or a formula."""
    t = strip(F.coalesce(clip, F.lit("")))
    letters, math = count(t, r"\p{L}"), count(t, CROP_MATH)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) >= 3))
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    of = lambda test: F.size(F.filter(lines, test))
    rows = (F.size(lines) >= 5) & (of(lambda x: F.size(F.split(x, r"\s+")) >= 4) >= 3) & (of(lambda x: x.rlike(r"\d")) >= 4) & (math <= 1)
    table = (count(t, r"\|") >= 4) | F.lower(t).contains("<table") | rows
    return F.when(t == "", "likely_too_small").when(table, "likely_table").when((words >= 6) & (math <= 2) & (letters > 40), "likely_prose").when(height < 40.0, "likely_too_small").otherwise("likely_formula")


def mention_class(before: Column, after: Column, defining: tuple[str, ...]) -> Column:
    """Whether a mention of an equation defines it or refers to it; ``defining`` are the phrases that announce one."""
    b, a = F.right(before, F.lit(80)), F.left(after, F.lit(40))
    announced = b.rlike(r"(?i)(?:" + "|".join(defining) + r")\s*$")
    return F.when(a.rlike(r"^\s*[:：]"), "defining").when(b.rlike(REFERENCE_CUE), "reference").when(announced | b.rlike(r"(?i)\b(?:using|by)\s*$") | b.rlike(METRIC_CUE) | b.rlike(r"(?i)Eq\.?\s*\(\s*\d+\s*\)\s*,"), "defining").otherwise("reference")


def page_key(document: Column, page: Column, recognizer: Column, config: Column) -> Column:
    """Cache key of a page: config counts with its keys sorted (a map)."""
    items = F.array_sort(F.map_entries(config))
    return F.struct(document.alias("document"), page.cast("int").alias("page"), recognizer.alias("recognizer"), F.sha1(F.to_json(items).cast("binary")).alias("config"))


def region_key(document: Column, page: Column, box: Column, recognizer: Column, scale: Column, prompt: Column, mode: Column) -> Column:
    """Cache key of a region: boxes that agree to a tenth of a point share it."""
    rounded = F.array(*[F.round(box[x], 1) for x in ("x0", "y0", "x1", "y1")])
    return F.struct(document.alias("document"), page.cast("int").alias("page"), rounded.alias("box"), recognizer.alias("recognizer"), F.round(scale, 2).alias("scale"), F.left(F.sha1(prompt.cast("binary")), F.lit(10)).alias("prompt"), mode.alias("mode"))
