"""Scores and accept / reject gates over formula candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import latex as lx
from folioscope.functions.text import strip

# Fixed values that results depend on.
SPACING = r"\\(?:quad|qquad|[,;:!]|hspace\s*\{[^}]*\}|vspace\s*\{[^}]*\})"
EQUATION_MARK = r"(?i)(?:Eq\.?|Equation)\s*\(\s*\d+\s*\)"
OTHER_MARK = r"(?i)\b(fig(?:ure)?|table|tab\.?|section|sec\.?|chapter|chap\.?|year|vol\.?|pp\.?|page|pages|doi|isbn|issn)\b"
SCRAP = r"(?i)\\intertext\b|\\code\b|\\text\s*\{\s*(?:red|al|bottom|top|weighted|equative|due|graphs|wein|s\s*e\s*f\s*t\s*i\s*m\s*e|accorages|this,\s*we|scale\s+of)\s*\}"
PROSE_TEXT = r"(?i)\\text\s*\{[^}]*(?:wein|out\s+comes|predicted\s+pro|probabin|between\s+out)"
SPLIT_COMMAND = r"(?i)\\(?:Pr|mathrm|mathbf|mathcal|hat|frac|text)\s+[a-z](?:\s+[a-z]){1,}"
TABLE_FRAGMENT = r"(?im)^\s*F\s*1\s*&\s*="
STRAY_CLOSE = r"(?<!\\)\\\)"
NO_LEFT_SIDE = r"(?i)\\begin\{(?:aligned|align\*?)\}\s*&\s*="
SPACED_LETTERS = r"(?i)(?:^|[^\\a-z])([a-z])(?:\s+[a-z]){3,}(?![a-z])"
NN_FRAC = r"(?i)\\frac\s*\{\s*n\s*\}\s*\{\s*n\s*\}"
HALLUCINATION = (
    r"(?is)\\Pr\s*_\s*\{\s*\\?\s*\}\s*c\s+a\s+r|\bc\s+a\s+r\b|(?:\\quad\s*){8,}|\\stackrel\b|\\hbar\b|\{\s*\{\s*=\s*\}\s*\}|(?:\\frac\s*\{\s*n\s*\}\s*\{\s*n\s*\}\s*){2,}|"
    r"(?:\\frac\s*\{\s*\\hbar\s*\}\s*\{\s*\\hbar\s*\})|\\text\s*\{\s*tests\s*\}|\\text\s*\{\s*esense\s*\}"
)
EMPTY_BRACES = r"^(?:\{\s*\{\s*[=+\-]?\s*\}\s*\}|\\\\|\s|\\,|\\quad)*+$"
MATH_TOKEN = r"\\[a-zA-Z]+|[_^]|\{|\}|="


def _all(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def number_class(token: Column, status: Column, bound: Column, context: Column) -> Column:
    """struct(class, score): how likely a number belongs to an equation (zero, years, percentages and large ones hardly do)."""
    n = token.try_cast("int")
    marked = context.rlike(EQUATION_MARK) & F.regexp(context, F.concat(F.lit(r"(?i)(?:Eq\.?|Equation)\s*\(\s*"), F.coalesce(n.cast("string"), F.lit("0")), F.lit(r"\s*\)")))
    is_ = lambda name, score: F.struct(F.lit(name).alias("class"), F.lit(score).alias("score"))
    return (
        F.when((token == "") & (status == "unnumbered_confirmed"), is_("unnumbered", 0.35)).when(token == "", is_("none", 0.15)).when(token.rlike(r"^\d+%$|^\d+\.\d+$"), is_("non_equation_number", 0.05))
        .when(n.isNull(), is_("suspicious_number", 0.2)).when(n == 0, is_("non_equation_number", 0.05)).when(n.between(1900, 2100), F.when(marked, is_("suspicious_number", 0.15)).otherwise(is_("non_equation_number", 0.05)))
        .when(context.rlike(OTHER_MARK) & ~marked, is_("suspicious_number", 0.2)).when(n > 200, is_("suspicious_number", 0.25)).when((status == "numbered_confirmed") | bound, is_("confirmed_equation_number", 1.0))
        .when(marked, is_("plausible_equation_number", 0.85)).otherwise(F.when(n >= 1, is_("plausible_equation_number", 0.55)).otherwise(is_("suspicious_number", 0.25)))
    )


def density(text: Column) -> Column:
    t = strip(text)
    return F.when(t == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.regexp_count(t, F.lit(MATH_TOKEN)) / F.greatest(F.lit(8.0), F.length(t) / 12.0)))


def structural_score(text: Column, corruption: Column) -> Column:
    d, c = density(text), F.coalesce(corruption, F.lit(0.5))
    return 0.55 * d + 0.25 * F.least(F.lit(1.0), c) + 0.20 * F.least(F.lit(1.0), d * c)


def context_score(context: Column) -> Column:
    marks = F.regexp_count(context, F.lit(EQUATION_MARK))
    return F.when(marks >= 2, F.lit(1.0)).when(marks == 1, F.lit(0.7)).when(context.contains("$") | context.contains("\\"), F.lit(0.35)).otherwise(F.lit(0.1))


def priority(text: Column, corruption: Column, number: Column, context: Column, area: Column, right: Column, prior: Column, penalty: Column) -> Column:
    """Weighted total of the scores; a number of the wrong kind costs extra."""
    wrong = F.when(number["class"] == "non_equation_number", 0.8).when(number["class"] == "suspicious_number", 0.35).otherwise(0.0)
    return 1.0 * structural_score(text, corruption) + 1.2 * number["score"] + 0.8 * context_score(context) + 0.6 * prior + F.least(F.lit(1.0), area / 8000.0) * 0.15 + right - penalty - wrong


def rounded(x: Column, digits: int) -> Column:
    """x scaled, rounded to the nearest whole (halves away from zero) and scaled back, all in double precision.

    F.round rounds the shortest decimal that names the double, which differs where scaling itself reaches or leaves a half.
    """
    scaled = F.abs(x * 10.0**digits)
    whole = F.floor(scaled).cast("double")
    return F.signum(x) * F.when(scaled - whole >= 0.5, whole + 1.0).otherwise(whole) / 10.0**digits


def bare(text: Column) -> Column:
    """Without spacing commands and white space."""
    return F.regexp_replace(F.regexp_replace(text, SPACING, ""), r"\\[ \t]|\\{2,}|\s+", "")


def token_count(text: Column) -> Column:
    """Commands and words, spacing commands aside."""
    found = F.regexp_extract_all(F.regexp_replace(text, SPACING, " "), F.lit(r"\\[A-Za-z]+|[A-Za-z0-9]+"), F.lit(0))
    return F.size(F.filter(found, lambda t: ~F.lower(F.ltrim(F.lit("\\"), t)).isin("quad", "qquad", "hspace", "vspace"))).cast("long")


def corruption(text: Column, longest: int = 300, least_tokens: int = 10, ratio: float = 0.05, most_quads: int = 8) -> Column:
    """struct(corruption, syntax, valid, reasons): the worst of the rules that hold; valid under 0.75 with syntax of 0.5 or more."""
    raw = strip(text)
    n, meaning, tokens, quads = F.greatest(F.lit(1), F.length(raw)), F.length(bare(raw)), token_count(raw), F.regexp_count(raw, F.lit(r"\\quad\b"))
    rules = [
        ((n > longest) & (tokens < least_tokens), 1.0, "long_low_information"), (quads >= most_quads, 0.8, "quad_run"), ((quads / F.greatest(F.lit(1), tokens + quads) > 0.15) & (quads >= 4), 0.8, "quad_ratio"),
        ((meaning / n < ratio) & (n >= 40), 1.0, "spacing_only_ratio"), ((n >= 80) & (meaning <= 12) & (tokens <= 2), 1.0, "degenerate_after_strip"),
        (raw.rlike(SCRAP), 0.9, "layout_prose_scrap"), (raw.rlike(PROSE_TEXT), 0.9, "prose_in_math_text"), (raw.rlike(SPLIT_COMMAND), 0.88, "split_latex_command"), (raw.rlike(TABLE_FRAGMENT), 0.85, "amp_table_fragment"),
        (raw.rlike(STRAY_CLOSE) & ~raw.contains("\\("), 0.82, "stray_inline_close"), (raw.rlike(NO_LEFT_SIDE), 0.85, "aligned_missing_lhs"), (raw.rlike(SPACED_LETTERS), 0.85, "spaced_letter_garbage"), (raw.rlike(HALLUCINATION), 0.95, "ocr_hallucination"),
        (raw.rlike(EMPTY_BRACES), 1.0, "empty_brace_garbage"), (F.regexp_count(raw, F.lit(NN_FRAC)) >= 2, 1.0, "repeated_nn_frac"), (raw.rlike(r"^\\Gamma(?:\s|\\quad|\\,)*$"), 1.0, "degenerate_gamma"),
    ]
    open_close = lambda a, b: F.regexp_count(F.regexp_replace(raw, rf"\\[{a}{b}]", ""), F.lit(rf"[{a}]")) != F.regexp_count(F.regexp_replace(raw, rf"\\[{a}{b}]", ""), F.lit(rf"[{b}]"))
    each = [(open_close(r"\{", r"\}"), "unbalanced_{}"), (open_close(r"\[", r"\]"), "unbalanced_[]"), (open_close(r"\(", r"\)"), "unbalanced_()")]
    uneven = each[0][0] | each[1][0] | each[2][0]
    names = lambda word: F.array_sort(F.regexp_extract_all(raw, F.lit(rf"\\{word}\{{([^}}]+)\}}"), F.lit(1)))
    unmatched = names("begin") != names("end")
    worst = F.greatest(F.lit(0.0), *[F.when(c, s).otherwise(0.0) for c, s, _ in rules])
    syntax = F.when(unmatched, 0.3).when(uneven, 0.4).otherwise(1.0)
    why = F.array_join(_all([*[F.when(c, r) for c, _, r in rules], *[F.when(c, r) for c, r in each], F.when(unmatched, "env_mismatch")]), ",")
    return F.struct(worst.alias("corruption"), syntax.alias("syntax"), ((worst < 0.75) & (syntax >= 0.5)).alias("valid"), why.alias("reasons"))


def truncated(text: Column) -> Column:
    s = strip(text)
    return (s != "") & (lx.unbalanced(s) | s.rlike(r"(?:\\frac|\\times|\+|-|=)\s*$") | s.rlike(r"[\\{(]$"))


def gain(before: Column, after: Column, overlap: Column, valid: Column, cut: Column, prose: Column, conflict: Column, insufficient: Column) -> Column:
    """struct(accept, reason): vetoes in order, then improvement."""
    g = before - after
    is_ = lambda ok, why: F.struct(F.lit(ok).alias("accept"), F.lit(why).alias("reason"))
    return (
        F.when(conflict, is_(False, "ocr_context_conflict")).when(~valid, F.when(cut, is_(False, "ocr_truncated")).otherwise(is_(False, "ocr_still_invalid"))).when(prose, is_(False, "ocr_prose_recovery"))
        .when(insufficient, F.when((after <= 0.45) & ~cut, is_(True, "accept_despite_insufficient_context")).otherwise(is_(False, "insufficient_without_strong_evidence")))
        .when((g < 0.15) & (before < 0.5), is_(False, "no_significant_gain")).when((overlap < 0.05) & (before < 0.75), is_(False, "no_significant_gain")).otherwise(is_(True, "gain_accept"))
    )


def gate_class(accepted: Column, reason: Column) -> Column:
    parts = F.transform(F.split(reason, ","), lambda x: F.trim(x))
    sure = F.arrays_overlap(parts, F.array(F.lit("gain_accept"), F.lit("accept_despite_insufficient_context"))) & ~F.array_contains(parts, "ocr_context_conflict")
    return F.when(~accepted, "REJECT").when(sure, "ACCEPT_HIGH_CONFIDENCE").otherwise("ACCEPT_BORDERLINE")


def risk(geometry: Column, syntax: Column, consensus: Column) -> Column:
    """struct(risk, decision) of the layers geometry, syntax and consensus of two models."""
    is_ = lambda r, d: F.struct(F.lit(r).alias("risk"), F.lit(d).alias("decision"))
    agreed = consensus.isin("ACCEPT", "ACCEPT_VISUAL")
    return F.when(~geometry | ~syntax, is_("high", "abstain")).when(agreed, is_("low", "accept")).when(consensus == "DISAGREE", is_("high", "abstain")).otherwise(is_("medium", "abstain"))


def shadow_outcome(decision: Column, exact: Column) -> Column:
    return F.when(exact.isNull(), "no_gold").when(decision == "accept", F.when(exact, "true_accept").otherwise("false_accept")).otherwise(F.when(exact, "abstain_miss").otherwise("abstain_correct"))


def context_status(reason: Column) -> Column:
    return F.when(reason.contains("ocr_context_conflict"), "conflict").when(reason.contains("ocr_context_insufficient"), "insufficient").when(reason.contains("accept_despite_insufficient"), "insufficient_accepted").otherwise("other")


def missed_bucket(text: Column, valid: Column, worst: Column, cut: Column, status: Column, accepted: Column, numbered: Column) -> Column:
    """Why a good candidate may have been rejected; null where that is not the question."""
    base = F.when(valid & (worst <= 0.45), F.when(cut, "clean_but_flagged_truncated").otherwise("clean")).when(valid & cut, "valid_but_truncated").otherwise("other")
    asked = status.isin("insufficient", "insufficient_accepted") & ~accepted & (strip(text) != "")
    return F.when(asked, F.concat(F.when(numbered, "numbered::").otherwise("unnumbered::"), base))


def crop_or_reading(exact_wide: Column, exact_tight: Column, contaminated: Column) -> Column:
    """struct(wide, tight): whether the crop or the reading failed."""
    is_ = lambda a, b: F.struct(F.lit(a).alias("wide"), F.lit(b).alias("tight"))
    return (
        F.when(exact_tight & exact_wide, is_("OK", "OK")).when(exact_tight, is_("CROP_CLIPPED", "OK")).when(exact_wide, is_("OK", "POSTPROCESS_FAILURE"))
        .when(contaminated, is_("CROP_CLIPPED", "OCR_FAILURE")).otherwise(is_("OCR_FAILURE", "OCR_FAILURE"))
    )


def gold_issues(id_: Column, source: Column, page: Column, gold: Column, number: Column, verified: Column) -> Column:
    g = strip(gold)
    only = (number != "") & ((g == number) | (g == F.concat(F.lit("("), number, F.lit(")"))))
    return _all([F.when(id_ == "", "missing_id"), F.when(source == "", "missing_source"), F.when(page < 0, "missing_page"), F.when(g.contains("\\tag"), "gold_has_tag"), F.when(only, "gold_is_number_only"), F.when(verified & (g == ""), "verified_without_gold")])


def format_only(errors: Column, soft: tuple[str, ...], hard: tuple[str, ...]) -> Column:
    """All errors are of a soft kind and none of a hard one."""
    has = lambda e, keys: F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.lower(e).contains(k))
    return (F.size(errors) > 0) & F.forall(errors, lambda e: has(e, soft)) & ~F.exists(errors, lambda e: has(e, hard))


def clipped_box(seed: Column, neighbours: Column) -> Column:
    """The box cut at the middle of what it shares with neighbours above or below, in order; as it was if too little is left."""
    mid = lambda b: 0.5 * (b["y0"] + b["y1"])

    def step(box, nb):
        low, high = F.greatest(box["y0"], nb["y0"]), F.least(box["y1"], nb["y1"])
        near = (F.least(box["x1"], nb["x1"]) - F.greatest(box["x0"], nb["x0"]) >= 12.0) & (high - low >= 6.0)
        cut, above = 0.5 * (low + high), mid(seed) <= mid(nb)
        return F.struct(box["x0"].alias("x0"), F.when(near & ~above, F.greatest(box["y0"], cut)).otherwise(box["y0"]).alias("y0"), box["x1"].alias("x1"), F.when(near & above, F.least(box["y1"], cut)).otherwise(box["y1"]).alias("y1"))

    got = F.aggregate(neighbours, seed, step)
    return F.when(got["y1"] <= got["y0"] + 4.0, seed).otherwise(got)
