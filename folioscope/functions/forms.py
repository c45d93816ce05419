"""Comparison of formulas, labels and keys, page and release predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import latex as lx
from folioscope.functions.text import count, figure_page, strip

# Fixed values that results depend on.
LENIENT_FONT = r"\\(?:mathrm|mathbf|boldsymbol|mathscr|mathit|textrm|textbf)\s*\{([^{}]*)\}"
LENIENT_DROP = (r"\\begin\{[^}]+\}|\\end\{[^}]+\}", r"\\(?:left|right|big|Big|bigg|Bigg)\s*")
LENIENT_ALIASES = ((r"\bvar(?:iance)?\b", "v"), (r"\bvarepsilon\b|\bepsilon\b", "eps"), ("×", "*"))
MATH_LIKE = r"[=\\^_{}]|\$\$|(?<![A-Za-z])(?:TP|FP|FN|TN|TPR|FPR|MSE|Bias)(?![A-Za-z])"
FORMULA_LIKE = r"[=\\^_{}]|Bias|(?<![A-Za-z])(?:TP|FP|FN|TN|TPR|FPR|MSE)(?![A-Za-z])"
REAL_MATH = r"=|\\frac|\\sum|\\int|\\left|\\right|\\begin|\\mathrm|\\mathbf|\\min|\\max|\\hat|\\bar|\\times|\\cdot|\\operatorname"
METRIC_KEYS = ("TP+FN", "TP+FP", "FP+TN", "Bias", "\\frac{TP}", "Precision")
FIRST_CODE = 0x4E00


def lenient(text: Column) -> Column:
    """Lenient form: no fences, environments, sizes, fonts, spacing, braces and backslashes; lower case; a few aliases."""
    s = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\$", "")
    for pattern in LENIENT_DROP:
        s = F.regexp_replace(s, pattern, "")
    s = F.regexp_replace(F.regexp_replace(s, LENIENT_FONT, "$1"), r"\\(?:quad|qquad|,|;|!)|~+|&+|[{}]", "")
    s = F.lower(F.regexp_replace(s, r"\\|\s+", ""))
    for pattern, short in LENIENT_ALIASES:
        s = F.regexp_replace(s, pattern, short)
    return s


def environments_ok(text: Column) -> Column:
    """Every environment ends inside the one it began in."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\\(?:begin|end)\{[^}]+\}"), F.lit(0))
    name = lambda m: F.regexp_extract(m, r"\{([^}]+)\}", 1)
    none = F.array().cast("array<string>")

    def step(s, m):
        opens, fits = m.startswith("\\begin"), F.coalesce(F.try_element_at(s["stack"], F.lit(-1)) == name(m), F.lit(False))
        stack = F.when(opens, F.array_append(s["stack"], name(m))).otherwise(F.slice(s["stack"], F.lit(1), F.greatest(F.lit(0), F.size(s["stack"]) - 1)))
        return F.struct(stack.alias("stack"), (s["ok"] & (opens | fits)).alias("ok"))

    return F.aggregate(marks, F.struct(none.alias("stack"), F.lit(True).alias("ok")), step, lambda s: s["ok"] & (F.size(s["stack"]) == 0))


def compiles(text: Column) -> Column:
    s = strip(F.coalesce(text, F.lit("")))
    return (s != "") & lx.braces_ok(s) & environments_ok(s) & ~(s.contains("\\end") & ~s.contains("\\begin"))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance in tokens: every different token becomes one character."""
    ta, tb = lx.tokens(a), lx.tokens(b)
    known = F.array_distinct(F.concat(ta, tb))
    coded = lambda x, all_: F.array_join(F.transform(x, lambda t: F.decode(F.unhex(F.hex(F.array_position(all_, t) + FIRST_CODE)), "UTF-16BE")), "")
    both = F.array(F.struct(ta.alias("a"), tb.alias("b"), known.alias("k")))
    return F.element_at(F.transform(both, lambda x: F.levenshtein(coded(x["a"], x["k"]), coded(x["b"], x["k"]))), 1)


def comparison(found: Column, gold: Column) -> dict[str, Column]:
    """How far a formula agrees with the expected one; all false, with a ratio of 1, if either is missing."""
    there = (strip(F.coalesce(found, F.lit(""))) != "") & (strip(F.coalesce(gold, F.lit(""))) != "")
    ca, cb, la, lb = lx.canonical(found), lx.canonical(gold), lenient(found), lenient(gold)
    loose = (la != "") & (lb != "") & (la.contains(lb) | lb.contains(la))
    ratio = F.bround(token_distance(found, gold) / F.greatest(F.lit(1), F.size(lx.tokens(gold))), 4)
    return {"exact": there & (ca != "") & (ca == cb), "edit_ratio": F.when(there, ratio).otherwise(1.0), "compile_ok": there & compiles(found), "loose": there & loose}


def label(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def label_token(text: Column) -> Column:
    s = F.regexp_replace(label(text), r"[^A-Za-z0-9.]+", "")
    return F.when(s == "", "i").otherwise(s)


def id_label(name: Column) -> Column:
    """The equation label in a candidate's id; none for an unresolved one."""
    s = F.regexp_replace(strip(F.regexp_extract(strip(name), r"(?i)_eq(.+)$", 1)), r"_\d+$", "")
    return F.when(strip(name).rlike(r"(?i)_eqi\d+$"), "").otherwise(s)


def profile_key(device: Column, *parts: Column) -> Column:
    clean = lambda x: F.regexp_replace(F.regexp_replace(strip(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    named = lambda x: F.when(clean(x) == "", "unknown").otherwise(clean(x))
    return F.concat_ws("|", named(device), *[named(p) for p in parts])


def clean_math(text: Column) -> Column:
    """Without fences and the number at the end."""
    s = strip(F.regexp_replace(strip(text), r"^\$+|\$+$", ""))
    for pattern in (r"^\\\(|\\\)$", r"^\\\[|\\\]$", r"(?:\\quad|\\qquad|\s)*[（(]\s*\d{1,3}\s*[）)]\s*$", r"(?:\\quad|\\qquad)\s*$"):
        s = strip(F.regexp_replace(s, pattern, ""))
    return s


def formula_like(text: Column) -> Column:
    """A formula, not a reference to one, a citation mark or prose."""
    t = strip(text)
    core = F.regexp_replace(F.regexp_replace(t, r"\^\{[\d,\s]+\}|\^[0-9]+", ""), r"^[ ,.;:]+|[ ,.;:]+$", "")
    refers = t.rlike(r"(?i)\bEq(?:uation)?\.?\s*$") | t.rlike(r"(?i)(?:calculated|using|from|see|as in)\s+Eq\b")
    real, no_equals = t.rlike(REAL_MATH), ~t.contains("=")
    prose = ((count(t, "[A-Za-z]{4,}") >= 3) & no_equals & ~real) | ((count(t, "[A-Za-z]{3,}") >= 14) & no_equals & ~t.contains("\\frac"))
    return (F.length(t) >= 3) & ~refers & ~((core == "") & ~real) & ~prose & t.rlike(FORMULA_LIKE)


def raw_holds_gold(raw: Column, gold: Column) -> Column:
    """yes, no or - : whether a reading holds the expected formula somewhere."""
    g, r = lx.compact(gold), lx.compact(raw)
    core = F.regexp_replace(g, "(?i)^(recall|f1|tpr|fpr|precision|accuracy)=", "")
    hits = sum([(r.contains(k) & g.contains(k)).cast("int") for k in METRIC_KEYS[1:]], (r.contains(METRIC_KEYS[0]) & g.contains(METRIC_KEYS[0])).cast("int"))
    yes = (lx.gold_match(raw, gold) == "yes") | ((F.length(core) >= 6) & r.contains(core)) | (hits >= 2)
    return F.when(strip(gold) == "", "-").when(strip(raw) == "", "no").when(g == "", "-").when(yes, "yes").otherwise("no")


def known_subscripts(before: Column, after: Column) -> Column:
    said = F.lower(F.regexp_replace(before, r"\s+", "")).contains("h_{ic}")
    return F.when(said & after.rlike(r"(?i)H_\{\s*lc"), F.regexp_replace(after, r"(?i)H_\{\s*lc\s*\}", "H_{ic}")).otherwise(after)


def figure_only(text: Column, mark: str = "DOC") -> Column:
    """A short page of captions and markers."""
    t = strip(text)
    rest = F.regexp_replace(F.regexp_replace(t, rf"(?i)<!--\s*{mark}:[^>]*-->", ""), r"(?im)^\s*\*{0,2}\s*(?:Figure|Fig\.?)\s*\d+", "")
    return t.rlike(r"\S") & (F.length(t) <= 280) & (figure_page(t) | t.rlike(rf"(?i)<!--\s*{mark}:FIGURE")) & (F.length(strip(F.regexp_replace(F.regexp_replace(rest, r"\*+", ""), r"\s+", " "))) < 40)


def continued_references(text: Column) -> Column:
    return text.rlike(r"(?i)\(contd\.\s*from\s*page")


def math_like(text: Column) -> Column:
    return text.rlike(MATH_LIKE)


def layer_or_ok(exact: Column, found: Column, gold: Column) -> Column:
    return F.when(strip(gold) == "", "NO_GOLD").when(exact, "OK").when(strip(found) == "", "EMPTY_CANDIDATE").otherwise("OCR_FAILURE")


def recovery_yield(calls: Column, accepted: Column) -> Column:
    return F.when(calls > 0, F.bround(accepted / calls, 4))


def risk_score(severities: Column) -> Column:
    return 1 - 1 / (1 + F.aggregate(severities, F.lit(0.0), lambda s, x: s + x) / 12)


def release(text: Column, failed: Column, unwrapped: Column, skipped: Column) -> dict[str, Column]:
    """Failures that keep a document from release, and their reasons."""
    left, odd = count(text, "formula-not-decoded"), count(text, r"\$") % 2
    spam = text.rlike(r"(?:\\quad\s*){8,}")
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    thin = F.size(F.filter(blocks, lambda b: (F.length(b) >= 300) & (F.length(F.regexp_replace(b, r"\\(?:quad|qquad|[,;:!])|\s+", "")) < 20)))
    failures = spam.cast("long") + left + thin + failed + F.greatest(F.lit(0), skipped) + odd
    why = [(spam, "quad_spam_in_markdown"), (left > 0, "unresolved_formula_not_decoded"), (thin > 0, "long_low_info_display"), (failed > 0, "recovery_failed_count"), (unwrapped, "suspected_unwrapped"), (skipped > 0, "writeback_skipped"), (odd == 1, "unbalanced_dollar")]
    return {"failures": failures, "publishable": failures == 0, "reasons": F.concat_ws(",", *[F.when(c, w) for c, w in why])}


def geometry(page: Column, box: Column, crop: Column, width: Column, height: Column, margin: float = 4.0) -> Column:
    """Reasons against a formula's place on its page, comma-joined."""
    x0, y0, x1, y1 = (box[i] for i in range(4))
    near = lambda low, high, size: (size > 0) & ((low < margin) | (high > size - margin))
    inside = [((x1 <= x0) | (y1 <= y0), F.lit("degenerate_bbox")), (crop.isin("likely_prose", "likely_table"), F.concat(F.lit("suspicious_crop:"), crop)), (near(x0, x1, width), F.lit("bbox_near_x_edge")), (near(y0, y1, height), F.lit("bbox_near_y_edge"))]
    lost = box.isNull() | (F.size(box) < 4)
    return F.concat_ws(",", F.when(page.isNull(), "missing_page"), F.when(lost, "missing_bbox"), *[F.when(~lost & c, w) for c, w in inside])


def may_read(calls: Column, seconds: Column, doc_calls: Column, doc_seconds: Column, per_formula: int, per_document: int, most_formula: float, most_document: float) -> Column:
    """Whether a budget allows one more reading; 0 is no limit, but for calls a formula."""
    under = lambda used, most: F.lit(most <= 0) | (used < most)
    return F.lit(per_formula > 0) & (calls < per_formula) & under(doc_calls, per_document) & under(seconds, most_formula) & under(doc_seconds, most_document)
