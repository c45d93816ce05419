"""LaTeX and small string functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import strip

# Fixed values that results depend on.
TAG = r"\\tag\*?\{[^}]*\}|\\eqno\b\s*(?:\([^)]*\)|\d+)?"
FONT = r"\\(?:mathrm|operatorname|mathbf|boldsymbol|mathit|mathtt|textrm|textbf|text)\s*\{([^{}]*)\}"
ENVIRONMENT = r"\\begin\{([^}]+)\}(?:\{[^}]*\})?|\\end\{([^}]+)\}"
SIZE = r"\\(?:left|right|big|Big|bigg|Bigg)\s*"
SPACING = r"\\(?:quad|qquad|,|;|!)\b|~+"
TRAILING_NUMBER = r"[\((]\s*\d{1,3}[a-zA-Z]?\s*[\))]\s*\.?\s*$"
TOKEN = r"\\[a-zA-Z]+|[{}\[\]()^_=+\-*/,]|[A-Za-z0-9]+|\\.|."
_OPENED = r"\\(?:mathrm|operatorname|mathbf|boldsymbol|mathit|mathtt|textrm|textbf|text)\s*\{"


def _drop(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def _unwrapped(text: Column) -> Column:
    """Without font commands at any depth: each pass unwraps the innermost, and no more passes than commands are needed."""
    n = F.regexp_count(text, F.lit(_OPENED))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), text, lambda s, _: F.regexp_replace(s, FONT, "$1"))).otherwise(text)


def canonical(text: Column) -> Column:
    """Strict canonical form: without fences, tags, fonts, sizes, spacing, braces and, after an equals sign, a trailing number."""
    s = _drop(_drop(strip(text), r"\$"), TAG)
    s = _unwrapped(s)
    s = F.regexp_replace(_drop(s, ENVIRONMENT, SIZE), r"\\(?:dfrac|tfrac)\b", r"\\frac")
    s = _drop(s, SPACING, r"[{}&]", r"\s+")
    head = F.regexp_replace(s, TRAILING_NUMBER, "")
    return _drop(F.when(head.contains("="), head).otherwise(s), r"[.,]+$")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(canonical(text), F.lit(TOKEN), F.lit(0))


def compact(text: Column) -> Column:
    return _drop(strip(text), r"\$", r"\s+")


def signature(text: Column) -> Column:
    return F.lower(_drop(compact(text), r"\\left|\\right"))


def left_side(sig: Column) -> Column:
    return F.when(sig.contains("="), F.split_part(sig, F.lit("="), F.lit(1))).otherwise("")


def gold_match(found: Column, gold: Column) -> Column:
    a, b = compact(found), compact(gold)
    return F.when(strip(gold) == "", "none").when((a == "") | (b == ""), "no").when((a == b) | a.contains(b) | b.contains(a), "yes").otherwise("no")


def braces_ok(text: Column) -> Column:
    """Braces balanced and never closed before they open."""
    step = lambda s, c: F.struct((s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), (s["ok"] & ~((c == "}") & (s["d"] <= 0))).alias("ok"))
    end = F.aggregate(F.filter(F.split(text, ""), lambda c: c.isin("{", "}")), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), step)
    return end["ok"] & (end["d"] == 0)


def structure(text: Column) -> dict[str, Column]:
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return {"n_frac": n(r"\\frac\b|\\over\b"), "n_scripts": n(r"[_^]"), "n_align": n(r"\\begin\{(?:align|aligned|split|gather)"), "n_sum": n(r"\\(?:sum|prod|int|oint|lim)\b"), "n_fonts": n(r"\\(?:mathbf|mathcal|mathrm|boldsymbol|mathscr)\b")}


def consensus(a: Column, b: Column) -> Column:
    ca, cb = canonical(a), canonical(b)
    alias = lambda c: F.regexp_replace(c, r"\\cdot|\\times", "*")
    return F.when((strip(a) == "") | (strip(b) == ""), "INCOMPLETE").when((ca != "") & (ca == cb), "ACCEPT").when((alias(ca) != "") & (alias(ca) == alias(cb)), "ACCEPT_VISUAL").otherwise("DISAGREE")


def unbalanced(text: Column) -> Column:
    plain = _drop(text, r"\\(?:left|right|bigl|bigr|Bigl|Bigr|biggl|biggr|Biggl|Biggr)\s*\\?(?:\{|\}|\.|\[|\]|\(|\))")
    return F.regexp_count(plain, F.lit(r"\{")) != F.regexp_count(plain, F.lit(r"\}"))


def prose_like(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z]{4,}")) >= 3) & ~text.contains("=") & ~text.rlike(r"\\(?:frac|sum|int|left|begin|mathrm|min|max|hat|bar)")


def with_tag(text: Column, tag: Column) -> Column:
    return F.when(text.rlike(r"\\tag\{") | (tag == ""), text).otherwise(F.concat(strip(text), F.lit(" \\tag{"), tag, F.lit("}")))


def display_block(text: Column) -> Column:
    return F.concat(F.lit("$$\n"), strip(text), F.lit("\n$$"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def drop_ratio(raw: Column, cleaned: Column) -> Column:
    return F.when(word_chars(raw) <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (word_chars(raw) - word_chars(cleaned)) / word_chars(raw)))


def subfigures(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\((i{1,3}|iv|vi{0,3}|ix|x|[a-z])\)"), F.lit(1)), lambda x: F.lower(x)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def stream_percent(base: float, span: float, chars: Column) -> Column:
    return F.lit(base) + F.lit(span) * chars / (chars + 400)


def same_major(a: Column, b: Column) -> Column:
    return F.split_part(a, F.lit("."), F.lit(1)) == F.split_part(b, F.lit("."), F.lit(1))
