"""Predicates over the text of page lines and the quality of equation blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import boxes as bx
from folioscope.functions.text import count, strip

# Fixed values that results depend on.
EQ_REFERENCE = r"(?i)\bEq(?:uation)?\.?\s*[\(（]"
TRAILING_NUMBER = r"[\(（]\s*(\d{1,3}[a-z]?)\s*[\)）]\s*$"
SECTION = r"^[A-Z0-9][A-Z0-9 \-/&]{2,}$"
PROSE_HINT = r"(?i)\b(?:where|which|that|this|using|known as|can be|calculated|from Eq|the model|true target)\b"
WORD = r"[A-Za-z\x{4e00}-\x{9fff}]{3,}"
CJK = r"[\x{4e00}-\x{9fff}]"
FRAGMENT = r"[=∑∫√±×÷^_βγαζσμℓ·⋅]|\\[a-zA-Z]|[+\-*/()]"
FORMULA_SIGN = r"[=∑∫√±×÷^_·⋅]"
RATE_NAME = r"(?<![A-Za-z])(?:TP|FP|FN|TN|TPR|FPR|Bias)(?![A-Za-z])"


def line_number(text: Column) -> Column:
    """The equation number at the end of a line; "" where there is none or the line only refers to one."""
    t = strip(text)
    return F.when(t.rlike(EQ_REFERENCE), "").otherwise(F.regexp_extract(t, TRAILING_NUMBER, 1))


def section_header(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) >= 4) & t.rlike(SECTION)


def prose(text: Column) -> Column:
    t = strip(text)
    n, cjk = F.length(t), count(t, CJK)
    return (
        F.when(n == 0, F.lit(False)).when(section_header(text), F.lit(True)).when(t.rlike("[A-Za-z]_[A-Za-z]") & t.rlike(r"[=()]"), F.lit(False))
        .otherwise((count(t, WORD) >= 8) | (t.rlike(PROSE_HINT) & (n > 32)) | ((cjk >= 8) & ((cjk / n >= 0.28) | ~t.contains("="))))
    )


def formula_line(text: Column) -> Column:
    t = strip(text)
    n = F.length(t)
    math = (line_number(text) != "") | t.rlike(FORMULA_SIGN) | t.rlike(r"\\[a-zA-Z]+") | ((n <= 28) & t.rlike(r"[+\-*/=<>]")) | ((n <= 160) & t.rlike(FRAGMENT) & t.rlike("[()]"))
    return (n > 0) & ~prose(text) & math


def math_fragment(text: Column) -> Column:
    """Formula lines, bare numbers and short pieces that hold a sign."""
    t = strip(text)
    return formula_line(text) | ((F.length(t) > 0) & ~prose(text) & (F.length(t) <= 48) & t.rlike(FRAGMENT))


def crop_tags(seed: Column, header: Column, neighbours: Column) -> Column:
    """What spoils a crop: a running header, or a neighbour that shares 0.12 of its area."""
    whole = F.when(bx.area(seed) > 0, bx.area(seed)).otherwise(1.0)
    shared = lambda b: (bx.h_overlap(seed, b) >= 12.0) & (bx.h_overlap(seed, b) * bx.v_overlap(seed, b) / whole >= 0.12)
    tags = F.array(F.when((header > 0) & (seed["y0"] < header - 0.5), "header_overlap"), F.when(F.exists(neighbours, shared), "neighbor_eq"))
    return F.filter(tags, lambda x: x.isNotNull())


def block_quality(text: Column) -> Column:
    """How much a block looks like the formula that is sought; ties go to the shorter block."""
    t = F.coalesce(text, F.lit(""))
    points = lambda found, n: F.when(found, n).otherwise(0)
    return (
        points(t.contains("="), 3) + points(t.contains("\\frac"), 4) + points(t.rlike(r"\\(?:mathrm|mathbf|left|begin)"), 2) + points(t.rlike(RATE_NAME), 2)
        - points(t.rlike(r"(?i)\bEq(?:uation)?\b"), 5) - points(count(t, "[A-Za-z]{3,}") > 12, 3)
    )


def unfenced(text: Column) -> Column:
    """Without an outer code fence; a text that isn't empty ends in a line break."""
    t = strip(F.coalesce(text, F.lit("")))
    opened = t.startswith("```")
    body = F.when(opened, F.regexp_replace(t, r"^[^\n]+\n", "")).otherwise(t)
    bare = F.when(opened, F.regexp_replace(body, r"(?U)\s*```\s*$", "")).otherwise(body)
    return F.when(bare == "", "").when(bare.endswith("\n"), bare).otherwise(F.concat(bare, F.lit("\n")))
