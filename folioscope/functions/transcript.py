"""Transcript quality as column expressions: degeneration, structure, anchors, markers, scores and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import FIGURE_CAPTION, FIGURE_IMAGE, TABLE_ROW, count, lines, strip

#: Name in the machine markers <!-- NAME:PAGE:0001 -->; a parameter of the format.
MARK = "DOC"
PAGE_MARK = rf"<!--\s*{MARK}:PAGE:(\d{{4}})\s*-->"
PAGE_END = rf"<!--\s*{MARK}:PAGE_END:(\d{{4}})\s*-->"
FIGURE_MARK = rf"<!--\s*{MARK}:FIGURE:p(\d{{4}}):f(\d{{2}})\s*-->"
# Fixed values.
MAXIMUM = r"(?i)\\max(?:\b|_)|\bmaxim(?:is|um|ize|ise)\b|\bmax\b|arg\s*\\?max|argmax|r\s*\^\s*\{?\s*\*"
MINIMUM = r"(?i)\\min(?:\b|_)|\bminim(?:is|um|ize|ise)\b|\bmin\b|arg\s*\\?min|argmin"
NUMERIC_ANCHOR = r"(?i)\b0\.\d{2,}\b|\b[1-9]\d*\.\d+\b|\b\d+\.\d+%\b|\bN\s*=\s*[\d,]+\b|(?:Eq\.|Equation)\s*\(?\d+\)?|(?:Table|Fig\.|Figure)\s+\d+"
WORD_ANCHOR = r"\b[A-Za-z][A-Za-z0-9\-]{5,}\b"
ANCHOR_STOP_WORDS = (
    "which their these those where while would could should about after before between through during under over such than that this with from have been were will also into more most some "
    "other using used based paper figure table section abstract introduction results method methods pages volume series press university conference proceedings copyright "
    "permission reproduced published springer"
).split()
JUNK_ANCHOR = r"(?i)^(?:\d{7}\.\d{7}|\d{4}|\[\d{1,3}\]|10\.\d+.*|\d{1,4})$"


def _drop(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def degenerate(text: Column) -> Column:
    """A model that repeats itself: one letter or initial over and over, or a long run of at most two initials."""
    runs = F.regexp_extract_all(text, F.lit(r"((?:[A-Z]\.\s*){24,})"), F.lit(1))
    poor = F.exists(runs, lambda r: F.size(F.array_distinct(F.regexp_extract_all(r, F.lit(r"([A-Z])\."), F.lit(1)))) <= 2)
    return text.rlike(r"[kK]{40,}") | text.rlike(r"([A-Z])\.\s*(?:\1\.\s*){19,}") | poor


def references_heavy(text: Column) -> Column:
    head = F.substring(text, 1, 12_000)
    return head.rlike(r"(?i)\bReferences\b") | head.rlike(r"\[\d{1,3}\].{10,}https?://")


def lacks_structure(text: Column) -> Column:
    """Long text with hardly a line break, heading or table."""
    n, breaks, blanks = F.length(text), count(text, r"\n"), count(text, r"\n\n")
    flat = ((n > 3000) & (breaks < F.greatest(F.lit(8), F.floor(n / 800)))) | ((n > 5000) & (blanks < 6)) | text.rlike(rf"{MARK}:PAGE:\d{{4}} -->[^\n]{{40,}}") | (text.rlike(r"\d+\.\d+\s{2,}[A-Z]") & (blanks < 10))
    return F.when(n == 0, F.lit(True)).when(text.rlike(r"(?m)^#{1,4}\s") | text.rlike(TABLE_ROW) | (n < 800), F.lit(False)).otherwise(flat)


def page_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)), lambda x: x.cast("int"))


def rank(text: Column) -> Column:
    """How good a transcript is: its length and bonuses for pages and structure; -1 if unusable."""
    t = strip(text)
    bonus = lambda c, x: F.when(c, x).otherwise(0)
    score = F.length(t) + F.size(F.array_distinct(page_numbers(t))) * 5000 + bonus(~lacks_structure(t), 200_000) + bonus(t.rlike(r"(?m)^#{1,4}\s"), 80_000) + bonus(t.rlike(TABLE_ROW), 80_000) + bonus(t.contains(f"{MARK}:FIGURE"), 5000)
    return F.when((F.length(t) < 200) | degenerate(t), -1).otherwise(score).cast("long")


def directions(text: Column) -> tuple[Column, Column]:
    return text.rlike(MAXIMUM), text.rlike(MINIMUM)


def direction_conflict(context: Column, found: Column, original: Column) -> Column:
    """Maximum against minimum; what stood there before decides, else the context."""
    (f_max, f_min), (o_max, o_min), (c_max, c_min) = directions(found), directions(original), directions(context)
    against = lambda hi, lo: (hi & f_min & ~f_max) | (lo & f_max & ~f_min)
    return (strip(found) != "") & F.when(o_max | o_min, against(o_max, o_min)).otherwise(against(c_max, c_min))


def anchors(text: Column, least: int = 80, most: int = 48) -> Column:
    """Numbers, then long words, in lower case, that a faithful copy must hold; none for short texts."""
    t = F.regexp_replace(strip(text), r"\s+", " ")
    kept = lambda p: F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda a: F.trim(a)), lambda a: ~a.rlike(JUNK_ANCHOR) & (F.length(a) >= 3))
    low = lambda items: F.transform(items, lambda a: F.lower(a))
    stop = F.array(*[F.lit(w) for w in ANCHOR_STOP_WORDS])
    usable = F.filter(kept(WORD_ANCHOR), lambda a: a.rlike("[A-Za-z]{3,}"))

    def made(x):
        numbers = F.array_distinct(low(x["n"]))
        # words fill up to the limit, and one is added whatever the number of numbers
        words = F.slice(F.array_except(F.array_except(low(x["w"]), numbers), stop), F.lit(1), F.greatest(F.lit(1), F.lit(most) - F.size(numbers)))
        return F.concat(numbers, words)

    found = F.element_at(F.transform(F.array(F.struct(kept(NUMERIC_ANCHOR).alias("n"), usable.alias("w"))), made), 1)
    return F.when(F.length(t) < least, F.array().cast("array<string>")).otherwise(found)


def missing_anchors(found: Column, text: Column) -> Column:
    """Anchors that text lacks, whatever their case and the commas in numbers."""
    both = F.array(F.struct(F.lower(text).alias("low"), F.regexp_replace(F.lower(text), r"[,\s]", "").alias("bare")))
    there = lambda x, a: x["low"].contains(F.lower(a)) | (a.rlike(r"\d") & x["bare"].contains(F.regexp_replace(F.lower(a), r"[,\s]", "")))
    return F.element_at(F.transform(both, lambda x: F.filter(found, lambda a: ~there(x, a))), 1)


def from_first_page(text: Column) -> Column:
    """What stands from the first page marker on; all of it if there is none."""
    at = F.regexp_instr(text, F.lit(PAGE_MARK))
    return F.when(at > 0, F.expr("substring(text, regexp_instr(text, '%s'))" % PAGE_MARK.replace("\\", "\\\\"))).otherwise(strip(text))


def cleaned(text: Column) -> Column:
    t = _drop(text, PAGE_END, PAGE_MARK, rf"<!--\s*{MARK}:BATCH_(?:BEGIN|END):\d{{4}}\s*-->", r"(?m)^\s*---+\s*$")
    return F.concat(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), F.lit("\n"))


def repaired_prose(text: Column) -> Column:
    """Thousands split by dollar signs, escaped underscores, split ligatures, lone page numbers and control characters."""
    t = F.regexp_replace(F.regexp_replace(text, r"(\d+),\$(\d{3})\b", "$1,$2"), r"(\d+)\$,(\d{3})\b", "$1,$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\\_", "_"), r"\b([A-Za-z]+)\s+fi\s+([A-Za-z]+)\b", "$1fi$2")
    return _drop(F.regexp_replace(t, r"\n\n(\d{1,2})\n\n", "\n\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def math_density(text: Column) -> Column:
    t = strip(text)
    hits = F.regexp_count(t, F.lit(r"[=+^_\\{}<>∑∫≤≥]"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(8.0), F.length(t) / 12.0)))


def severity_risk(total: Column) -> Column:
    return 1.0 - 1.0 / (1.0 + total / 12.0)


def release_failures(text: Column) -> Column:
    spam = F.when(text.rlike(r"(?:\\quad\s*){8,}"), 1).otherwise(0)
    return (spam + F.regexp_count(text, F.lit("formula-not-decoded")) + F.regexp_count(text, F.lit(r"\$")) % 2).cast("long")


def caption(text: Column) -> Column:
    """struct(label, number, body) of a figure caption line."""
    pattern = r"(?i)^\s*\*{0,2}\s*((Figure|Fig\.?)\s*(S?\d+))\s*[.:=-]?\s*(.*?)\s*\*{0,2}\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(FIGURE_CAPTION), F.struct(part(1).alias("label"), part(3).alias("number"), part(4).alias("body")))


def subfigure_index(label: Column) -> Column:
    """i, ii, ... as roman numbers, else a, b, ... by letter."""
    roman = F.array_position(F.array(*[F.lit(r) for r in "i ii iii iv v vi vii viii ix x".split()]), F.lower(label))
    return F.when(roman > 0, roman).when(label.rlike("^[A-Za-z]$"), F.ascii(F.lower(label)) - 96).otherwise(label.try_cast("int")).cast("long")


def figure_errors(text: Column) -> tuple[Column, Column]:
    """(markers not replaced, captions beyond images)."""
    return count(text, FIGURE_MARK), F.greatest(F.lit(0), count(text, FIGURE_CAPTION) - count(text, FIGURE_IMAGE))


def prompt_like(text: Column, signatures: tuple[str, ...], most: int = 4500) -> Column:
    """At least two of the signatures in a text that is not long."""
    hits = sum((F.when(text.contains(s), 1).otherwise(0) for s in signatures), F.lit(0))
    return (hits >= 2) & (F.length(text) < most)


def contaminated(text: Column) -> Column:
    """Before the first page marker, at least 8 lines, most of them short titles."""
    before = F.split(text, PAGE_MARK, 2)
    own = F.transform(lines(F.element_at(before, 1)), lambda x: F.trim(x))
    short = F.filter(own, lambda x: (F.length(x) <= 48) & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9 .'-]{0,48}$"))
    return (F.size(before) > 1) & (F.size(own) >= 8) & (F.size(short) >= F.greatest(F.lit(6), F.floor(F.size(own) * 0.55)))
