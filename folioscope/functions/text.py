"""Text predicates, page profiles and QA checks as column expressions: one scan, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
MATH_NEEDLES = ("\\frac", "\\sum", "\\int", "∑", "∫", "≤", "≥")
SCAN_CHARS = 40
CJK_CHARS = 20
PAGE = r"(?im)^\s*(?:PAGE\s+(\d+)|<!--\s*PAGE\s+(\d+)\s*-->)"
PLACEHOLDER = r"(?i)<!--\s*FIGURE\b|FIGURE_PLACEHOLDER|!\[\]\(\s*\)"
FAKE_URL = r"(?i)https?://(?:example\.invalid|localhost|example\.com)/[^\s)]*"
FORMULA_FAILED = r"(?i)formula-not-decoded|Formula extraction failed"
FIGURE_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
FIGURE_CAPTION = r"(?im)^\s*\*{0,2}\s*(?:Figure|Fig\.?)\s*\d+"
TABLE_ROW = r"(?m)^\|[^\n]+\|"
REFERENCE = r"(?im)^\[\d{1,3}\]|\(\d{4}\)[.,]"
GUI_ACTION = r"(?i)\b(?:Click|Enter|Select|Save|Cancel|Continue|Help|Navigate|Press|Confirm|Exit)\b"
GUI_GLYPH = r"(?m)[▶☐☑☒]|(?:^\s*[<>]\s*$)"


def strip(text: Column) -> Column:
    """Without white space at either end, as Python strips."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def looks_table(text: Column) -> Column:
    spaced = F.filter(lines(text), lambda x: (F.regexp_count(x, F.lit("  ")) >= 3) | (F.regexp_count(x, F.lit("\t")) >= 2))
    return (F.size(lines(text)) >= 4) & (F.size(spaced) >= 3)


def formula_like(text: Column) -> Column:
    compact, found = F.replace(text, F.lit(" "), F.lit("")), F.lit(False)
    for needle in MATH_NEEDLES:
        found = found | compact.contains(needle)
    return found


def language(text: Column) -> Column:
    return F.when(strip(text) == "", "unknown").when(F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) >= CJK_CHARS, "zh").otherwise("en")


def image_ratio(text: Column) -> Column:
    own = lines(text)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: x.rlike(FIGURE_IMAGE))) / F.size(own)).otherwise(F.lit(0.0))


def figure_page(text: Column) -> Column:
    return text.rlike(FIGURE_IMAGE) | text.rlike(FIGURE_CAPTION)


def page_type(text: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """First of: empty, image (with or without text), table, reference, boilerplate, screenshot, title, short text, text."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    named = F.lit(False)
    for phrase in boilerplate:
        named = named | F.lower(t).contains(phrase.lower())
    title = (n <= 80) & ~t.endswith(".") & (((F.upper(t) == t) & (F.lower(t) != t)) | t.rlike(r"^[A-Z0-9][A-Za-z0-9 ,&/'-]{2,}$") | t.rlike(r"(?i)\b(?:Case Study|Figure|Table|Chapter)\b"))
    screenshot = t.rlike(GUI_GLYPH) | (t.rlike(GUI_ACTION) & (n < 500))
    return (
        F.when(n == 0, "empty")
        .when(figure_page(t), F.when(n >= 100, "image_text").otherwise("image"))
        .when(count(t, TABLE_ROW) >= 4, "table")
        .when(t.rlike(REFERENCE), "reference")
        .when(named, "boilerplate")
        .when(screenshot, "screenshot")
        .when(n < 100, F.when(title, "title").otherwise("text_short"))
        .otherwise("text")
    )


def reference_page(text: Column) -> Column:
    low = F.lower(text)
    return text.rlike(r"(?m)^\[\d{1,3}\]") | (text.rlike(r"\(\d{4}\)[.,]") & (low.contains("doi:") | low.contains("http") | low.contains("retrieved from")))


def least_chars(text: Column) -> Column:
    """The least length that a page of this kind is expected to have."""
    return F.when(reference_page(text), 120).when(text.rlike(r"(?i)\(contd\.\s*from\s*page"), 100).when(figure_page(text), 100).when(count(text, TABLE_ROW) >= 4, 180).otherwise(280)


def pages_found(text: Column) -> Column:
    """Distinct page numbers of the page markers, ascending."""
    numbers = F.concat(F.regexp_extract_all(text, F.lit(PAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(PAGE), F.lit(2)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("int"))))


def equation_ids(text: Column) -> Column:
    """Distinct equation ids from tags and from numbers in brackets."""
    return F.array_sort(F.array_union(F.regexp_extract_all(text, F.lit(r"\\tag\{([^}]+)\}"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?:Eq\.?\s*)?\((\d+[a-z]?)\)"), F.lit(1))))


def unclosed(text: Column) -> Column:
    """Environments that begin more often than they end."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\begin\{([A-Za-z*]+)\}"), F.lit(1)))
    times = lambda word, e: F.size(F.split(text, F.concat(F.lit(r"\Q\%s{" % word), e, F.lit(r"}\E")))) - 1
    return F.filter(names, lambda e: times("begin", e) > times("end", e))


def check(name: str, status: Column, blocking: bool = True, fatal: bool = False) -> Column:
    return F.struct(F.lit(name).alias("check_id"), status.alias("status"), F.lit(blocking).alias("blocking"), F.lit(fatal).alias("fatal"))


def checks(text: Column, required_pages: Column, required_ids: Column, anchors: Column, forbidden: tuple[str, ...], max_unresolved: int = 0) -> Column:
    """The document checks in fixed order: array<struct<check_id, status, blocking, fatal>>."""
    ok = lambda x: F.when(x, "pass").otherwise("fail")
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    failed = count(text, FORMULA_FAILED)
    marks = count(text, PLACEHOLDER) + count(text, FAKE_URL)
    struct_bad = (count(text, r"\$\$") % 2 != 0) | (F.size(unclosed(text)) > 0)
    hit = F.lit(False)
    for marker in forbidden:
        hit = hit | text.contains(marker)
    unresolved = F.when(failed > max(3, max_unresolved), "fail").when(failed > max_unresolved, "fail" if max_unresolved == 0 else "warn").otherwise("pass")
    return F.array(
        check("empty_document", ok(strip(text) != ""), fatal=True),
        check("page_coverage", F.when(none(required_pages), "skip").otherwise(ok(F.size(F.array_except(required_pages, pages_found(text))) == 0))),
        check("formula_unresolved", unresolved),
        check("formula_structural_validity", ok(~struct_bad)),
        check("equation_number_preservation", F.when(none(required_ids), F.when(F.size(equation_ids(text)) > 0, "pass").otherwise("skip")).otherwise(ok(F.size(F.array_except(required_ids, equation_ids(text))) == 0))),
        check("text_anchor_preservation", F.when(none(anchors), "skip").otherwise(ok(F.forall(anchors, lambda a: text.contains(a))))),
        check("placeholder_or_fake_url", F.when(marks == 0, "pass").when(marks < 3, "warn").otherwise("fail")),
        check("forbidden_markers", F.when(hit, "fail").otherwise("pass") if forbidden else F.lit("skip")),
    )
