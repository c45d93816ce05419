"""What a transcript, a formula or a text must keep: markers, fences, numbers, slots and schemas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import transcript as tr
from folioscope.functions.text import strip

# Fixed values that results depend on.
JOURNAL_HEADERS = r"(?i)npj Science of Learning|www\.nature\.com/scientificreports"
EXAMPLE_IMAGE = r"(?i)https?://example\.com/(?:fig(?:ure)?[_-]?)\d+\.(?:png|jpg|jpeg|gif|webp)|!\[[^\]]*\]\(\s*https?://example\.com/(?:fig(?:ure)?[_-]?)\d+\.[^)]+\)"
CONTAMINATED = r"(?i)\\begin\{array\}|\\intertext|identified|calculated using|the model|\\text\{tests\}|Eq\.\s*\(\d+\)|\\quad(\{\})?\\quad"
FAILURES = (
    (("模型输出退化", "缩写循环"), "MODEL_DEGENERATION"),
    (("公式完整性", "formula"), "FORMULA_INTEGRITY_FAILED"),
    (("缺页",), "PAGE_MARKER_MISSING"),
    (("过短", "截断", "sourceguard", "锚点"), "PAGE_CONTENT_SUSPECT"),
    (("extraction_unstable",), "EXTRACTION_UNSTABLE"),
)
TOPICS = {  # words of the context, words of the formula that speak against it
    "isotonic": (("isotonic", "nondecreasing", "non-decreasing", "least squares", "xi-1", "x_{i-1}"), ("pr(m", "pr(m_", "m_1|d", "m_2|d", "bayes factor", "\\frac{pr(")),
    "bayes": (("bayes factor", "bayes factors", "model comparison", "models m_1", "models m 1"), ("isotonic", "nondecreasing", "x_{i-1}", "least squaresfit")),
    "membership": (("membership matrix", "belongs to community", "node i belongs"), ("p_{t+1}", "p_t q", "mathbf{p}_{t+1}", "transition matrix")),
    "transition": (("transition matrix", "discrete-time process", "random walk", "p_{t+1}"), ("h_{lc}", "h_{i c}", "membership matrix", "belongs to community")),
    "markov_stability": (("markov stability", "autocovariance matrix", "block autocovariance", "cost function, the markov"), ("h_{lc}=", "belongs to community", "isotonic")),
}
LABELS = (
    ("recall", r"\brecall\b"), ("f1", r"\bf1(?:\s*-?\s*score)?\b"), ("tpr", r"\btpr\b|\btrue\s+positive\s+rate\b"), ("fpr", r"\bfpr\b|\bfalse\s+positive\s+rate\b"),
    ("precision", r"\bprecision\b"), ("mse", r"\bmse\b|\bmean\s+squared\s+error\b|\bbias\b"), ("accuracy", r"\baccuracy\b"),
)
MODEL_NOISE = (r"(?is)<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>|<\|[^|>]+?\|>", r"(?i)<[^>]*end[^>]*>", r"\x{200b}")
NOT_DECODED = r"(?i)<!--\s*formula-not-decoded(?:\b[^>]*)?\s*-->"
ORPHAN_WHERE = r"(?i)(?:was|following|equation|model|specification|formulation)\s*:\s*(?:\n\s*){1,4}where\b"
HAS_FORMULA = r"(?is)\$\$.+?\$\$|\\logit\b|\\beta[_\{]|\\sum[_\{]|\\operatorname\b|\\frac\b|\\begin\{aligned\}"
LINE_NUMBER = r"^(.*?)(?:\\quad\s*)?\((\d{1,2})\)\s*$"
FORMULA_SIGN = r"\$|\\[A-Za-z]+|[_^]"
TRUE_RATE, FALSE_RATE = r"(?i)\bTPR\b|true\s*positive\s*rate", r"(?i)\bFPR\b|false\s*positive\s*rate"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def _first(rules, otherwise) -> Column:
    """The value of the first (condition, value) that holds."""
    return F.coalesce(*[F.when(holds, F.lit(value)) for holds, value in rules], F.lit(otherwise))


def header_page(text: Column, most: int = 280) -> Column:
    """A short page that holds no more than a journal's repeated header."""
    t = strip(_text(text))
    return (F.length(t) <= most) & (t.contains("Published in partnership") | t.rlike(JOURNAL_HEADERS))


def example_images(text: Column) -> Column:
    """Images that a model made up at an example address."""
    return _text(text).rlike(EXAMPLE_IMAGE)


def validation_class(errors: Column, mark: str = tr.MARK) -> Column:
    """What kind of failure a batch's messages speak of, the gravest first."""
    t = F.lower(F.array_join(F.coalesce(errors, F.array().cast("array<string>")), " "))
    own = {"PAGE_MARKER_MISSING": t.contains(f"未找到任何 {mark.lower()}:page")}
    rules = [(_any(t, needles) | own.get(name, F.lit(False)), name) for needles, name in FAILURES]
    return _first([*rules, (t.contains("copy") & t.contains("未"), "COPY_NOT_FIRED")], "EXTRACTION_CONFLICT")


def contaminated_formula(text: Column) -> Column:
    """A reading that took in more than the formula."""
    t = _text(text)
    return ((F.regexp_count(t, F.lit(r"\(")) >= 3) & t.contains("frac") & t.contains("quad")) | t.rlike(CONTAMINATED)


def slot_conflict(before: Column, formula: Column, window: int = 280) -> Column:
    """The topic of the text just before that a formula speaks against; "" if none."""
    flat = lambda t: F.regexp_replace(F.lower(_text(t)), r"(?U)\s+", " ")
    context, own = flat(F.right(_text(before), F.lit(window))), flat(formula)
    rules = [(_text(formula).rlike(r"\\[a-zA-Z]+|[_^]") & _any(context, here) & _any(own, against), topic) for topic, (here, against) in TOPICS.items()]
    return _first(rules, "")


def identity_conflict(name: Column, formula: Column) -> Column:
    """A formula numbered 6 that defines the false positive rate, or one numbered 7 that defines the true one."""
    number, t = F.regexp_extract(_text(name), r"(?i)_eq(\d+)$", 1), _text(formula)
    tpr, fpr = t.rlike(TRUE_RATE), t.rlike(FALSE_RATE)
    return ((number == "6") & fpr & ~tpr & t.rlike(r"(?i)FPR\s*=|FalsePositive")) | ((number == "7") & tpr & ~fpr & t.rlike(r"(?i)TPR\s*=|TruePositive"))


def metric_label(text: Column) -> Column:
    """The first metric of a fixed order that a text names; "" if none."""
    return _first([(_text(text).rlike(f"(?i){pattern}"), name) for name, pattern in LABELS], "")


def without_noise(text: Column) -> Column:
    """Without grounding marks, end tokens and zero-width spaces."""
    t = _text(text)
    for pattern in MODEL_NOISE:
        t = F.regexp_replace(t, pattern, "")
    return t


def prior(conflict: Column, extraction: Column, insufficient: Column, number_class: Column, parsed: Column) -> Column:
    """How often formulas of this kind were recovered: a base, more for a plausible number or a parsed formula."""
    share = conflict / F.greatest(F.lit(1), conflict + extraction + insufficient)
    by_number = F.when(number_class.isin("confirmed_equation_number", "plausible_equation_number"), 0.15).when(number_class == "non_equation_number", -0.1).otherwise(0.0)
    total = F.lit(0.55) + by_number + F.when(parsed, 0.05).otherwise(0.0) - F.when(share > 0.45, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def conflict_penalty(conflict: Column, total: Column, number_class: Column) -> Column:
    """What a high share of conflicts takes from a formula without a plausible number."""
    share = conflict / F.when(total == 0, 1).otherwise(total)
    weak = number_class.isin("none", "unnumbered", "non_equation_number")
    return F.when(weak & (share > 0.4), F.round(F.least(F.lit(0.3), share * 0.4), 4)).otherwise(F.lit(0.0))


def lost_anchors(numbers: Column, text: Column, most: int = 8) -> Column:
    """Numeric anchors of a page that its transcript lacks; none unless three or more, and half of them, are missing."""
    missing = tr.missing_anchors(numbers, _text(text))
    grave = (F.size(numbers) >= 2) & (F.size(missing) >= 3) & (F.size(missing) >= F.floor(F.size(numbers) / 2))
    return F.when(grave, F.slice(missing, 1, most)).otherwise(F.array().cast("array<string>"))


def recovered(text: Column, signatures: tuple[str, ...], sidebar: tuple[str, ...] = (), most: int = 4500, most_sidebar: int = 1200) -> Column:
    """A transcript from its first page marker on; empty if all of it is the request or a sidebar."""
    t = F.replace(_text(text), F.lit("\r\n"), F.lit("\n"))
    at = F.regexp_instr(t, F.lit(tr.PAGE_MARK))
    body = F.when(at > 0, F.substr(t, at)).otherwise(t)
    asked = tr.prompt_like(body, signatures, most) | (_any(body, sidebar) & (F.length(strip(body)) < most_sidebar))
    return F.when((strip(t) == "") | asked, "").otherwise(body)


def figure_numbers(text: Column) -> Column:
    """marker=number for each figure marker with a numbered caption right behind it."""
    pattern = tr.FIGURE_MARK + r"\s*(?:\*\*)?\s*[Ff][Ii][Gg][Uu][Rr][Ee]\s+(\d+)\s*[.:：]"
    part = lambda i: F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(i))
    return F.zip_with(F.zip_with(part(1), part(2), lambda p, f: F.concat(F.lit("p"), p, F.lit(":f"), f)), part(3), lambda key, n: F.concat(key, F.lit("="), n.cast("int").cast("string")))


def equation_numbers(text: Column) -> Column:
    """Numbers at the end of lines that hold a formula; elsewhere (3) numbers a question."""
    parts = F.split(F.replace(_text(text), F.lit("\r\n"), F.lit("\n")), r"\$\$")
    inside = lambda x, i, all_: (i % 2 == 1) & (i < F.size(all_) - 1)
    # a line that begins inside a block is marked; one that holds a fence has a formula's sign anyway
    marked = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda x, i: F.when(inside(x, i, p), F.replace(x, F.lit("\n"), F.lit("\n\x01"))).otherwise(x)), "$$")), 1)
    numbered = F.filter(F.split(marked, "\n"), lambda x: x.rlike(LINE_NUMBER) & (x.startswith("\x01") | F.regexp_extract(x, LINE_NUMBER, 1).rlike(FORMULA_SIGN)))
    return F.transform(numbered, lambda x: F.regexp_extract(x, LINE_NUMBER, 2).cast("int"))


def lost_formula(text: Column, reach: int = 120) -> Column:
    """A formula announced, and "where" right behind, with none in between or just before."""
    t = F.replace(_text(text), F.lit("\r\n"), F.lit("\n"))
    before, hits = F.split(t, ORPHAN_WHERE), F.regexp_extract_all(t, F.lit(ORPHAN_WHERE), F.lit(0))
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("lost"))

    def step(s, x):
        seen = F.right(F.concat(s["tail"], x["text"]), F.lit(reach))
        return F.struct(F.right(F.concat(seen, x["hit"]), F.lit(reach)).alias("tail"), (s["lost"] | ~(seen.rlike(HAS_FORMULA) | x["hit"].rlike(HAS_FORMULA))).alias("lost"))

    pairs = F.zip_with(F.slice(before, F.lit(1), F.size(hits)), hits, lambda b, h: F.struct(b.alias("text"), h.alias("hit")))
    return F.aggregate(pairs, start, step)["lost"]


def formula_penalty(text: Column, from_one: Column) -> Column:
    """Two millions for a lost formula and for a gap in the equation numbers (from 1, or from the least one)."""
    tags = F.transform(F.regexp_extract_all(_text(text), F.lit(r"\\tag\{(\d{1,2})\}"), F.lit(1)), lambda x: x.cast("int"))
    numbers = F.array_distinct(F.concat(equation_numbers(text), tags))
    gap = F.element_at(F.transform(F.array(numbers), lambda n: (F.size(n) > 0) & (F.array_max(n) - F.when(from_one, 1).otherwise(F.array_min(n)) + 1 > F.size(F.filter(n, lambda x: (x >= 1) | ~from_one)))), 1)
    return (lost_formula(text).cast("long") + F.coalesce(gap, F.lit(False)).cast("long")) * 2_000_000


def fragment(text: Column, header_lines: int = 32) -> Column:
    """The fragment that a clipboard's header points at; without one its html element, else all of it."""
    t = F.replace(_text(text), F.lit("\r\n"), F.lit("\n"))
    head = F.array_join(F.slice(F.split(t, "\n"), 1, header_lines), "\n")
    # a header that is given twice counts as it stands last
    offset = lambda name: F.try_element_at(F.regexp_extract_all(head, F.lit(rf"(?m)^{name}:\s*(\d+)\s*$"), F.lit(1)), F.lit(-1)).cast("int")
    start, end = offset("StartFragment"), offset("EndFragment")
    element = F.regexp_extract(t, r"(?is)<html.*</html>", 0)
    return F.when(end > start, F.substr(t, start + 1, end - start)).when(element != "", element).otherwise(t)


def context_window(text: Column, at: Column, before: bool = True, window: int = 400, scan: int = 2400) -> Column:
    """The paragraphs nearest a formula's slot, up to a number of characters, without slots and scraps."""
    t = _text(text)
    near = F.substr(t, F.greatest(F.lit(0), at - scan) + 1, F.least(at, F.lit(scan))) if before else F.substr(t, at + 1, F.lit(scan))
    flat = F.regexp_replace(F.regexp_replace(near, NOT_DECODED, "\n"), r"\n{3,}", "\n\n")
    kept = F.filter(F.transform(F.split(flat, r"\n\s*\n"), lambda p: strip(p)), lambda p: (p != "") & ((F.length(p) >= 8) | p.rlike("[A-Za-z]{3}")))
    order = F.reverse(kept) if before else kept
    start = F.struct(F.array().cast("array<string>").alias("took"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(s["n"] >= window, s).otherwise(F.struct(F.array_append(s["took"], p).alias("took"), (s["n"] + F.length(p) + 2).alias("n")))
    took = F.aggregate(order, start, step, lambda s: s["took"])
    return F.right(F.array_join(F.reverse(took), "\n\n"), F.lit(window)) if before else F.left(F.array_join(took, "\n\n"), F.lit(window))


def compatible(schema: Column, version: Column, schemas: dict[str, str]) -> Column:
    """Whether a known schema's version has the major number expected; no version counts as the expected one."""
    expected = F.create_map(*[F.lit(x) for pair in schemas.items() for x in pair])[schema]
    given = F.when(strip(_text(version)) == "", expected).otherwise(strip(_text(version)))
    return F.coalesce(F.split_part(given, F.lit("."), F.lit(1)) == F.split_part(expected, F.lit("."), F.lit(1)), F.lit(False))
