"""Fences and amounts, a transcript's completeness, a formula's risk and regression gates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import transcript as tr
from folioscope.functions.forms import compiles
from folioscope.functions.text import page_type, strip

# Fixed values.
DOLLAR = r"(?<!\\)\$"
AMOUNT = r"^\d[\d.,]*(?:\s|[.,;:!?)\]-])"
WHOLE_AMOUNT = r"^\d[\d.,]*$"
DISPLAY_ODD = "行间公式 $$ 围栏不成对"
INLINE_ODD = "行内公式 $ 围栏可能不成对"
HIGH_RISK_PAGES = ("empty", "text_short")
PAGES_TO_FORMAT = ("text_short", "image", "image_text", "title", "screenshot", "table")
AGREED = ("ACCEPT", "ACCEPT_VISUAL")


def _line_without_amounts(line: Column) -> Column:
    """A line without the dollar signs of amounts; one that may open a formula closed later in the line stays."""

    def signs(p: Column) -> Column:
        last = F.size(p) - 2  # the sign after which the line's last piece stands
        after = lambda i: F.get(p, i + 1)
        amount = lambda i: after(i).rlike(AMOUNT) | ((i == last) & after(i).rlike(WHOLE_AMOUNT)) | ((i == 0) & F.get(p, i).rlike(r"\p{Nd}$"))
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: amount(i))

    def dropped(s: Column) -> Column:
        amounts, formulas = F.array_position(s, True), F.filter(s, lambda a: ~a)
        # of an odd number of other signs, one needs a partner: the first amount, if another sign follows it
        opener = F.when((F.size(formulas) % 2 == 1) & F.exists(F.slice(s, F.greatest(F.lit(1), amounts.cast("int")), F.size(s)), lambda a: ~a), amounts - 1).otherwise(F.lit(-1))
        return F.transform(s, lambda a, i: a & (i != opener))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["p"], lambda t, i: F.when(i == 0, t).when(F.get(x["d"], i - 1), t).otherwise(F.concat(F.lit("$"), t))), "")

    pieces = F.transform(F.array(F.split(line, DOLLAR, -1)), lambda p: F.struct(p.alias("p"), signs(p).alias("s")))
    both = F.transform(pieces, lambda x: F.struct(x["p"].alias("p"), dropped(x["s"]).alias("d")))
    return F.when(line.contains("$"), F.element_at(F.transform(both, joined), 1)).otherwise(line)


def without_amounts(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _line_without_amounts), "\n")


def fence_errors(text: Column) -> Column:
    """Messages for display and for inline fences without a partner, amounts of money aside."""
    t = without_amounts(text)
    display = F.regexp_count(t, F.lit(r"\$\$")) % 2 == 1
    inline = F.regexp_count(F.regexp_replace(t, r"\$\$", ""), F.lit(DOLLAR)) % 2 == 1
    return F.filter(F.array(F.when(display, DISPLAY_ODD), F.when(inline, INLINE_ODD)), lambda x: x.isNotNull())


def looks_truncated(text: Column) -> Column:
    """Whether a transcript whose pages are not known seems cut off: too short for its markers, or long without structure."""
    t = strip(F.coalesce(text, F.lit("")))
    n, pages, flat = F.length(t), F.size(F.array_distinct(tr.page_numbers(t))), tr.lacks_structure(t)
    whole = (pages > 0) & (n >= F.when(pages == 1, 400).otherwise(pages * 1200)) & ((pages == 1) | ~flat)
    listed = tr.references_heavy(t) & (n >= 2500)
    return (t == "") | (~whole & ~listed & ((n < 600) | (flat & (n < 3500))))


def risk(place: Column, formula: Column, consensus: Column, required: Column) -> dict[str, Column]:
    """Risk, decision and reasons of writing a formula; place: reasons against its box, consensus: a second model's decision, null if none."""
    syntax = compiles(formula)
    agreed = F.coalesce(consensus.isin(*AGREED), F.lit(False))
    against = F.coalesce(consensus == "DISAGREE", F.lit(False))
    sound, low = (place == "") & syntax, agreed | (consensus.isNull() & ~required)
    level = F.when(sound & low, "low").when(sound & ~against, "medium").otherwise("high")
    why = F.concat_ws(
        ",", F.when(place != "", place), F.when(~syntax, "syntax_or_compile_fail,render_untrusted"), F.when(required & ~agreed, "no_dual_consensus"), F.when(sound & ~low & against, "consensus_disagree")
    )
    none = F.when(level == "low", "all_layers_ok").otherwise("single_model_no_peer")
    return {"risk": level, "decision": F.when((level == "low") | ((level == "medium") & ~required), "accept").otherwise("abstain"), "reasons": F.when(why == "", none).otherwise(why)}


def regression_gate(document: Column, accepted: Column, rejected: Column, stem: str, expected: tuple[int, int]) -> dict[str, Column]:
    """Whether the gate of one hard document applies, and whether its counts are those expected; others pass."""
    own = F.coalesce(document.contains(stem), F.lit(False))
    return {"applicable": own, "passed": ~own | F.coalesce((accepted == expected[0]) & (rejected == expected[1]), F.lit(False))}


def display_number(width: Column, x0: Column, x1: Column) -> Column:
    """Whether a number stands where equations are numbered: narrow, at the right edge of the page or of its left column."""
    middle = width / 2
    narrow = F.greatest(F.lit(1.0), x1 - x0) <= width * 0.12
    return narrow & F.when(x0 >= middle - 12, x0 >= width * 0.7).otherwise(x1 >= middle - width * 0.04)


def stable(value: Column) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def page_analysis(text: Column) -> dict[str, Column]:
    """A page's type and length, whether its form needs mending and how likely it is wrong."""
    t = F.coalesce(text, F.lit(""))
    kind = page_type(t)
    return {"page_type": kind, "chars": F.length(strip(t)), "risk": F.when(kind.isin(*HIGH_RISK_PAGES), "high").otherwise("low"), "need_format_fix": kind.isin(*PAGES_TO_FORMAT) | ((t != "") & tr.lacks_structure(t))}
