"""Guarded rewriting: outside code only, projections that must not change, patches with gates, tables, phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.sequential import _per_text

CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]+`"
IDENT = r"\(([A-Za-z][A-Za-z0-9]*)\)"


def outside_code(text: Column, rewrite) -> Column:
    """rewrite applied to what stands between fenced blocks and inline code, which stay as they are."""
    parts = F.transform(F.split(text, CODE, -1), rewrite)
    return F.array_join(F.zip_with(parts, F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def _delimiters(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?ms)^([ \t]*)\\\[[ \t]*\n(.*?)\n\1\\\][ \t]*$", "$1\\$\\$\n$2\n$1\\$\\$")
    t = F.regexp_replace(t, r"(?m)^([ \t]*)\\\[([^\n]*?)\\\][ \t]*$", "$1\\$\\$\n$2\n$1\\$\\$")
    t = F.regexp_replace(t, r"(?<!\\)\\\[([^\n]*?)(?<!\\)\\\]", "\\$\\$$1\\$\\$")
    t = F.regexp_replace(t, r"(?<!\\)\\\(([^\n]*?)(?<!\\)\\\)", "\\$$1\\$")
    return F.regexp_replace(t, r"(?m)^([ \t]*)\$\$([^\n$]+?)\$\$[ \t]*$", "$1\\$\\$\n$2\n$1\\$\\$")


def math_delimiters(text: Column) -> Column:
    """Maths in brackets as maths in dollar signs; display maths on lines of its own. Idempotent."""
    return outside_code(text, _delimiters)


def delimiters_left(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, CODE, ""), F.lit(r"(?<!\\)\\[(\[]")).cast("long")


def projection(text: Column) -> Column:
    """The characters that no change of format may alter: without maths delimiters, rules and white space."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*\[[ \t]*\n(?s:(.*?))\n[ \t]*\][ \t]*(?:\n|$)", "$1")
    for pattern in (r"(?s)\\\[(.*?)\\\]", r"(?s)\\\((.*?)\\\)", r"(?s)\$\$\s*\n(.*?)\n\s*\$\$", r"\$\$([^\n$]+?)\$\$", r"(?<!\$)\$(?!\$)([^$\n]+?)\$(?!\$)"):
        t = F.regexp_replace(t, pattern, "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^---\s*$", ""), r"\s+", "")


def respelled(text: Column) -> Column:
    """All delimiters in dollar signs, names in brackets too, without white space; nothing is paired, every dollar sign stays."""
    t = F.regexp_replace(F.regexp_replace(text, r"\\[()]", "\\$"), r"\\[\[\]]", "\\$\\$")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", ""), IDENT, "\\$$1\\$")


def same_content(before: Column, after: Column) -> Column:
    """Equal projections, or equal but for brackets around a name, or equal but for how delimiters are spelled.

    The last holds where dollar signs that are no delimiters would pair with others, before and after differently.
    """
    a, b = projection(before), projection(after)
    return (a == b) | (F.regexp_replace(a, IDENT, "$1") == F.regexp_replace(b, IDENT, "$1")) | (respelled(before) == respelled(after))


def patch_gate(before: Column, after: Column) -> Column:
    """accepted, or the first reason against a patch: numbers, references, operators and content must stay."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    operators = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("[<>≤≥=≠∈∉+-]"), F.lit(0))))
    ref = r"(?i)Eq\.?\s*\(\d+\)"
    return (
        F.when((before == "") | (before == after), "noop").when(numbers(before) != numbers(after), "number_mismatch").when(before.rlike(ref) | after.rlike(ref), "equation_reference_protected")
        .when(operators(before) != operators(after), "operator_mismatch").when(projection(before) != projection(after), "integrity_fail").otherwise("accepted")
    )


def apply_patches(patches: DataFrame) -> DataFrame:
    """doc_id, ord, text, before, after -> the text after each document's patches in order, and how many were used.

    A patch is used once, at its first place, if the gate accepts it and its text still stands there.
    """
    gated = patches.withColumn("ok", patch_gate(F.col("before"), F.col("after")) == "accepted")
    todo = F.array_sort(F.collect_list(F.struct("ord", "before", "after", "ok")))
    per = gated.groupBy("doc_id", "text").agg(todo.alias("p"))

    def step(s, p):
        at = F.position(p["before"], s["text"])
        use = p["ok"] & (at > 0)
        new = F.concat(F.substring(s["text"], F.lit(1), at - 1), p["after"], F.substring(s["text"], at + F.length(p["before"]), F.length(s["text"])))
        return F.struct(F.when(use, new).otherwise(s["text"]).alias("text"), (s["used"] + F.when(use, 1).otherwise(0)).alias("used"))

    end = F.aggregate("p", F.struct(F.col("text"), F.lit(0).alias("used")), step)
    return per.select("doc_id", end["text"].alias("text"), end["used"].cast("long").alias("used"), (F.size("p") - end["used"]).cast("long").alias("rejected"))


def display_only(body: Column, longest: int = 48) -> Column:
    return (body == "") | body.contains("\n") | (F.length(body) > longest) | (F.regexp_count(body, F.lit(r"\\[A-Za-z]+")) > 5) | body.rlike(r"\\begin\{|\\\\")


def nesting(body: Column) -> Column:
    """Greatest depth of braces and brackets; closing below zero counts as zero."""
    step = lambda s, c: F.struct(F.greatest(F.lit(0), s["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("m"))
    marks = F.filter(F.split(body, ""), lambda c: c.isin("{", "[", "}", "]"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)["m"].cast("long")


def inline_score(left: Column, body: Column, right: Column, before: tuple[str, ...], after: tuple[str, ...], signals: tuple[str, ...]) -> Column:
    """How likely a display formula belongs in the line: short, simple, amid an unfinished sentence."""
    l, r = strip(left), strip(right)
    ends, starts, signal = F.lit(False), r.rlike("^[,;:]"), F.lit(False)
    for w in before:
        ends = ends | l.endswith(w)
    for w in after:
        starts = starts | r.startswith(w)
    for w in signals:
        signal = signal | l.endswith(w)
    part = lambda c, n: F.when(c, n).otherwise(0)
    return part(F.length(body) <= 48, 25) + part(F.regexp_count(body, F.lit(r"\\[A-Za-z]+")) <= 5, 15) + part(nesting(body) <= 2, 15) + part(ends & ~l.rlike("[.!?;]$"), 25) + part(starts, 25) - part(signal, 40)


def tables_of(text: str) -> str:
    """Tab-separated blocks as pipe tables, and the separator row that a table lacks; code stays."""
    rule, pipe = re.compile(r"\|(?:\s*:?-{2,}:?\s*\|)+\s*").fullmatch, re.compile(r"\s*\|.*\|\s*").fullmatch
    out, code, kind = [], False, None  # kind of the row before: None, "tab", "pipe"
    for row in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        code ^= row.startswith("```")
        here = None if code or row.startswith("```") else "tab" if "\t" in row else "pipe" if pipe(row) else None
        drawn = "| " + " | ".join(c.strip() for c in row.split("\t")) + " |" if here == "tab" else row
        head = here and (kind != here) and not rule(drawn)
        if out and isinstance(out[-1], tuple):
            out[-1] = out[-1][0]
            if here == kind and not rule(drawn):
                out.append("|" + " --- |" * max(1, out[-1].count("|") - 1))
        out.append((drawn,) if head else drawn)
        kind = here
    return "\n".join(x[0] if isinstance(x, tuple) else x for x in out)


def repair_tables(docs: DataFrame) -> DataFrame:
    return _per_text(docs, "text", tables_of, "text", "string")


def bold(docs: DataFrame, phrases: tuple[str, ...], most: int = 2) -> DataFrame:
    """Known phrases in bold: whole words, longest first, not in headings, code, links or bold already; at most ``most`` a document, once for short acronyms."""
    shield = re.compile(r"(?s)```.*?```|`[^`\n]+`|!?\[[^\]]*\]\([^)]*\)|\*\*.+?\*\*|(?m:^#{1,6} [^\n]*$)|\$\$.*?\$\$|\$[^$\n]+\$")
    finders = [(re.compile(rf"(?<!\w){re.escape(p)}(?!\w)"), 1 if p.isupper() and len(p) <= 6 else most) for p in sorted(phrases, key=lambda p: (-len(p), p))]

    def mark(text: str) -> str:
        for find, left in finders:
            out, at = [], 0
            for m in [*shield.finditer(text), None]:
                free = text[at : m.start() if m else len(text)]
                if left:
                    free, n = find.subn(lambda x: f"**{x[0]}**", free, count=left)
                    left -= n
                out += [free, m[0] if m else ""]
                at = m.end() if m else at
            text = "".join(out)
        return text

    return _per_text(docs, "text", mark, "text", "string")


def nearest_label(boxes: DataFrame, labels: DataFrame, reach: float = 12.0) -> DataFrame:
    """page, id, x1, y -> the label of the page within ``reach`` of y that is nearest to the right (ties: smaller label)."""
    l = labels.select("page", F.col("label"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = boxes.join(l, "page").where((F.abs(F.col("y") - F.col("_y")) <= reach) & (F.col("_x") >= F.col("x1")))
    return near.groupBy("page", "id").agg(F.min(F.struct((F.col("_x") - F.col("x1")).alias("d"), "label")).alias("m")).select("page", "id", "m.label", "m.d")


def dangling(references: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced paths that no file has."""
    return references.join(files, "path", "left_anti").select("doc_id", "path")


def first_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """One row a name, whatever its case or what stands in brackets after it: the first."""
    key = F.lower(F.regexp_replace(name, r"\[.*$", ""))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").select(name, order)


def running_headers(lines: DataFrame, band: float, least: int = 2) -> DataFrame:
    """Per document: the lowest edge of lines in the top band whose text recurs on other pages."""
    top = lines.where(F.col("y1") <= band)
    again = top.groupBy("doc", "text").agg(F.countDistinct("page").alias("pages"), F.max("y1").alias("y1")).where(F.col("pages") >= least)
    return again.groupBy("doc").agg(F.max("y1").alias("header_ymax"), F.count("*").alias("n"))
