"""Pages, lines and blocks of Markdown documents: parsing, repair, merging. Input rows have doc_id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx


def _line():
    return Window.partitionBy("doc_id").orderBy("pos")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def typed_lines(docs: DataFrame) -> DataFrame:
    """Lines with the page they stand on (carried forward) and their kind; what stands between fences is formula."""
    rows = lines(docs)
    fence = F.sum((F.trim("line") == "$$").cast("int")).over(_line())
    kind = (
        F.when(F.trim("line") == "$$", "fence").when(F.col("_f") % 2 == 1, "formula").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"(?i)^\s*(?:PAGE\s+\d+|<!--\s*PAGE\s+\d+\s*-->)\s*$"), "page")
        .when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").rlike(r"^\|.*\|"), "table").when(F.col("line").rlike(tx.FIGURE_IMAGE), "figure").otherwise("text")
    )
    number = F.expr(r"if(kind = 'page', try_cast(regexp_extract(line, '(\\d+)', 1) as int), null)")
    return rows.withColumn("_f", fence).withColumn("kind", kind).withColumn("page", F.last(number, ignorenulls=True).over(_line())).select("doc_id", "pos", "line", "kind", "page")


def blocks(docs: DataFrame) -> DataFrame:
    """Runs of lines of one kind, in order: doc_id, ord, kind, page, content."""
    rows = typed_lines(docs).where("kind not in ('blank', 'fence', 'page')")
    new = (F.col("kind") != F.lag("kind").over(_line())) | (F.col("kind") == "heading") | (F.col("pos") != F.lag("pos").over(_line()) + 1)
    numbered = rows.withColumn("ord", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(_line()) - 1)
    return numbered.groupBy("doc_id", "ord").agg(
        F.first("kind").alias("kind"), F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content")
    )


def captions(docs: DataFrame, window: int = 6) -> DataFrame:
    """Each image line with the nearest caption line within ``window`` lines (ties to the earlier)."""
    rows = lines(docs)
    images = rows.where(F.col("line").rlike(r"^\s*!\[[^\]]*\]\([^)]+\)\s*$")).select("doc_id", F.col("pos").alias("image"))
    marks = rows.where(F.col("line").rlike(tx.FIGURE_CAPTION)).select(F.col("doc_id").alias("_d"), F.col("pos").alias("at"), F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("figure"))
    near = images.join(marks, (F.col("doc_id") == F.col("_d")) & (F.abs(F.col("image") - F.col("at")) <= window))
    return near.groupBy("doc_id", "image").agg(F.min(F.struct(F.abs(F.col("image") - F.col("at")).alias("d"), "at", "figure")).alias("m")).select("doc_id", "image", "m.at", "m.figure")


def caption_relations(found: DataFrame) -> DataFrame:
    """Figure or table blocks directly followed by a caption block: caption_of relations."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    nxt = found.withColumn("_t", F.lead("kind").over(w)).withColumn("_c", F.lead("content").over(w)).withColumn("target", F.lead("ord").over(w))
    return nxt.where(F.col("kind").isin("figure", "table") & (F.col("_t") == "text") & F.col("_c").rlike(tx.FIGURE_CAPTION)).select("doc_id", F.col("target").alias("source_ord"), F.col("ord").alias("target_ord"))


def table_issues(found: DataFrame) -> DataFrame:
    """Table blocks: rows, least and most columns, whether uneven or broken (under 2 rows or a spread of 2)."""
    t = found.where("kind = 'table'").withColumn("_n", F.transform(F.split("content", "\n"), lambda x: F.regexp_count(x, F.lit(r"\|"))))
    n, low, high = F.size("_n").cast("long"), F.array_min("_n"), F.array_max("_n")
    return t.select("doc_id", "ord", n.alias("rows"), (low != high).alias("uneven"), ((n < 2) | (high - low >= 2)).alias("broken"))


def merged(turns: DataFrame, key: str, order: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of a key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return turns.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("text"), F.count("*").alias("n"))


def batches(documents: DataFrame, pages: str, size: int) -> DataFrame:
    """Contiguous batches of at most ``size`` pages of 1..pages."""
    start = F.explode(F.sequence(F.lit(1), F.col(pages).cast("int"), F.lit(size))).alias("start_page")
    return documents.where(F.col(pages) >= 1).select("doc_id", pages, start).select("doc_id", "start_page", F.least(F.col("start_page") + size - 1, F.col(pages).cast("int")).alias("end_page"))


#: Rewrite rules in order; each is idempotent.
def rules() -> list[tuple[str, object]]:
    table, image = r"(\|[^\n]*\|[^\n]*)", r"(!\[[^\]]*\]\([^)\n]+\))"
    return [
        ("figure_table_gap", lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?m)^{table}\n(?={image[1:-1]}[ \t]*$)", "$1\n\n"), rf"(?m)^{image}\n(?=\|[^\n]*\|)", "$1\n\n")),
        ("display_math", lambda t: F.regexp_replace(t, r"(?s)\$\$\s*((?:(?!\$\$).)+?)\s*\$\$", "\\$\\$\n$1\n\\$\\$")),
        ("heading_gap", lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)([^\n])\n(#{1,6} )", "$1\n\n$2"), r"(?m)^(#{1,6} .+)\n([^\n#])", "$1\n\n$2")),
        ("blank_lines", lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")),
    ]


def rewritten(docs: DataFrame) -> DataFrame:
    """Text after all rules, which rules changed it, and whether a second pass leaves it alone."""
    out, marks = docs.withColumn("_0", F.col("text")), []
    for i, (name, rule) in enumerate(rules(), 1):
        out = out.withColumn(f"_{i}", rule(F.col(f"_{i - 1}")))
        marks.append(F.when(F.sha2(f"_{i}", 256) != F.sha2(f"_{i - 1}", 256), F.lit(name)))
    again = F.col(f"_{len(rules())}")
    for _, rule in rules():
        again = rule(again)
    last = F.col(f"_{len(rules())}")
    return out.select("doc_id", last.alias("text"), F.array_join(F.filter(F.array(*marks), lambda x: x.isNotNull()), ",").alias("changed_by"), (again == last).alias("idempotent"))
