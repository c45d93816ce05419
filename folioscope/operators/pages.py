"""Pages of transcripts between machine markers: split, rebuild, replace, number checks. Input rows have doc_id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions import transcript as tr


def split(docs: DataFrame) -> DataFrame:
    """doc_id, page, body and its counts: a row for each page number; of repeated ones the last counts."""
    bodies = F.arrays_zip(tr.page_numbers(F.col("text")).alias("page"), F.slice(F.split("text", tr.PAGE_MARK), 2, 1_000_000).alias("body"))
    rows = docs.select("doc_id", F.posexplode(bodies).alias("pos", "p")).select("doc_id", "pos", "p.page", tx.strip(F.regexp_replace("p.body", tr.PAGE_END, "")).alias("body"))
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("pos")))).where("_r = 1")
    return last.select(
        "doc_id", "page", "body", F.length("body").cast("long").alias("chars"), F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("n_lines"),
        F.floor(tx.count(F.col("body"), r"\$\$") / 2).alias("math_blocks"), tx.count(F.col("body"), tx.TABLE_ROW).alias("table_rows"), tx.count(F.col("body"), f"{tr.MARK}:FIGURE").alias("figures"),
    )


def rebuild(pages: DataFrame) -> DataFrame:
    """The inverse: pages in order, each under its marker."""
    piece = F.concat(F.lit(f"<!-- {tr.MARK}:PAGE:"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(" -->\n"), F.col("body"))
    parts = F.array_sort(F.collect_list(F.struct("page", piece.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def replace(pages: DataFrame, new: DataFrame) -> DataFrame:
    """pages with the bodies of new where it has them, and new's other pages added."""
    n = new.select("doc_id", "page", F.col("body").alias("_new"))
    return pages.select("doc_id", "page", "body").join(n, ["doc_id", "page"], "full").select("doc_id", "page", F.coalesce("_new", "body").alias("body"))


def figure_markers(docs: DataFrame) -> DataFrame:
    """Distinct figure markers of a document, by first occurrence."""
    keys = F.arrays_zip(F.regexp_extract_all("text", F.lit(tr.FIGURE_MARK), F.lit(1)).alias("p"), F.regexp_extract_all("text", F.lit(tr.FIGURE_MARK), F.lit(2)).alias("f"))
    return docs.select("doc_id", F.posexplode(F.array_distinct(keys)).alias("ord", "k")).select("doc_id", "ord", F.col("k.p").cast("int").alias("page"), F.col("k.f").cast("int").alias("figure"))


def page_errors(docs: DataFrame, first: int, last: int) -> DataFrame:
    """Per document: pages of first..last that are missing, too short for their kind (0.88 of the least passes) or too long."""
    found = split(docs)
    want = docs.select("doc_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("page"))
    rows = want.join(found, ["doc_id", "page"], "left")
    least = tx.least_chars(F.coalesce("body", F.lit("")))
    error = F.when(F.col("body").isNull(), "missing").when(F.col("chars") == 0, "empty").when(F.col("chars") < least * 0.88, "short").when(F.col("chars") > 28_000, "long")
    return rows.select("doc_id", "page", error.alias("error")).where("error is not null")


def best_transcript(candidates: DataFrame) -> DataFrame:
    """doc_id, source, text -> the usable candidate of highest rank (ties: source)."""
    ranked = candidates.withColumn("rank", tr.rank(F.col("text"))).where("rank >= 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank"), "source")
    return ranked.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("doc_id", "source", "rank")


def unique_page_markers(docs: DataFrame) -> DataFrame:
    """Later repeats of a page's marker line go; the rest stays in order."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    page = F.when(F.col("line").rlike(rf"^\s*{tr.PAGE_MARK}\s*$"), F.regexp_extract("line", tr.PAGE_MARK, 1))
    first = F.min("pos").over(Window.partitionBy("doc_id", page))
    kept = rows.withColumn("_first", first).withColumn("_page", page).where("_page is null or pos = _first")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
