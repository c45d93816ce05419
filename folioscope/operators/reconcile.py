"""Reconciling two sides: lookups in tiers, conflicts, merges that keep verified values, batches and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import containment


def tiered_lookup(rows: DataFrame, outcomes: DataFrame, least: int = 24) -> DataFrame:
    """rows (doc, id, raw) -> outcome by id, else by equal text, else by a text of the document that holds raw (or is held by it).

    The third tier compares only rows that the first two left, within their document, and only texts of ``least``
    characters or more; pairs come from anchors (``containment``), each is then compared. Ties: the smaller outcome id.
    """
    by_text = outcomes.groupBy("doc", "text").agg(F.min(F.struct("oid", "outcome")).alias("t")).select("doc", F.col("text").alias("raw"), "t", F.col("t.outcome").alias("o2"))
    known = rows.join(outcomes.select("doc", F.col("oid").alias("id"), F.col("outcome").alias("o1")), ["doc", "id"], "left").join(by_text.drop("t"), ["doc", "raw"], "left")
    left = known.where("o1 is null and o2 is null").where(F.length("raw") >= least).select("doc", "id", "raw")
    o = by_text.where(F.length("raw") >= least).select("doc", F.col("raw").alias("text"), "t")
    names = lambda t, text, h: t.withColumn("d", F.xxhash64("doc")).withColumn(h, F.xxhash64(text))
    near = containment.pairs(left.select("doc", F.col("raw").alias("text")), o.select("doc", "text"), least)
    met = names(left, "raw", "a").join(near, ["d", "a"]).join(names(o, "text", "b").withColumnRenamed("doc", "_doc"), ["d", "b"])
    held = F.col("text").contains(F.col("raw")) | F.col("raw").contains(F.col("text"))
    third = met.where((F.col("doc") == F.col("_doc")) & held).groupBy("doc", "id").agg(F.min("t")["outcome"].alias("o3"))
    out = known.join(third, ["doc", "id"], "left")
    tier = F.when(F.col("o1").isNotNull(), 1).when(F.col("o2").isNotNull(), 2).when(F.col("o3").isNotNull(), 3)
    return out.select("doc", "id", F.coalesce("o1", "o2", "o3").alias("outcome"), tier.alias("tier"))


def counts_after(looked_up: DataFrame) -> DataFrame:
    """Per document: rows, recovered, failed and unknown after the lookup."""
    n = lambda e: F.sum(F.expr(f"if({e}, 1, 0)"))
    return looked_up.groupBy("doc").agg(F.count("*").alias("n"), n("outcome = 'ok'").alias("recovered"), n("outcome is not null and outcome <> 'ok'").alias("failed"), n("outcome is null").alias("unknown"))


def anchor_lookup(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """asked (qid, number, page) -> the anchor of that number: same page, then margin, then page, y, right to left."""
    # the first anchor of a number and page, and of a number, by the same order: two joins of one row a key
    rank = F.struct((~F.col("margin")).cast("int").alias("m"), "page", "y", (-F.col("x")).alias("x"), "aid")
    here = anchors.groupBy("number", "page").agg(F.min(rank)["aid"].alias("near"))
    any_ = anchors.groupBy("number").agg(F.min(rank)["aid"].alias("first"))
    found = asked.join(here, ["number", "page"], "left").join(any_, "number")
    return found.select("qid", F.coalesce("near", "first").alias("aid"))


def alignment_conflicts(items: DataFrame, margin: float = 0.06) -> DataFrame:
    """Items of a page with one signature: only a best score that leads by more than the margin stays; the others are blocked."""
    w = Window.partitionBy("page", "sig")
    near = F.sum((F.col("score") >= F.col("_best") - margin).cast("int")).over(w)
    scored = items.withColumn("_n", F.count("*").over(w)).withColumn("_best", F.max("score").over(w)).withColumn("_near", near)
    return scored.where("_n > 1").select("id", ((F.col("_near") > 1) | (F.col("score") < F.col("_best"))).alias("blocked"))


def keep_verified(new: DataFrame, old: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """new, with old's columns where old is verified."""
    o = old.select(key, F.col("verified").alias("_v"), *[F.col(c).alias(f"_{c}") for c in columns])
    keep = F.coalesce("_v", F.lit(False))
    return new.join(o, key, "left").select(key, *[F.when(keep, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], keep.alias("verified"))


def keep_filled(new: DataFrame, old: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """new, with old's value where new has none ("" counts as none); null if neither has one and new's is null."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return new.join(o, key, "left").select(key, *[F.when(none(c) & ~none(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def review_queue(parts: list[DataFrame], rejected: DataFrame, key: str) -> DataFrame:
    """Rows of several sources, the first source of a key counting (ties: the least row as JSON), without the rejected ones."""
    rows = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("source_rank", F.lit(i))
        rows = tagged if rows is None else rows.unionByName(tagged)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("source_rank", F.to_json(F.struct(*rows.columns))))).where("_r = 1").drop("_r")
    return first.join(rejected.select(key), key, "left_anti")


def reviewed(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """rows with the actions of reviews (verify with text, reject) applied; an unknown action stops the job."""
    r = reviews.select(key, "action", F.col("text").alias("_text"))
    status = F.when(F.col("action").isNull(), F.col("status")).when(F.col("action") == "verify", "verified").when(F.col("action") == "reject", "rejected").otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.col("action"))))
    return rows.join(r, key, "left").select(key, status.alias("status"), F.when(F.col("action") == "verify", F.col("_text")).otherwise(F.col("text")).alias("text"))


def batch_state(batches: DataFrame) -> DataFrame:
    """Per run: whether all batches are accepted, the first that isn't, and how many would be reset."""
    open_ = F.col("status") != "accepted"
    return batches.groupBy("run").agg(F.bool_and(~open_).alias("complete"), F.min(F.when(open_, F.col("id"))).alias("next_id"), F.sum(F.when(open_, 1).otherwise(0)).alias("to_reset"))


def split_for_retry(batches: DataFrame, half: int = 5) -> DataFrame:
    """Smaller batches for another try: of ten pages two of five, of five or fewer single pages."""
    size = F.col("end_page") - F.col("start_page") + 1
    step = F.when(size > half, half).otherwise(1)
    first = F.explode(F.sequence("start_page", "end_page", step))
    return batches.select("run", "id", "end_page", step.alias("_s"), first.alias("start_page")).select("run", "id", "start_page", F.least(F.col("start_page") + F.col("_s") - 1, F.col("end_page")).alias("end_page"))


def offsets(batches: DataFrame, size: Column) -> DataFrame:
    """Where each batch of a run begins when all are put one after the other."""
    w = Window.partitionBy("run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return batches.select("run", "id", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("offset"))


def fidelity(batches: DataFrame, final_chars: DataFrame) -> DataFrame:
    """Per run: characters of accepted batches, of the final text, and their ratio."""
    source = batches.groupBy("run").agg(F.sum(F.expr("if(status = 'accepted', chars, 0)")).alias("source_chars"))
    return source.join(final_chars, "run", "left").select("run", "source_chars", "final_chars", F.expr("try_divide(final_chars, source_chars)").alias("ratio"))


def seconds_summary(runs: DataFrame) -> DataFrame:
    """One row: cold seconds (reported, else loading), steady seconds (reported, else total less cold)."""
    cold = F.coalesce("cold", "loading", F.lit(0.0))
    return runs.agg(F.sum(cold).alias("cold"), F.sum(F.coalesce("steady", F.greatest(F.lit(0.0), F.col("total") - cold))).alias("steady"), F.count("*").alias("runs"))


def recognised(rows: DataFrame) -> DataFrame:
    """doc, total, attempted, succeeded -> formulas that are fine: those never touched and those recovered, at most all."""
    return rows.select("doc", F.least("total", F.greatest(F.lit(0), F.col("total") - F.col("attempted")) + F.col("succeeded")).alias("recognised"))


def marker_runs(lines: DataFrame, pattern: str) -> DataFrame:
    """Runs of two or more marker lines of a document with nothing but blank lines between."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.where(F.trim("line") != "").withColumn("_m", F.col("line").rlike(pattern)).withColumn("_n", F.row_number().over(w))
    marks = rows.where("_m").withColumn("_k", F.col("_n") - F.row_number().over(w))
    return marks.groupBy("doc_id", "_k").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).where("n >= 2").drop("_k")


def without_repeats(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines without marker lines that follow another marker line, blank ones aside."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    mark, blank = F.col("line").rlike(pattern), F.trim("line") == ""
    before = F.last(F.when(~blank, mark), ignorenulls=True).over(w)
    return lines.withColumn("_drop", mark & F.coalesce(before, F.lit(False))).where("not _drop").drop("_drop")
