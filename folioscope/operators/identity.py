"""Which number belongs to which formula, and audits of rankings and gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import evidence as ev
from folioscope.operators import recovery as rv
from folioscope.operators import sequential as sq

# Fixed values that results depend on.
LABEL = r"([A-Za-z]?\d+(?:\.\d+)?[A-Za-z]?|[A-Za-z]\.\d+|[Ss]\d+)"
MENTION = re.compile(rf"(?i:Eq(?:uation)?s?\.?\s*\(\s*{LABEL}\s*\)|公式\s*[（(]\s*{LABEL}\s*[）)])")
DEFINING = (
    r"defined\s+by", r"defined\s+as", "definition", r"calculated\s+(?:by|using|from|as)", r"computed\s+(?:by|using|from)", r"given\s+(?:by|in|as)", r"expressed\s+(?:by|as)", r"written\s+as",
    r"shown\s+(?:by|as|below)", r"as\s+follows", r"using\s+(?:the\s+)?(?:following\s+)?",
)
DEFINED, NEAR, SURE = 0.85, 0.93, 0.75


def _mentions_of(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), re.sub(r"\s+", "", m[1] or m[2])) for m in MENTION.finditer(text)]


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, label, kind: each mention of a numbered equation, and whether it defines or refers."""
    found = rv.spans(docs, _mentions_of, around=(80, 40))
    return found.select("doc_id", "start", "end", F.col("kind").alias("label"), ev.mention_class(F.col("before"), F.col("after"), DEFINING).alias("kind"))


def identities(slots: DataFrame, mentioned: DataFrame, printed: DataFrame, reach: int = 120, far: int = 1200, near: int = 200) -> DataFrame:
    """doc, start, label, score, source: one-to-one numbers of formula slots, where the evidence is sure.

    slots has doc, start; mentioned has doc, pos, end, label, kind; printed has doc, start, label, score. Defining mentions
    at most ``reach`` apart with no formula between them go to the slots that follow, one after the other; a single one
    counts less from ``near`` on and not at all beyond ``far``. References and mere order never suffice alone and are left
    out. Positions meet slots by counting along each document, not by an inequality join.
    """
    along = Window.partitionBy("doc").orderBy("start")
    numbered = slots.select("doc", "start").distinct().withColumn("i", F.row_number().over(along) - 1)
    defining = mentioned.where("kind = 'defining'").select("doc", "pos", "end", "label")
    event = lambda df, at, order, *more: df.select("doc", F.col(at).cast("long").alias("t"), F.lit(order).alias("o"), *more)
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("pos", "long"), ("end", "long"), ("label", "string"))]
    own = [F.col("pos").cast("long").alias("pos"), F.col("end").cast("long").alias("end"), "label"]
    line = event(numbered, "start", 1, *blank).unionByName(event(defining, "pos", 0, *own)).unionByName(event(defining, "end", 2, *own))
    line = line.withColumn("n", F.count_if(F.col("o") == 1).over(Window.partitionBy("doc").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)))
    counted = line.where("o <> 1").groupBy("doc", "pos", "end", "label").agg(F.max(F.when(F.col("o") == 0, F.col("n"))).alias("before"), F.max(F.when(F.col("o") == 2, F.col("n"))).alias("upto"))
    w, group = Window.partitionBy("doc").orderBy("pos"), Window.partitionBy("doc", "cluster")
    apart = (F.col("pos") - F.lag("pos").over(w) >= reach) | (F.col("before") > F.lag("upto").over(w))
    chained = counted.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("cluster", F.sum("_new").over(w))
    aimed = chained.select("doc", "end", "label", F.count("*").over(group).alias("size"), (F.max("upto").over(group) + F.row_number().over(group.orderBy("pos")) - 1).alias("i"))
    gap = F.col("start") - F.col("end")
    score = F.when((F.col("size") >= 2) | (gap < near), NEAR).when(gap <= far, DEFINED)
    said = aimed.join(numbered, ["doc", "i"]).select("doc", "start", "label", score.alias("score"), F.lit(1).alias("said"), F.col("end").alias("at"))
    seen = printed.select("doc", "start", "label", F.col("score").cast("double").alias("score"), F.lit(0).alias("said"), F.col("start").alias("at"))
    both = said.where("score is not null").unionByName(seen.join(numbered.select("doc", "start"), ["doc", "start"], "left_semi"))
    # printed labels are met before those of the text
    first = both.groupBy("doc", "label").agg(F.min(F.struct("said", "at")).alias("f")).withColumn("j", F.row_number().over(Window.partitionBy("doc").orderBy("f", "label")))
    best = both.groupBy("doc", "start", "label").agg(F.max(F.struct("score", "said")).alias("b"))
    pairs = best.join(first.select("doc", "label", "j"), ["doc", "label"]).join(numbered, ["doc", "start"]).select("doc", "start", "label", "i", "j", "b.*")
    kept = sq.assign(pairs, SURE).select("doc", "i", "j")
    return pairs.join(kept, ["doc", "i", "j"]).select("doc", "start", "label", F.round("score", 3).alias("score"), F.when(F.col("said") == 1, "prose_definition").otherwise("printed_label").alias("source"))


def ranking_errors(scored: DataFrame, late: int = 8, band: float = 0.08) -> DataFrame:
    """Per doc: mean scores of late accepted and early rejected attempts, the rejected of the late ones' tier, and whether the score could have told them apart.

    scored has doc, ord (from 1), score and accepted.
    """
    won, lost = F.col("accepted"), ~F.col("accepted")
    average = F.round(F.avg(F.when(won & (F.col("ord") >= late), F.col("score"))).over(Window.partitionBy("doc")), 4)
    tier = lost & (F.abs(F.col("score") - F.col("late_score")) < band)
    per = scored.withColumn("late_score", average).groupBy("doc").agg(
        F.first("late_score").alias("late_score"), F.round(F.avg(F.when(lost & F.col("ord").between(2, late), F.col("score"))), 4).alias("early_rejected"), F.count_if(tier).alias("same_tier"),
        F.round(F.avg(F.when(tier, F.col("score"))), 4).alias("same_tier_score"),
    )
    return per.withColumn("alike", F.coalesce((F.col("same_tier") > 0) & (F.abs(F.col("late_score") - F.col("same_tier_score")) < band), F.lit(False)))


def gate_audit(rows: DataFrame) -> DataFrame:
    """Per doc: attempts, wrongly rejected, safe ones among them and their seconds, conflicts, whether a narrower gate is advised.

    rows has doc, accepted, bucket (null: rightly treated), safe, status and seconds.
    """
    safe = F.col("safe")
    counts = rows.groupBy("doc").agg(
        F.count("*").alias("attempts"), F.count("bucket").alias("missed"), F.count_if(safe).alias("safe"), F.round(F.coalesce(F.sum(F.when(safe, F.col("seconds"))), F.lit(0.0)), 3).alias("safe_seconds"),
        F.count_if((F.col("status") == "conflict") & ~F.col("accepted")).alias("conflicts"), F.count_if(safe & (F.col("status") != "insufficient")).alias("_other"),
    )
    return counts.withColumn("advised", (F.col("safe") >= 2) & (F.col("_other") == 0)).drop("_other")


def audit_total(audits: DataFrame) -> DataFrame:
    """One row over all documents: scanned, with_safe, safe_total, advised."""
    total: Column = F.coalesce(F.sum("safe"), F.lit(0))
    return audits.agg(F.count("*").alias("scanned"), F.count_if(F.col("safe") > 0).alias("with_safe"), total.alias("safe_total"), ((total >= 2) & (F.count_if(F.col("safe") > 0) >= 1)).alias("advised"))
