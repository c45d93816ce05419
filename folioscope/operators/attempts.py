"""Operators over attempt logs: curves, running state, budgets, costs, fingerprints, sessions.

Input rows have doc, ord, class, accepted, seconds, ts, page. Every window is partitioned by doc, so one exchange serves
an operator; nothing is collected but the one fold that is sequential by definition (the clipped moving average).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _doc():
    return Window.partitionBy("doc").orderBy("ord")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _n(flag) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)).cast("long")


def accept_curve(attempts: DataFrame) -> DataFrame:
    """Per document: attempts, accepted, first and last accepted attempt, normalised area under the cumulative curve."""
    curve = attempts.withColumn("cum", F.sum(_n("accepted")).over(_so_far()))
    return curve.groupBy("doc").agg(
        F.count("*").alias("n"), F.sum(_n("accepted")).alias("n_accepted"), F.min(F.expr("if(accepted, ord, null)")).alias("first_accept"),
        F.max(F.expr("if(accepted, ord, null)")).alias("last_accept"), F.expr("try_divide(sum(cum), count(*) * sum(cast(accepted as long)))").alias("auc"),
    )


def class_waste(attempts: DataFrame) -> DataFrame:
    """Per document and class: rejected attempts and the seconds they cost."""
    lost = attempts.where("not accepted")
    return lost.groupBy("doc", "class").agg(F.count("*").alias("calls"), F.sum("seconds").alias("wasted_seconds"))


def document_profile(attempts: DataFrame, cold_limit: float = 30.0) -> DataFrame:
    """Counts, rates, costs per accept and the profile label of each document.

    Label, first that holds: cold start over the limit, no attempt, healthy (0.85), one class with 40 % of the rejects
    (2 at least), low yield (under 0.35 of 6, or under 0.5 with 3 rejects), mixed. Ties between classes go to the
    class that occurs first.
    """
    per = attempts.groupBy("doc").agg(F.count("*").alias("attempted"), F.sum(_n("accepted")).alias("n_accepted"), F.sum("seconds").alias("total_seconds"), F.max(F.expr("if(ord = 1, seconds, null)")).alias("cold_seconds"))
    by_class = attempts.where("not accepted").groupBy("doc", "class").agg(F.count("*").alias("k"), F.min("ord").alias("first"))
    top = by_class.groupBy("doc").agg(F.max(F.struct(F.col("k"), (-F.col("first")).alias("early"), F.col("class"))).alias("top"))
    rejected = F.col("attempted") - F.col("n_accepted")
    rate = F.col("n_accepted") / F.col("attempted")
    dominated = F.col("top.k") >= F.when(rejected > 0, F.greatest(F.lit(2), F.floor(0.4 * rejected))).otherwise(2)
    label = (
        F.when(F.col("cold_seconds") >= cold_limit, "cold_start_affected")
        .when(F.col("attempted") <= 0, "no_recovery")
        .when((rate >= 0.85) & (F.col("n_accepted") >= 1), "healthy")
        .when(F.coalesce(dominated, F.lit(False)), F.concat(F.col("top.class"), F.lit("_dominated")))
        .when((rate < 0.35) & (F.col("attempted") >= 6), "low_yield")
        .when((rate < 0.5) & (rejected >= 3), "low_yield")
        .otherwise("mixed")
    )
    return per.join(top, "doc", "left").select(
        "doc", "attempted", "n_accepted", rejected.alias("rejected"), rate.alias("accept_rate"), F.expr("try_divide(total_seconds, n_accepted)").alias("seconds_per_accept"),
        F.expr("try_divide(attempted, n_accepted)").alias("calls_per_accept"), F.expr("if(total_seconds > 1e-6, n_accepted / total_seconds, null)").alias("efficiency"), label.alias("profile"),
    )


def trajectory(attempts: DataFrame, recent: int = 6) -> DataFrame:
    """Running state before each attempt: counts, streak of rejects, success on the same page, mean of the last outcomes (0.5 if none)."""
    won = F.coalesce(F.sum(_n("accepted")).over(_before()), F.lit(0))
    tried = F.col("ord") - 1
    last = F.max(F.expr("if(accepted, ord, null)")).over(_before())
    page = Window.partitionBy("doc", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.select(
        "doc", "ord", tried.cast("long").alias("tried"), won.alias("won"), (tried - F.coalesce(last, F.lit(0))).cast("long").alias("reject_streak"),
        F.coalesce(F.avg(_n("accepted")).over(_doc().rowsBetween(-recent, -1)), F.lit(0.5)).alias("recent_rate"), F.avg(_n("accepted")).over(page).alias("page_rate"),
    )


def clipped_average(attempts: DataFrame, start: float = 2.65, alpha: float = 0.3, clip: float = 3.0) -> DataFrame:
    """Exponential moving average of the accepted attempts' seconds per document, each clipped to ``clip`` times the average so far."""
    rows = attempts.where("accepted").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "seconds"))).alias("x"))
    step = lambda s, x: F.lit(alpha) * F.least(x["seconds"], F.lit(clip) * s) + F.lit(1 - alpha) * s
    return rows.select("doc", F.size("x").cast("long").alias("samples"), F.aggregate("x", F.lit(start), step).alias("average"))


def observed_average(rows: DataFrame, key: str, counts, start: float, alpha: float = 0.3, clip: float = 3.0) -> DataFrame:
    """Per key the moving average of the seconds that count, in order, each clipped to ``clip`` times the average so far. rows: key, ord, seconds.

    Clipping makes each step depend on the one before, so a key's counted observations (16 bytes each) meet in one task.
    """
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(counts, F.struct("ord", F.greatest(F.lit(0.0), "seconds").alias("seconds"))))).alias("x"))

    def step(s, x):
        seen = F.when(s > 0, F.least(x["seconds"], F.lit(clip) * s)).otherwise(x["seconds"]) if clip > 0 else x["seconds"]
        return F.lit(alpha) * seen + F.lit(1 - alpha) * s

    return held.select(key, F.size("x").cast("long").alias("samples"), F.aggregate("x", F.lit(start), step).alias("average"))


def moving_average(rows: DataFrame, key: str, start: float = 0.0, alpha: float = 0.3) -> DataFrame:
    """Per key the moving average of values in order, as a weighted sum: combined before the shuffle but for the rank. rows: key, ord, value."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord"))) - 1
    weighed = rows.select(key, (F.lit(alpha) * F.pow(F.lit(1 - alpha), back) * F.col("value")).alias("part"))
    return weighed.groupBy(key).agg(F.count("*").alias("samples"), (F.sum("part") + F.lit(start) * F.pow(F.lit(1 - alpha), F.count("*"))).alias("average"))


def sessions(attempts: DataFrame, gap: int = 7200) -> DataFrame:
    """Session number, start, end and size: a session ends where the next attempt is more than ``gap`` seconds later."""
    late = F.expr(f"timestampdiff(MICROSECOND, lag(ts) over (partition by doc order by ord), ts) > {gap} * 1000000L")
    numbered = attempts.withColumn("_cut", _n(late)).withColumn("session", F.sum("_cut").over(_so_far()))
    return numbered.groupBy("doc", "session").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n"))


def latest_session(attempts: DataFrame, gap: int = 7200) -> DataFrame:
    """The last session of each document."""
    found = sessions(attempts, gap)
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("session")))).where("_r = 1").drop("_r")


def page_islands(attempts: DataFrame) -> DataFrame:
    """Maximal runs of consecutive pages that a document's attempts touch."""
    pages = attempts.where("page is not null").select("doc", "page").distinct()
    keyed = pages.withColumn("_k", F.col("page") - F.row_number().over(Window.partitionBy("doc").orderBy("page")))
    return keyed.groupBy("doc", "_k").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("_k")


def missing_pages(attempts: DataFrame) -> DataFrame:
    """Per document: page numbers between the least and the greatest that no attempt touches."""
    pages = attempts.where("page is not null").groupBy("doc").agg(F.collect_set("page").alias("p"))
    return pages.select("doc", F.size(F.expr("array_except(sequence(array_min(p), array_max(p)), p)")).cast("long").alias("n_missing"))


def budget_replay(attempts: DataFrame, budgets: tuple[int, ...] = (4, 6, 8, 10)) -> DataFrame:
    """What a budget of the first k attempts would have kept: recall of accepts, calls and seconds saved."""
    ks = F.explode(F.array(*[F.lit(k) for k in budgets])).alias("k")
    per = attempts.select("doc", "ord", "accepted", "seconds", ks)
    return per.groupBy("doc", "k").agg(
        F.expr("try_divide(sum(if(ord <= k and accepted, 1, 0)), sum(if(accepted, 1, 0)))").alias("recall"),
        F.sum(F.expr("if(ord > k, 1, 0)")).alias("calls_saved"), F.sum(F.expr("if(ord > k, seconds, 0D)")).alias("seconds_saved"),
    )


def running_budget(attempts: DataFrame, calls: int = 10, soft: float = 90.0, hard: float = 300.0) -> DataFrame:
    """Spent so far before each attempt, and the limit that would stop it: hard, soft, calls or none."""
    spent = F.coalesce(F.sum("seconds").over(_before()), F.lit(0.0))
    stop = F.when(spent + F.col("seconds") > hard, "hard").when(spent + F.col("seconds") > soft, "soft").when(F.col("ord") > calls, "calls").otherwise("none")
    return attempts.select("doc", "ord", spent.alias("spent"), stop.alias("stopped_by"))


def breaker(attempts: DataFrame, fatal: str = "error") -> DataFrame:
    """Sticky state: an attempt is blocked once a fatal class was seen before it; and the greatest cost so far."""
    hit = F.coalesce(F.max(F.col("class") == fatal).over(_before()), F.lit(False))
    return attempts.select("doc", "ord", hit.alias("blocked"), F.max("seconds").over(_so_far()).alias("most_so_far"))


def fingerprints(attempts: DataFrame) -> DataFrame:
    """Failures by fingerprint: sha256 over the normalised parts, with occurrences, first and last seen, documents, cost."""
    parts = F.concat_ws("|", F.lower("class"), F.coalesce(F.col("page").cast("string"), F.lit("")))
    failed = attempts.where("not accepted").withColumn("fingerprint", F.sha2(parts, 256))
    return failed.groupBy("fingerprint").agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct("doc").alias("documents"), F.sum("seconds").alias("total_seconds")
    )


def cost_audit(attempts: DataFrame) -> DataFrame:
    """Per class: calls, seconds, share of all waste, and what its size suggests (0.35 / 0.25 / 0.15)."""
    per = attempts.where("not accepted").groupBy("class").agg(F.count("*").alias("calls"), F.sum("seconds").alias("wasted"))
    share = F.col("wasted") / F.sum("wasted").over(Window.partitionBy())
    advice = F.when(share >= 0.35, "fix_first").when(share >= 0.25, "investigate").when(share >= 0.15, "watch").otherwise("ignore")
    return per.select("class", "calls", "wasted", share.alias("share"), advice.alias("advice"))


def fastest_accept(attempts: DataFrame) -> DataFrame:
    """Accept rate by page and the attempt that was accepted fastest there (ties to the smaller id)."""
    return attempts.groupBy("page").agg(F.avg(_n("accepted")).alias("accept_rate"), F.min(F.expr("if(accepted, struct(seconds, event_id), null)"))["event_id"].alias("fastest"))


def first_by_key(attempts: DataFrame) -> DataFrame:
    """The first attempt of each (doc, class, page); later repeats go."""
    w = Window.partitionBy("doc", "class", "page").orderBy("ord")
    return attempts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc", "class", "page", "ord")


def pending(attempts: DataFrame) -> DataFrame:
    """Pages of a document that no attempt was accepted on."""
    done = attempts.where("accepted").select("doc", "page").distinct()
    return attempts.where("page is not null").select("doc", "page").distinct().join(done, ["doc", "page"], "left_anti")


def rank_moves(attempts: DataFrame) -> DataFrame:
    """Static rank by seconds (longest first) against execution order: how far each attempt would move."""
    new = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("seconds"), "ord"))
    return attempts.select("doc", "ord", new.alias("new_rank"), (F.col("ord") - new).alias("move"))


def collapse_repeats(attempts: DataFrame) -> DataFrame:
    """Drop an attempt equal in class and page to the one before it; renumber the rest from 0."""
    same = F.col("class").eqNullSafe(F.lag("class").over(_doc())) & F.col("page").eqNullSafe(F.lag("page").over(_doc())) & (F.col("ord") > 1)
    kept = attempts.withColumn("_same", same).where("not _same")
    return kept.select("doc", "ord", (F.row_number().over(_doc()) - 1).alias("new_ord"))


def neighbours(attempts: DataFrame) -> DataFrame:
    """Class before and after each attempt, and whether an accept follows a reject at once."""
    return attempts.select("doc", "ord", F.lag("class").over(_doc()).alias("before"), F.lead("class").over(_doc()).alias("after"), (F.col("accepted") & ~F.lag("accepted").over(_doc())).alias("recovered"))


def order_conflicts(attempts: DataFrame, least: int = 2) -> DataFrame:
    """Documents whose page numbers, in order, ever fall: all their attempts are in conflict."""
    fall = attempts.where("page is not null").withColumn("_fall", _n(F.col("page") < F.lag("page").over(_doc())))
    return fall.groupBy("doc").agg(F.count("*").alias("n"), F.sum("_fall").alias("falls")).where(F.col("n") >= least).select("doc", "falls", (F.col("falls") > 0).alias("conflict"))


def retry_ladder(attempts: DataFrame) -> DataFrame:
    """Status of retry exhaustion per document: 8 attempts without accept fail, 4 warn."""
    per = attempts.groupBy("doc").agg(F.count("*").alias("tried"), F.sum(_n("accepted")).alias("won"))
    return per.select("doc", F.expr("CASE WHEN tried >= 8 AND won = 0 THEN 'fail' WHEN tried >= 4 AND won = 0 THEN 'warn' ELSE 'pass' END").alias("status"))
