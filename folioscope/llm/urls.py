"""URL filters: fixed host and path rules, and association rules mined from labelled pages. DataFrame functions only.

A page's transaction is the set of its URL's tokens (host labels, path words, query pairs, fragment; numbers become
one token) and, for a labelled page, its class. Tokens that stand in exactly the same labelled pages are one item, so
that pages made from one pattern don't multiply sets; items held by too few bad pages, and items whose pages are bad no
more often than all pages, are left out, as is, after it gave its rule, an item that every rule with it would only repeat
(all its pages are bad). FP-growth mines the sets of what is left in the bad pages. A set of at most ``longest`` items
gives the rule tokens -> bad, kept if its support (bad pages that hold it, of all labelled), confidence and lift reach
the thresholds and no rule with fewer of its items is as confident. Matching uses an inverted index: each rule is filed
under its rarest item, a page asks for the rules filed under the items of its own tokens and checks that it holds the rest.

Defined results: a null URL or one without "://" has an empty host and path, no token, and verdict allow; an empty host
or path fits as any other text does; URLs are read whole, however long; of fixed rules that fit, the longest wins (no two
of equal length fit one page); a page is bad if any of its labels is 0; pages without a label don't teach; repeated rows
teach and are judged each; no bad or no labelled page gives no mined rule; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def parsed(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """Distinct tokens of a URL."""
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    tail = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    mark = F.coalesce(F.regexp_extract(url, r"(?s)#(.*)$", 1), F.lit(""))
    named = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), plain(x)))
    return F.array_distinct(
        F.concat(named("host:", F.split(host, r"\.")), named("path:", F.split(path, r"[/._~-]+")), named("query:", F.split(tail, "&")), named("mark:", F.array(mark)))
    )


def fixed_rule(host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fixed rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def items(marked: DataFrame) -> DataFrame:
    """(token, item, n, bad): the item of each token (its least equal token), the labelled pages that hold it and the bad ones. marked: page, tokens, bad."""
    each = marked.select("page", "bad", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"), *[F.sum(F.xxhash64(F.lit(i), "page").cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    )
    same = held.groupBy("n", "bad", "s0", "s1").agg(F.min("token").alias("item"))
    return held.join(same, ["n", "bad", "s0", "s1"]).select("token", "item", "n", "bad")


def mine(marked: DataFrame, support: float = 0.005, confidence: float = 0.6, lift: float = 1.5, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """From marked (tokens, bad): rules (need: array of items, filed: the rarest of them, confidence) and the items' tokens (token, item)."""
    spark = marked.sparkSession
    none = spark.createDataFrame([], "need array<string>, filed string, confidence double")
    marked = stored(marked.withColumn("page", F.monotonically_increasing_id()))
    total = marked.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    if not bad:
        return none, spark.createDataFrame([], "token string, item string")
    least, needed = support * n, max(confidence, lift * bad / n)
    known = stored(items(marked).where((F.col("bad") >= least) & (F.col("bad") * n > F.col("n") * bad)))
    alone = known.select("item", "n", "bad").distinct()
    single = alone.where(F.col("bad") >= needed * F.col("n")).select(F.array("item").alias("whole"), (F.col("bad") / F.col("n")).alias("confidence"))
    open_ = known.where("bad < n and token = item").select("token", "item")
    own = marked.select("page", "bad", F.explode("tokens").alias("token")).join(open_, "token").groupBy("page", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"))
    own = stored(own)
    several = none.select(F.col("need").alias("whole"), "confidence")
    if not own.where("bad").isEmpty():
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / bad), minConfidence=0.0).fit(own.where("bad").select("items")).freqItemsets
        sets = stored(sets.where(F.size("items").between(2, longest) & (F.col("freq") >= least)).select(F.array_sort("items").alias("whole"), F.col("freq").alias("both")))
        # pages that hold a set: by its first item, the rest checked
        asked = own.select("items", F.explode("items").alias("first")).join(sets.withColumn("first", F.element_at("whole", 1)), "first")
        sizes = asked.where(F.forall("whole", lambda x: F.array_contains("items", x))).groupBy("whole", "both").agg(F.count("*").alias("size"))
        several = sizes.where(F.col("both") >= needed * F.col("size")).select("whole", (F.col("both") / F.col("size")).alias("confidence"))
    rules = stored(single.unionByName(several))
    # a rule falls to one with fewer of its items and no less confidence
    parts = rules.where("size(whole) > 1").select("whole", F.col("confidence").alias("c"), F.explode(_subsets("whole", longest)).alias("part"))
    falls = parts.join(rules.select(F.col("whole").alias("part"), "confidence"), "part").where("confidence >= c").select("whole").distinct()
    kept = rules.join(falls, "whole", "left_anti")
    rarest = kept.select("whole", "confidence", F.explode("whole").alias("item")).join(alone, "item").groupBy("whole", "confidence").agg(F.min(F.struct("n", "item"))["item"].alias("filed"))
    return stored(rarest.select(F.col("whole").alias("need"), "filed", "confidence")), known.select("token", "item")


def _subsets(column: str, longest: int) -> F.Column:
    """Proper non-empty subsets of a sorted array of at most `longest` items."""
    out = []
    for mask in range(1, (1 << longest) - 1):
        at = [i for i in range(longest) if mask >> i & 1]
        some = F.filter(F.array(*[F.try_element_at(F.col(column), F.lit(i + 1)) for i in at]), lambda x: x.isNotNull())
        out.append(F.when((F.size(some) < F.size(column)) & (F.size(some) == len(at)), some))
    return F.filter(F.array_distinct(F.array(*out)), lambda x: x.isNotNull())


def hits(pages: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct token sets of pages (column tokens) that a rule fits: one that has a token of each of its items."""
    held = pages.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(known, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    asked = held.select("tokens", "items", F.explode("items").alias("filed"))
    return asked.join(rules, "filed").where(F.forall("need", lambda x: F.array_contains("items", x))).select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; labels (doc_id, quality) marks pages by their id, 0 being bad."""
    host, path = parsed(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    own = own.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    rules, same = mine(own.join(known, "page_id").select("tokens", "bad"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    if rules.isEmpty():
        judged = own.withColumn("mined", F.lit(None).cast("boolean"))
    else:
        judged = own.join(hits(own, rules, same).withColumn("mined", F.lit(True)), "tokens", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))
