"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts. Sources in code-point order (null last) weigh 3, 1, 2, repeating; they share ``ratio`` times all
words, no source more than ``most`` times its own, the excess going to the others by weight. A source takes every
document as many whole times as its target holds its size; for the rest of its target, documents are counted by exact
length, each length gives its proportional share, and a bounded-knapsack program over the lengths' remaining counts
fills what is left to the word where lengths allow. Which documents of a length are taken is decided by a seeded hash.

Only the counts by length reach one task a source; documents stay distributed. Of a length the documents of smallest
hash (of seed, doc_id and text, as an unsigned number) are taken: the hash at which to stop is found from ranges of
hashes, their number in proportion to the length's documents, so no task ranks a hot length alone, and texts travel only
to meet the plan, a row a source and length. Defined results: null text has size 0; a null source is a source of its
own, last; documents of size 0 are taken 0 words; a source of size 0 has target 0; rows of one doc_id and text are
interchangeable and counted each; texts are read whole; columns of docs named like the new ones are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
#: Words of the remaining budget that the knapsack program spans.
SPAN = 1 << 16
#: Documents of a range, on average, where a length's documents are ranked by ranges of their hash.
RANGE_ROWS = 256


def _sized(docs: DataFrame, seed: int) -> list[F.Column]:
    """source, size and k, the hash by which documents are taken: in the signed order of k, the unsigned order of the hash."""
    key = F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), docs["text"]).bitwiseXOR(F.lit(-(1 << 63)))
    return [docs["source"].cast("string").alias("source"), F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("k")]


def targets(sized: DataFrame, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row a source; windows over sources only."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(w) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("reach", F.col("cap") / F.col("weight"))
    by = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * ratio - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source, by reach, that its share doesn't fill sets the level of all above it
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", F.col("source").isNull().alias("last"), "source", "level"))).over(Window.partitionBy())["level"]
    return per.withColumn("share", level).select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce("share", F.col("cap") / F.col("weight"))).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come as near to budget, from below, as can be found.

    Shares in proportion first; then, longest first, whole documents while more than SPAN is left; then the knapsack
    program (each length's spare count split into powers of two) for what remains. Exact for the remainder it is given.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(n) * budget // total for n in counts.tolist()], np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = budget - int((lengths * take).sum())
    for i in order.tolist():
        if left <= SPAN:
            break
        more = min(int(counts[i] - take[i]), (left - SPAN // 2) // int(lengths[i])) if lengths[i] else 0
        take[i] += max(0, more)
        left -= max(0, more) * int(lengths[i])
    if left > SPAN:  # only documents longer than SPAN are spare: take them whole, longest first, while they fit
        for i in order.tolist():
            more = min(int(counts[i] - take[i]), left // int(lengths[i])) if lengths[i] else 0
            take[i] += more
            left -= more * int(lengths[i])
        if left > SPAN:
            return take
    for i in order[::-1].tolist():  # give some documents back, shortest first, so that the program has more to choose from
        back = min(int(take[i]), (SPAN // 2 - left) // int(lengths[i])) if lengths[i] else 0
        if back > 0:
            take[i] -= back
            left += back * int(lengths[i])
    reached = np.full(left + 1, -1, np.int64)  # the item by which a sum was first reached
    reached[0] = -2
    items: list[tuple[int, int]] = []
    for i in order.tolist():
        spare, length, power = int(counts[i] - take[i]), int(lengths[i]), 1
        while spare > 0 and length and length <= left and reached[left] == -1:
            use = min(power, spare)
            step = use * length
            if step <= left:
                new = np.flatnonzero((reached[:-step] != -1) & (reached[step:] == -1)) + step
                reached[new] = len(items)
                items.append((i, use))
            spare -= use
            power *= 2
    at = int(np.flatnonzero(reached != -1).max())
    while at > 0:
        i, use = items[int(reached[at])]
        take[i] += use
        at -= use * int(lengths[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    whole, rest = divmod(int(np.floor(pdf["target"].iloc[0] + 0.5)), max(1, int(pdf["source_size"].iloc[0])))
    if whole >= 2:
        whole, rest = 2, 0
    chosen = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "whole": whole, "chosen": chosen, "source_size": pdf["source_size"], "target": pdf["target"]})


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, cut, left, ties): the hash of the last document to take of a length that is taken in part, how many of that hash to take, and of how many."""
    some = plan.where("chosen > 0 and chosen < n").select("source", "size", "n", "chosen")
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n") / RANGE_ROWS)))).cast("int").alias("bits")
    rows = sized.alias("d").join(some.select("*", bits).alias("p"), _same("d", "p") & (F.col("d.size") == F.col("p.size"))).select("p.*", "d.k")
    rows = rows.withColumn("r", F.expr("if(bits = 0, 0L, shiftrightunsigned(k ^ (-9223372036854775807L - 1), 64 - bits))"))
    by = ["source", "size", "chosen", "r"]
    ranges = rows.groupBy(*by).agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("source", "size").orderBy("r")))
    last = ranges.where("upto >= chosen and upto - m < chosen").select("source", "size", "r", (F.col("chosen") - F.col("upto") + F.col("m")).alias("need"))
    inside = rows.alias("d").join(last.alias("p"), _same("d", "p") & (F.col("d.size") == F.col("p.size")) & (F.col("d.r") == F.col("p.r"))).groupBy("p.source", "p.size", "p.need", "d.k").agg(F.count("*").alias("ties"))
    inside = inside.withColumn("upto", F.sum("ties").over(Window.partitionBy("source", "size").orderBy("k")))
    return inside.where("upto >= need and upto - ties < need").select("source", "size", F.col("k").alias("cut"), (F.col("need") - F.col("upto") + F.col("ties")).alias("left"), "ties")


def _same(a: str, b: str) -> F.Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mix(docs: DataFrame, seed: int = 20_260, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with size, source_size, target and taken (words, repeats counted) of each row."""
    sized = stored(docs.select(*_sized(docs, seed)))
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = targets(sized, ratio, most)
    lengths = lengths.alias("l").join(goal.alias("g"), _same("l", "g")).select("l.*", "g.source_size", "g.target")
    plan = stored(lengths.groupBy("source").applyInPandas(_plan, "source string, size long, n long, whole int, chosen long, source_size long, target double"))
    cuts = stored(_cuts(sized, plan))
    full = stored(plan.alias("l").join(cuts.alias("g"), _same("l", "g") & (F.col("l.size") == F.col("g.size")), "left").select("l.*", "g.cut", "g.left", "g.ties"))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_sized(docs, seed))
    rows = rows.alias("d").join(full.alias("p"), _same("d", "p") & (F.col("d.size") == F.col("p.size"))).select("d.row", "d.k", "p.*")
    tied = F.coalesce((F.col("k") == F.col("cut")) & (F.col("left") < F.col("ties")), F.lit(False))
    extra = F.when(F.col("chosen") == F.col("n"), 1).when(F.col("k") <= F.col("cut"), 1).otherwise(0)
    if cuts.where("left < ties").isEmpty():
        rows = rows.withColumn("extra", extra)
    else:  # equal rows, of which some are taken
        rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("k"))
        rows = rows.where(~tied).withColumn("extra", extra).unionByName(rows.where(tied).withColumn("extra", (rank <= F.col("left")).cast("int")))
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": (F.col("whole") + F.col("extra")) * F.col("size")}
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])
