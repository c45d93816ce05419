"""Content that a change of format must keep, in texts with dollar signs that are no delimiters."""

from pyspark.sql import functions as F

from folioscope.operators import rewriting as rw

TEXTS = [
    "it costs $5 \\(a_1\\) (n) 1.5 = x\n$$z = 3$$\n---\n",
    "that$$$ the\nof$$$ it \\(a_1\\) (n) 1.5 = x\n\\[\ny + 4\n\\]\n---\n",
    "a$$$\nb, c \\(a_1\\) `\\(code\\)` (n) 1.5 = x\n$$z = 3$$\n---\n",
    "one $$$ \\[ x $ y \\] (n)\n",
]


def test_stray_dollar_signs_do_not_count_as_changes(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    same = lambda after: rw.same_content(F.col("text"), after)
    got = d.select(same(rw.math_delimiters(F.col("text"))).alias("kept"), same(F.replace("text", F.lit("(n)"), F.lit("$n$"))).alias("renamed"), same(F.concat("text", F.lit("!"))).alias("changed")).collect()
    assert [tuple(r) for r in got] == [(True, True, False)] * len(TEXTS)


def test_lost_dollar_signs_and_letters_are_changes(spark):
    pairs = [("it costs $5 (n)", "it costs 5 (n)"), ("a$$$ \\(b\\)", "a$$ $b$"), ("a$ \\(b\\) c", "a$ $b$ d")]
    d = spark.createDataFrame(pairs, "a string, b string")
    assert [r.s for r in d.select(rw.same_content(F.col("a"), F.col("b")).alias("s")).collect()] == [False] * len(pairs)
