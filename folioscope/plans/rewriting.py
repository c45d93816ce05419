"""Queries over rewriting and small joins, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rewriting as rw
from folioscope.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Text with maths, code and rules made from each row of documents, the same in Spark and DuckDB.
_TEXT = """concat(text, ' ', chr(92), '(a_', doc_id % 5, chr(92), ') ', CASE WHEN doc_id % 3 = 0 THEN concat('`', chr(92), '(code', chr(92), ')` ') ELSE '' END, '(n) ', doc_id % 9, '.5 = x', chr(10),
  CASE WHEN doc_id % 2 = 0 THEN concat(chr(92), '[', chr(10), 'y + ', doc_id % 7, chr(10), chr(92), ']', chr(10)) ELSE concat('$$z = ', doc_id % 4, '$$', chr(10)) END, '---', chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('a', chr(9), 'b', chr(10), '1', chr(9), '2', chr(10)) ELSE '' END)"""
_SRC = f"WITH src AS (SELECT doc_id, {_TEXT} AS text FROM documents) "


def texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.expr(_TEXT).alias("text"))


def _add(name: str, build, sql: str | None = None, source=texts, prefix: str = _SRC) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = prefix + sql


_c = F.col
_add("l17_math_delimiters", lambda d: d.select("doc_id", rw.math_delimiters(_c("text")).alias("t")).select("doc_id", rw.delimiters_left(_c("t")).alias("left_over"), (rw.math_delimiters(_c("t")) == _c("t")).alias("idempotent")), "SELECT doc_id, 0 AS left_over, true AS idempotent FROM src")
_add("h88_delimiters_left", lambda d: d.select("doc_id", rw.delimiters_left(_c("text")).alias("n")), "SELECT doc_id, 1 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM src")
_add("h85_same_content", lambda d: d.select("doc_id", rw.same_content(_c("text"), rw.math_delimiters(_c("text"))).alias("kept"), rw.same_content(_c("text"), F.concat(_c("text"), F.lit("!"))).alias("changed"), rw.same_content(_c("text"), F.replace("text", F.lit("(n)"), F.lit("$n$"))).alias("renamed")), "SELECT doc_id, true AS kept, false AS changed, true AS renamed FROM src")
_PATCH = "CASE doc_id % 6 WHEN 0 THEN 'x = 1' WHEN 1 THEN 'x = 12' WHEN 2 THEN 'see Eq. (3)' WHEN 3 THEN 'a + b' WHEN 4 THEN 'word' ELSE 'p q' END"
_AFTER = "CASE doc_id % 6 WHEN 0 THEN '$x = 1$' WHEN 1 THEN 'x = 13' WHEN 2 THEN 'see Eq.(3)' WHEN 3 THEN 'a - b' WHEN 4 THEN 'ward' ELSE 'p q' END"
_add("h92_patch_gate", lambda d: d.select("doc_id", rw.patch_gate(F.expr(_PATCH), F.expr(_AFTER)).alias("gate")), "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'number_mismatch' WHEN 2 THEN 'equation_reference_protected' WHEN 3 THEN 'operator_mismatch' WHEN 4 THEN 'integrity_fail' ELSE 'noop' END AS gate FROM src")
_add("l19_apply_patches", lambda d: rw.apply_patches(d.select("doc_id", F.lit("say a b and c d, a b").alias("text"), F.explode(F.expr("array(named_struct('ord', 1, 'before', 'a b', 'after', '$a b$'), named_struct('ord', 2, 'before', 'gone', 'after', '$gone$'), named_struct('ord', 3, 'before', if(doc_id % 2 = 0, 'c d', 'c'), 'after', if(doc_id % 2 = 0, '$c d$', 'x')))")).alias("p")).select("doc_id", "text", "p.*")),
     "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'say $a b$ and $c d$, a b' ELSE 'say $a b$ and c d, a b' END AS text, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS used, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS rejected FROM src")
_add("h89_inline_score", lambda d: d.select("doc_id", rw.inline_score(F.expr("element_at(array('where', 'we get', 'done.', 'as follows:'), cast(doc_id % 4 + 1 as int))"), F.expr("element_at(array('x', '{a{b{c}}}', repeat('y', 60)), cast(doc_id % 3 + 1 as int))"), F.expr("if(doc_id % 5 = 0, ', and', 'So')"), ("where", "get"), ("and",), (":",)).cast("long").alias("score"), rw.nesting(F.expr("element_at(array('x', '{a{b{c}}}', '}}{['), cast(doc_id % 3 + 1 as int))")).alias("depth")),
     "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 55 WHEN 1 THEN 40 ELSE 30 END + CASE WHEN doc_id % 4 < 2 THEN 25 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 25 ELSE 0 END - CASE WHEN doc_id % 4 = 3 THEN 40 ELSE 0 END AS score, [0, 3, 2][doc_id % 3 + 1] AS depth FROM src")
_add("l24_repair_tables", rw.repair_tables)
_add("l14_bold", lambda d: rw.bold(d, ("the", "and", "XYZ")))
_add("c05_nearest_label", lambda d: rw.nearest_label(d.select(_c("l_orderkey").alias("page"), _c("l_linenumber").alias("id"), (_c("l_partkey") % 300).cast("double").alias("x1"), (_c("l_suppkey") % 50).cast("double").alias("y")), d.select(_c("l_orderkey").alias("page"), _c("l_linenumber").alias("label"), (_c("l_partkey") % 500).cast("double").alias("x"), (_c("l_quantity")).alias("y"))),
     """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, (l_partkey % 300)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y FROM lineitem), l AS (SELECT l_orderkey AS page, l_linenumber AS label, (l_partkey % 500)::DOUBLE AS x, l_quantity AS ly FROM lineitem)
SELECT page, id, label, x - x1 AS d FROM b JOIN l USING (page) WHERE abs(y - ly) <= 12 AND x >= x1 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY x - x1, label) = 1""", lambda s, d: load(s, d, "lineitem"), "")  # fmt: skip
_add("c31_dangling", lambda d: rw.dangling(d.select("doc_id", F.concat(F.lit("img"), (_c("doc_id") % 50).cast("string"), F.lit(".png")).alias("path")), d.sparkSession.range(0, 30).select(F.concat(F.lit("img"), _c("id").cast("string"), F.lit(".png")).alias("path"))), "SELECT doc_id, 'img' || (doc_id % 50) || '.png' AS path FROM src WHERE doc_id % 50 >= 30")
_add("a32_first_by_name", lambda d: rw.first_by_name(d, "name", "ord"), "SELECT name, ord FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '[x]' ELSE lower(c_mktsegment) END AS name, c_custkey AS ord FROM customer) QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(name, '\\[.*$', '')) ORDER BY ord) = 1",
     lambda s, d: load(s, d, "customer").select(F.expr("if(c_custkey % 2 = 0, concat(upper(c_mktsegment), '[x]'), lower(c_mktsegment))").alias("name"), _c("c_custkey").alias("ord")), "")
_add("i15_running_headers", lambda d: rw.running_headers(d, 20.0), """WITH t AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_returnflag || l_linestatus AS text, l_quantity AS y1 FROM lineitem WHERE l_quantity <= 20), r AS (SELECT doc, text, max(y1) AS y1 FROM t GROUP BY doc, text HAVING count(DISTINCT page) >= 2)
SELECT doc, max(y1) AS header_ymax, count(*) AS n FROM r GROUP BY doc""", lambda s, d: load(s, d, "lineitem").select(_c("l_suppkey").alias("doc"), _c("l_linenumber").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("text"), _c("l_quantity").alias("y1")), "")  # fmt: skip
