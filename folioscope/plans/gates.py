"""Queries over scores and gates, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import gates as g
from folioscope.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A formula candidate made from each row of documents, the same in Spark and DuckDB.
_COLUMNS = {
    "tex": "concat(CASE doc_id % 8 WHEN 0 THEN concat(chr(92), 'frac{a}{b} = x_', doc_id % 5) WHEN 1 THEN 'a + b =' WHEN 2 THEN repeat(concat(chr(92), 'quad '), 9) WHEN 3 THEN 'x = {y' WHEN 4 THEN concat(chr(92), 'begin{align} a ', chr(92), 'end{cases}') WHEN 5 THEN 'a b c d e f' WHEN 6 THEN concat('some prose words without ', lang) ELSE text END)",
    "token": "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN cast(doc_id % 40 AS varchar(10)) WHEN 2 THEN '2019' WHEN 3 THEN '12%' WHEN 4 THEN 'x' WHEN 5 THEN cast(doc_id AS varchar(10)) ELSE '0' END",
    "status": "CASE doc_id % 3 WHEN 0 THEN 'unnumbered_confirmed' WHEN 1 THEN 'numbered_confirmed' ELSE '' END",
    "context": "CASE doc_id % 5 WHEN 0 THEN 'see Eq. (2019) and Eq. (3)' WHEN 1 THEN 'Table 2 shows' WHEN 2 THEN concat('by Equation (', doc_id % 40, ') we') WHEN 3 THEN 'cost $5' ELSE 'plain' END",
    "before_c": "(doc_id % 11) / 10.0", "after_c": "(doc_id % 7) / 10.0", "overlap": "(doc_id % 13) / 50.0",
    "reason": "CASE doc_id % 4 WHEN 0 THEN 'gain_accept' WHEN 1 THEN 'x, ocr_context_conflict' WHEN 2 THEN 'ocr_context_insufficient' ELSE 'accept_despite_insufficient_context' END",
}
_SRC = "WITH src AS (SELECT doc_id, n_chars, " + ", ".join(f"{'CAST(' if n in ('before_c', 'after_c', 'overlap') else ''}{e}{' AS DOUBLE)' if n in ('before_c', 'after_c', 'overlap') else ''} AS {n}" for n, e in _COLUMNS.items()) + " FROM documents) "


def candidates(spark, sf_dir):
    number = ("before_c", "after_c", "overlap")
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars", *[F.expr(f"cast({e} as double)" if n in number else e).alias(n) for n, e in _COLUMNS.items()])


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(candidates(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = _SRC + sql


_c = F.col
_mod = lambda n: F.col("doc_id") % n
_number = lambda: g.number_class(_c("token"), _c("status"), _mod(2) == 0, _c("context"))
_MARKED = "regexp_matches(context, '(?i)(?:Eq\\.?|Equation)\\s*\\(\\s*' || coalesce(try_cast(token AS INT), 0) || '\\s*\\)')"
_CLASS = f"""nc AS (SELECT *, CASE WHEN token = '' AND status = 'unnumbered_confirmed' THEN 'unnumbered' WHEN token = '' THEN 'none' WHEN regexp_matches(token, '^\\d+%$|^\\d+\\.\\d+$') THEN 'non_equation_number' WHEN try_cast(token AS INT) IS NULL THEN 'suspicious_number2' WHEN token::INT = 0 THEN 'non_equation_number'
  WHEN token::INT BETWEEN 1900 AND 2100 THEN CASE WHEN {_MARKED} THEN 'suspicious_number15' ELSE 'non_equation_number' END WHEN regexp_matches(context, '(?i)\\b(fig(?:ure)?|table|tab\\.?|section|sec\\.?|chapter|chap\\.?|year|vol\\.?|pp\\.?|page|pages|doi|isbn|issn)\\b') AND NOT {_MARKED} THEN 'suspicious_number2'
  WHEN token::INT > 200 THEN 'suspicious_number25' WHEN status = 'numbered_confirmed' OR doc_id % 2 = 0 THEN 'confirmed_equation_number' WHEN {_MARKED} THEN 'plausible_equation_number85' ELSE 'plausible_equation_number55' END AS k FROM src),
n AS (SELECT * EXCLUDE (k), regexp_replace(k, '\\d+$', '') AS class, CASE k WHEN 'unnumbered' THEN 0.35 WHEN 'none' THEN 0.15 WHEN 'non_equation_number' THEN 0.05 WHEN 'suspicious_number2' THEN 0.2 WHEN 'suspicious_number15' THEN 0.15 WHEN 'suspicious_number25' THEN 0.25 WHEN 'confirmed_equation_number' THEN 1 WHEN 'plausible_equation_number85' THEN 0.85 ELSE 0.55 END::DOUBLE AS score FROM nc)"""
_add("b56_number_class", lambda d: d.select("doc_id", _number().alias("n")).select("doc_id", "n.class", "n.score"), f", {_CLASS} SELECT doc_id, class, score FROM n")
_DENSITY = r"CASE WHEN trim(tex) = '' THEN 0 ELSE least(1, len(regexp_extract_all(trim(tex), '\\[a-zA-Z]+|[_^]|\{|\}|=')) / greatest(8.0, length(regexp_replace(tex, '^\s+|\s+$', '', 'g')) / 12.0)::DOUBLE) END"
_PRIORITY = rf"""{_CLASS}, dn AS (SELECT *, {_DENSITY} AS d FROM n), pr AS (SELECT *, 0.55::DOUBLE * d + 0.25::DOUBLE * least(1, before_c) + 0.2::DOUBLE * least(1, d * before_c) + 1.2::DOUBLE * score
  + 0.8::DOUBLE * CASE WHEN len(regexp_extract_all(context, '(?i)(?:Eq\.?|Equation)\s*\(\s*\d+\s*\)')) >= 2 THEN 1 WHEN len(regexp_extract_all(context, '(?i)(?:Eq\.?|Equation)\s*\(\s*\d+\s*\)')) = 1 THEN 0.7 WHEN contains(context, '$') OR contains(context, chr(92)) THEN 0.35 ELSE 0.1 END + 0.6::DOUBLE * 0.5
  + least(1, n_chars / 8000.0::DOUBLE) * 0.15::DOUBLE + 0.06 - CASE class WHEN 'non_equation_number' THEN 0.8 WHEN 'suspicious_number' THEN 0.35 ELSE 0 END AS total FROM dn)"""
_total = lambda: g.priority(_c("tex"), _c("before_c"), _number(), _c("context"), _c("n_chars"), F.lit(0.06), F.lit(0.5), F.lit(0.0))
_add("f02_priority_score", lambda d: d.select("doc_id", _total().alias("total")), f", {_PRIORITY} SELECT doc_id, total FROM pr")
_add("f01_prioritised", lambda d: d.select("doc_id", g.rounded(_total(), 6).alias("t"), (_c("doc_id") % 20).alias("document")).select("doc_id", "document", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("t"), "doc_id")).alias("rank")),
     f", {_PRIORITY} SELECT doc_id, doc_id % 20 AS document, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY round(total, 6) DESC, doc_id) AS rank FROM pr")
_add("h26_bare_tokens", lambda d: d.select("doc_id", g.bare(_c("tex")).alias("bare"), g.token_count(_c("tex")).alias("tokens"), g.truncated(_c("tex")).alias("truncated")), r"""
SELECT doc_id, regexp_replace(regexp_replace(tex, '\\(?:quad|qquad|[,;:!]|hspace\s*\{[^}]*\}|vspace\s*\{[^}]*\})', '', 'g'), '\\[ \t]|\\{2,}|\s+', '', 'g') AS bare, len(regexp_extract_all(regexp_replace(tex, '\\(?:quad|qquad|[,;:!])', ' ', 'g'), '\\[A-Za-z]+|[A-Za-z0-9]+')) AS tokens,
  trim(tex) <> '' AND (len(replace(tex, '{', '')) <> len(replace(tex, '}', '')) OR regexp_matches(trim(tex), '(?:\\frac|\\times|\+|-|=)\s*$') OR regexp_matches(trim(tex), '[\\{(]$')) AS truncated FROM src""")
_add("h28_corruption", lambda d: d.select("doc_id", g.corruption(_c("tex")).alias("q")).select("doc_id", "q.*"))
_gain = lambda: g.gain(_c("before_c"), _c("after_c"), _c("overlap"), _mod(5) != 0, _mod(10) == 0, _mod(9) == 0, _mod(17) == 0, _mod(4) == 2)
_GAIN = """gn AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'ocr_context_conflict' WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'ocr_truncated' ELSE 'ocr_still_invalid' END WHEN doc_id % 9 = 0 THEN 'ocr_prose_recovery'
  WHEN doc_id % 4 = 2 THEN CASE WHEN after_c <= 0.45 AND doc_id % 10 <> 0 THEN 'accept_despite_insufficient_context' ELSE 'insufficient_without_strong_evidence' END WHEN (before_c - after_c < 0.15 AND before_c < 0.5) OR (overlap < 0.05 AND before_c < 0.75) THEN 'no_significant_gain' ELSE 'gain_accept' END AS why FROM src)"""
_add("j01_gain_gate", lambda d: d.select("doc_id", _gain().alias("x")).select("doc_id", "x.accept", F.col("x.reason").alias("why")), f", {_GAIN} SELECT doc_id, why IN ('gain_accept', 'accept_despite_insufficient_context') AS accept, why FROM gn")
_add("d24_gate_confusion", lambda d: d.select(_gain()["accept"].alias("got"), (_mod(3) != 0).alias("want")).groupBy(F.expr("concat(if(got = want, 'true_', 'false_'), if(got, 'accept', 'reject'))").alias("bucket")).agg(F.count("*").alias("n")),
     f", {_GAIN}, o AS (SELECT why IN ('gain_accept', 'accept_despite_insufficient_context') AS got, doc_id % 3 <> 0 AS want FROM gn) SELECT CASE WHEN got = want THEN 'true_' ELSE 'false_' END || CASE WHEN got THEN 'accept' ELSE 'reject' END AS bucket, count(*) AS n FROM o GROUP BY 1")
_add("j04_gate_class", lambda d: d.select("doc_id", g.gate_class(_mod(6) != 0, _c("reason")).alias("class"), g.context_status(_c("reason")).alias("status")), """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'REJECT' WHEN doc_id % 4 IN (0, 3) THEN 'ACCEPT_HIGH_CONFIDENCE' ELSE 'ACCEPT_BORDERLINE' END AS class,
  CASE doc_id % 4 WHEN 1 THEN 'conflict' WHEN 2 THEN 'insufficient' WHEN 3 THEN 'insufficient_accepted' ELSE 'other' END AS status FROM src""")
_risk = lambda: g.risk(_mod(5) != 0, _mod(7) != 0, F.expr("element_at(array('ACCEPT', 'DISAGREE', 'INCOMPLETE', 'ACCEPT_VISUAL'), cast(doc_id % 4 + 1 as int))"))
_RISK = "rk AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'high' ELSE ['low', 'high', 'medium', 'low'][doc_id % 4 + 1] END AS risk FROM src), ou AS (SELECT *, CASE WHEN risk = 'low' THEN 'accept' ELSE 'abstain' END AS decision, CASE WHEN doc_id % 3 <> 2 THEN doc_id % 3 = 0 END AS exact FROM rk), so AS (SELECT *, CASE WHEN exact IS NULL THEN 'no_gold' WHEN decision = 'accept' THEN CASE WHEN exact THEN 'true_accept' ELSE 'false_accept' END WHEN exact THEN 'abstain_miss' ELSE 'abstain_correct' END AS outcome FROM ou)"
_shadow = lambda d: d.select("doc_id", _risk().alias("r"), F.when(_mod(3) != 2, _mod(3) == 0).alias("exact")).select("doc_id", "r.risk", "r.decision", g.shadow_outcome(_c("r.decision"), _c("exact")).alias("outcome"))
_add("j05_shadow", _shadow, f", {_RISK} SELECT doc_id, risk, decision, outcome FROM so")
_add("d22_shadow_summary", lambda d: _shadow(d).where("outcome <> 'no_gold'").agg(F.count("*").alias("n_gold"), F.sum(F.expr("if(decision = 'accept', 1, 0)")).alias("accepts"), F.sum(F.expr("if(outcome = 'true_accept', 1, 0)")).alias("true_accepts")).select("*", F.expr("try_divide(true_accepts, accepts)").alias("precision_"), F.expr("try_divide(true_accepts, n_gold)").alias("coverage")),
     f", {_RISK}, s AS (SELECT count(*) AS n_gold, count(*) FILTER (decision = 'accept') AS accepts, count(*) FILTER (outcome = 'true_accept') AS true_accepts FROM so WHERE outcome <> 'no_gold') SELECT *, true_accepts::DOUBLE / accepts AS precision_, true_accepts::DOUBLE / n_gold AS coverage FROM s")
_add("b50_missed_bucket", lambda d: d.select("doc_id", g.missed_bucket(_c("tex"), _mod(5) != 0, _c("after_c"), _mod(3) == 0, g.context_status(_c("reason")), _mod(8) == 2, _mod(2) == 0).alias("bucket")), """SELECT doc_id, CASE WHEN doc_id % 4 IN (2, 3) AND doc_id % 8 <> 2 AND trim(tex) <> '' THEN CASE WHEN doc_id % 2 = 0 THEN 'numbered::' ELSE 'unnumbered::' END ||
  CASE WHEN doc_id % 5 <> 0 AND after_c <= 0.45 THEN CASE WHEN doc_id % 3 = 0 THEN 'clean_but_flagged_truncated' ELSE 'clean' END WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'valid_but_truncated' ELSE 'other' END END AS bucket FROM src""")
_add("b53_crop_or_reading", lambda d: d.select("doc_id", g.crop_or_reading(_mod(2) == 0, _mod(3) == 0, _mod(5) == 0).alias("x")).select("doc_id", "x.wide", "x.tight"), """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'OK' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'CROP_CLIPPED' ELSE 'OCR_FAILURE' END AS wide,
  CASE WHEN doc_id % 3 = 0 THEN 'OK' WHEN doc_id % 2 = 0 THEN 'POSTPROCESS_FAILURE' ELSE 'OCR_FAILURE' END AS tight FROM src""")
_add("b60_gold_issues", lambda d: d.select("doc_id", F.array_join(g.gold_issues(F.expr("if(doc_id % 9 = 0, '', 'id')"), F.expr("if(doc_id % 11 = 0, '', 's')"), (_mod(6) - 1), F.expr("if(doc_id % 5 = 0, '(7)', if(doc_id % 7 = 0, '', tex))"), F.lit("7"), _mod(2) == 0), ",").alias("issues")), """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'missing_id' END, CASE WHEN doc_id % 11 = 0 THEN 'missing_source' END,
  CASE WHEN doc_id % 6 = 0 THEN 'missing_page' END, CASE WHEN doc_id % 5 = 0 THEN 'gold_is_number_only' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR trim(tex) = '') THEN 'verified_without_gold' END], lambda x: x IS NOT NULL), ',') AS issues FROM src""")
_add("j08_format_only", lambda d: d.select("doc_id", g.format_only(F.expr("CASE doc_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('Odd fence') WHEN 2 THEN array('odd fence', 'missing page') ELSE array('order wrong') END"), ("fence", "missing page"), ("missing page",)).alias("format_only")), "SELECT doc_id, doc_id % 4 = 1 AS format_only FROM src")
