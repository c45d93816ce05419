"""Queries over documents, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import benchmark as bm
from folioscope.operators import quality as q
from folioscope.sources.tables import load

#: A Markdown document made from each row of documents, the same in Spark and DuckDB.
MARKDOWN = """concat(
  CASE WHEN doc_id % 3 = 0 THEN concat('PAGE ', doc_id % 7 + 1, chr(10)) WHEN doc_id % 3 = 1 THEN concat('<!-- PAGE ', doc_id % 5 + 1, ' -->', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN concat('# ', source, chr(10)) ELSE '' END,
  text, chr(10),
  CASE WHEN doc_id % 5 < 2 THEN concat('$$', chr(10), chr(92), 'frac{x}{', doc_id % 9, '} = y_', doc_id % 4, ' ', chr(92), 'tag{', doc_id % 6, '}', chr(10), CASE WHEN doc_id % 5 = 0 THEN '$$' ELSE '' END, chr(10)) ELSE '' END,
  CASE WHEN doc_id % 6 = 0 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), '| 3 | ', doc_id % 8, ' |', chr(10), '![f](img', doc_id % 3, '.png)', chr(10), 'Figure ', doc_id % 4 + 1, '. ', source, chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat('Formula extraction failed', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN concat('see http://example.com/', doc_id, ' and ![]()', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN concat(chr(92), 'begin{align} a &= b', chr(10)) ELSE '' END)"""
_SRC = f"WITH src AS (SELECT doc_id, lang, source, n_chars, {MARKDOWN} AS text FROM documents) "
_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def markdown(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.expr(MARKDOWN).alias("text"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str, source=markdown, prefix: str = _SRC) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))
    ORACLES[name] = prefix + sql


_N = f"length({_STRIP})"
_PROFILE = f"""p AS (SELECT doc_id, source, {_N} AS text_chars, {_N} < 40 AS scan_like,
  contains(replace(text, ' ', ''), chr(92) || 'frac') OR contains(replace(text, ' ', ''), chr(92) || 'sum') OR contains(replace(text, ' ', ''), chr(92) || 'int') OR regexp_matches(text, '[∑∫≤≥]') AS formula_like,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 4 AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND (len(regexp_extract_all(x, '  ')) >= 3 OR len(regexp_extract_all(x, '\\t')) >= 2))) >= 3 AS table_like,
  CASE WHEN {_STRIP} = '' THEN 'unknown' WHEN len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 20 THEN 'zh' ELSE 'en' END AS language FROM src)"""
_add("b01_page_profile", q.page_profile, f", {_PROFILE} SELECT * EXCLUDE (source) FROM p")
_add("d04_document_profile", q.document_profile, f""", {_PROFILE} SELECT source, count(*) AS page_count, 1 - avg(scan_like::INT) AS text_layer_ratio, avg(scan_like::INT) AS scan_ratio,
  avg(formula_like::INT) AS formula_density, avg(table_like::INT) AS table_density, least(1, 0.3 * avg(table_like::INT)) AS layout_complexity FROM p GROUP BY source""")
_add("b06_route", lambda d: q.route(q.document_profile(d)), f""", {_PROFILE} SELECT source, CASE WHEN avg(scan_like::INT) >= 0.7 THEN 'scan_parser' ELSE 'text_parser' END AS parser,
  CASE WHEN avg(formula_like::INT) >= 0.25 THEN 'specialist' ELSE 'on_demand' END AS formula, CASE WHEN avg(table_like::INT) >= 0.25 THEN 'specialist' ELSE 'on_demand' END AS table_route FROM p GROUP BY source""")
_add("b05_page_fallbacks", lambda d: q.page_fallbacks(q.page_profile(d)), f""", {_PROFILE} SELECT doc_id, CASE WHEN scan_like THEN 'vision_page' WHEN table_like THEN 'table_structure' ELSE 'formula_recognition' END AS capability
  FROM p WHERE scan_like OR table_like OR formula_like""")

_FIG = r"regexp_matches(t, '!\[[^\]]*\]\([^)]+\)') OR regexp_matches(t, '(?im)^\s*\*{0,2}\s*(?:Figure|Fig\.?)\s*\d+')"
_ROWS = r"len(regexp_extract_all(t, '(?m)^\|[^\n]+\|'))"
_add("b22_page_type", lambda d: d.select("doc_id", tx.page_type(F.col("text")).alias("page_type"), tx.image_ratio(F.col("text")).alias("image_ratio")), f""", s AS (SELECT doc_id, text, {_STRIP} AS t FROM src)
SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN {_FIG} THEN CASE WHEN length(t) >= 100 THEN 'image_text' ELSE 'image' END WHEN {_ROWS} >= 4 THEN 'table' WHEN regexp_matches(t, '(?im)^\\[\\d{{1,3}}\\]|\\(\\d{{4}}\\)[.,]') THEN 'reference'
  WHEN regexp_matches(t, '(?m)[▶☐☑☒]|(?:^\\s*[<>]\\s*$)') OR (regexp_matches(t, '(?i)\\b(?:Click|Enter|Select|Save|Cancel|Continue|Help|Navigate|Press|Confirm|Exit)\\b') AND length(t) < 500) THEN 'screenshot'
  WHEN length(t) < 100 THEN CASE WHEN length(t) <= 80 AND NOT ends_with(t, '.') AND ((upper(t) = t AND lower(t) <> t) OR regexp_matches(t, '^[A-Z0-9][A-Za-z0-9 ,&/''-]{{2,}}$') OR regexp_matches(t, '(?i)\\b(?:Case Study|Figure|Table|Chapter)\\b')) THEN 'title' ELSE 'text_short' END
  ELSE 'text' END AS page_type,
  CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0 THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(x, '!\\[[^\\]]*\\]\\([^)]+\\)')))::DOUBLE / len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) ELSE 0 END AS image_ratio FROM s""")
_add("b31_least_chars", lambda d: d.select("doc_id", tx.least_chars(F.col("text")).cast("long").alias("least_chars"), tx.figure_page(F.col("text")).alias("figure_heavy"), (tx.count(F.col("text"), tx.TABLE_ROW) >= 4).alias("table_heavy")), f""", s AS (SELECT doc_id, text AS t FROM src)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?m)^\\[\\d{{1,3}}\\]') OR (regexp_matches(t, '\\(\\d{{4}}\\)[.,]') AND regexp_matches(lower(t), 'doi:|http|retrieved from')) THEN 120 WHEN regexp_matches(t, '(?i)\\(contd\\.\\s*from\\s*page') THEN 100 WHEN {_FIG} THEN 100 WHEN {_ROWS} >= 4 THEN 180 ELSE 280 END::BIGINT AS least_chars,
  {_FIG} AS figure_heavy, {_ROWS} >= 4 AS table_heavy FROM s""")


def checked(d):
    pages, ids = F.array((F.col("doc_id") % 7 + 1).cast("int")), F.array((F.col("doc_id") % 6).cast("string"))
    use = lambda n, a: F.when(F.col("doc_id") % n == 0, a)
    found = tx.checks(F.col("text"), use(3, pages), use(5, ids), use(2, F.array("source")), ("FIGURE_PLACEHOLDER",))
    return d.select("doc_id", "lang", "source", "n_chars", found.alias("checks"))


_MARKS = r"len(regexp_extract_all(text, '(?i)<!--\s*FIGURE\b|FIGURE_PLACEHOLDER|!\[\]\(\s*\)')) + len(regexp_extract_all(text, '(?i)https?://(?:example\.invalid|localhost|example\.com)/[^\s)]*'))"
_IDS = r"list_distinct(list_concat(regexp_extract_all(text, '\\tag\{([^}]+)\}', 1), regexp_extract_all(text, '(?:Eq\.?\s*)?\((\d+[a-z]?)\)', 1)))"
_CHECKS = f"""c AS (SELECT *, CASE WHEN {_STRIP} <> '' THEN 'pass' ELSE 'fail' END AS c1,
  CASE WHEN doc_id % 3 <> 0 THEN 'skip' WHEN list_contains(list_concat(regexp_extract_all(text, '(?im)^\\s*(?:PAGE\\s+(\\d+)|<!--\\s*PAGE\\s+(\\d+)\\s*-->)', 1), regexp_extract_all(text, '(?im)^\\s*(?:PAGE\\s+(\\d+)|<!--\\s*PAGE\\s+(\\d+)\\s*-->)', 2)), (doc_id % 7 + 1)::VARCHAR) THEN 'pass' ELSE 'fail' END AS c2,
  CASE WHEN regexp_matches(text, '(?i)formula-not-decoded|Formula extraction failed') THEN 'fail' ELSE 'pass' END AS c3,
  CASE WHEN len(regexp_extract_all(text, '\\$\\$')) % 2 <> 0 OR len(list_filter(list_distinct(regexp_extract_all(text, '\\\\begin\\{{([A-Za-z*]+)\\}}', 1)), lambda e: len(string_split(text, chr(92) || 'begin{{' || e || '}}')) > len(string_split(text, chr(92) || 'end{{' || e || '}}')))) > 0 THEN 'fail' ELSE 'pass' END AS c4,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN len({_IDS}) > 0 THEN 'pass' ELSE 'skip' END WHEN list_contains({_IDS}, (doc_id % 6)::VARCHAR) THEN 'pass' ELSE 'fail' END AS c5,
  CASE WHEN doc_id % 2 <> 0 THEN 'skip' WHEN contains(text, source) THEN 'pass' ELSE 'fail' END AS c6,
  CASE WHEN {_MARKS} = 0 THEN 'pass' WHEN {_MARKS} < 3 THEN 'warn' ELSE 'fail' END AS c7, CASE WHEN contains(text, 'FIGURE_PLACEHOLDER') THEN 'fail' ELSE 'pass' END AS c8 FROM src),
v AS (SELECT *, [c1, c2, c3, c4, c5, c6, c7, c8] AS cs, CASE WHEN c1 = 'fail' THEN 'FAILED' WHEN list_contains([c2, c3, c4, c5, c6, c7, c8], 'fail') THEN 'INCOMPLETE' WHEN c7 = 'warn' THEN 'DONE_WITH_WARNINGS' ELSE 'DONE_VERIFIED' END AS status FROM c)"""
_NAMES = "['empty_document', 'page_coverage', 'formula_unresolved', 'formula_structural_validity', 'equation_number_preservation', 'text_anchor_preservation', 'placeholder_or_fake_url', 'forbidden_markers']"
_add("b12_checks", lambda d: checked(d).select("doc_id", F.posexplode("checks").alias("pos", "c")).select("doc_id", "c.check_id", "c.status"), f", {_CHECKS} SELECT doc_id, unnest({_NAMES}) AS check_id, unnest(cs) AS status FROM v")
_add("b21_quality_report", lambda d: q.report(checked(d)), f""", {_CHECKS}, l AS (SELECT doc_id, status, {", ".join(f"len(list_filter(cs, lambda x: x = '{s}')) AS n_{s}" for s in ("pass", "warn", "fail", "skip"))},
  array_to_string(list_filter(list_transform({_NAMES}, lambda n, i: CASE WHEN cs[i] = 'fail' THEN n END), lambda x: x IS NOT NULL), ',') AS bad, array_to_string(list_filter(list_transform({_NAMES}, lambda n, i: CASE WHEN cs[i] IN ('fail', 'warn') THEN n END), lambda x: x IS NOT NULL), ',') AS warnings FROM v)
SELECT doc_id, status, n_pass, n_warn, n_fail, n_skip, CASE WHEN status IN ('FAILED', 'INCOMPLETE') THEN bad ELSE '' END AS blocking_failures, warnings FROM l""")


def flagship(spark, sf_dir):
    """Documents -> checks -> verdict -> expected outcome from labels -> pass rate and latency by slice."""
    verdicts = checked(markdown(spark, sf_dir)).select("doc_id", "lang", "source", F.col("n_chars").alias("latency"), q.verdict(F.col("checks")).alias("status"))
    expected = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "DONE_VERIFIED").otherwise("INCOMPLETE").alias("expected"))
    cases = verdicts.join(expected, "doc_id").withColumn("passed", F.col("status") == F.col("expected"))
    return bm.slices(cases, "lang", "source")


_CASES = f"{_CHECKS}, k AS (SELECT lang, source, n_chars AS latency, status = CASE WHEN quality = 1 THEN 'DONE_VERIFIED' ELSE 'INCOMPLETE' END AS passed FROM v JOIN labels USING (doc_id))"
QUERIES["d07_benchmark_slices"] = flagship
ORACLES["d07_benchmark_slices"] = _SRC + f""", {_CASES}, e AS (SELECT 'overall' AS slice, passed, latency FROM k UNION ALL SELECT 'lang:' || lang, passed, latency FROM k WHERE lang IS NOT NULL UNION ALL SELECT 'source:' || source, passed, latency FROM k WHERE source IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY latency) AS pos, count(*) OVER (PARTITION BY slice) AS n FROM e)
SELECT slice, count(*) AS cases, avg(passed::INT) AS pass_rate, max(latency) FILTER (pos = round_even(0.5 * (n - 1), 0)::INT + 1) AS p50, max(latency) FILTER (pos = round_even(0.95 * (n - 1), 0)::INT + 1) AS p95 FROM r GROUP BY slice"""

_LABELLED = "SELECT n_chars, quality = 1 AS expected FROM documents JOIN labels USING (doc_id)"


def _scored(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.col("n_chars") / 1000.0).alias("score"), (F.col("n_chars") >= 500).alias("accepted"), (F.col("quality") == 1).alias("expected"))


_add("d23_confusion", bm.confusion, f"""s AS ({_LABELLED}), c AS (SELECT count(*) AS n, count(*) FILTER (n_chars >= 500 AND expected) AS tp, count(*) FILTER (n_chars >= 500 AND NOT expected) AS fp,
  count(*) FILTER (n_chars < 500 AND expected) AS fn, count(*) FILTER (n_chars < 500 AND NOT expected) AS tn FROM s)
SELECT *, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision_, tp::DOUBLE / nullif(tp + fn, 0) AS coverage FROM c""", _scored, "WITH ")
_add("d32_threshold_sweep", lambda d: bm.sweep(d, (0.1, 0.5, 1.0, 2.0, 5.0, 20.0)), f"""s AS ({_LABELLED}), c AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (n_chars / 1000.0 >= threshold) AS accepts, count(*) FILTER (n_chars / 1000.0 >= threshold AND expected) AS ta, count(*) FILTER (expected) AS p, count(*) AS n
  FROM s, (VALUES (0.1), (0.5), (1.0), (2.0), (5.0), (20.0)) t(threshold) GROUP BY threshold)
SELECT threshold, accepts, accepts - ta AS false_accepts, ta::DOUBLE / nullif(accepts, 0) AS precision_, ta::DOUBLE / nullif(p, 0) AS coverage, coalesce(ta::DOUBLE / nullif(accepts, 0) >= 0.99, false) AND accepts - ta <= greatest(1, 0.01 * n) AS passes FROM c""", _scored, "WITH ")


def _reports(spark, sf_dir):
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    half = o.select("c_mktsegment", (F.col("o_orderkey") % 2).alias("side"), (F.col("o_orderstatus") == "F").cast("int").alias("ok")).where("not (side = 0 and c_mktsegment = 'BUILDING')")
    report = lambda s: half.where(f"side = {s}").groupBy("c_mktsegment").agg(F.avg("ok").alias("value")).select(F.col("c_mktsegment").alias("slice"), "value").unionByName(half.where(f"side = {s}").agg(F.avg("ok").alias("value")).select(F.lit("overall").alias("slice"), "value"))
    return bm.delta(report(0), report(1))


_DELTA = """h AS (SELECT c_mktsegment, o_orderkey % 2 AS side, (o_orderstatus = 'F')::INT AS ok FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey % 2 = 0 AND c_mktsegment = 'BUILDING')),
r AS (SELECT coalesce(c_mktsegment, 'overall') AS slice, side, avg(ok) AS value FROM h GROUP BY GROUPING SETS ((side), (side, c_mktsegment))),
d AS (SELECT slice, coalesce(b.value, 0) AS baseline, coalesce(c.value, 0) AS candidate, coalesce(c.value, 0) - coalesce(b.value, 0) AS delta FROM (SELECT * FROM r WHERE side = 0) b FULL JOIN (SELECT * FROM r WHERE side = 1) c USING (slice))"""
_add("c13_report_delta", lambda d: d, f"{_DELTA} SELECT * FROM d", _reports, "WITH ")
_add("c14_change_gate", bm.change_gate, f"""{_DELTA}, g AS (SELECT min(delta) FILTER (slice = 'overall') AS total, min(slice) FILTER (slice <> 'overall' AND slice NOT LIKE 'suite:%' AND delta < -0.05) AS bad FROM d),
x AS (SELECT CASE WHEN total IS NULL THEN 'missing_overall' WHEN total < 0 THEN 'overall_regression' WHEN bad IS NOT NULL THEN 'slice_regression:' || bad ELSE 'ok' END AS reason FROM g) SELECT reason = 'ok' AS allowed, reason FROM x""", _reports, "WITH ")

_docs = lambda spark, sf_dir: load(spark, sf_dir, "documents")
_add("d34_majority_vote", lambda d: bm.majority(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("a"), (F.col("n_chars") % 3).alias("b"), (F.length("text") % 2).cast("long").alias("c"))),
     """v AS (SELECT doc_id AS id, doc_id % 3 AS a, n_chars % 3 AS b, length(text) % 2 AS c FROM documents), w AS (SELECT *, CASE WHEN a = b THEN a WHEN a = c THEN a WHEN b = c THEN b END AS value FROM v)
SELECT id, a = b AS dual, value IS NOT NULL AS two_of_three, value FROM w""", _docs, "WITH ")  # fmt: skip
_add("d37_fixed_histogram", lambda d: bm.histogram(d, "lang", ("en", "fr", "xx")), "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT category, coalesce(n, 0) AS n FROM (VALUES ('en'), ('fr'), ('xx')) t(category) LEFT JOIN c ON lang = category", _docs, "WITH ")
_add("f06_stratified_pick", lambda d: bm.top_per_group(d, "lang", [F.col("doc_id")], 20).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20", _docs, "")
_add("f05_top_difficulty", lambda d: d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200", _docs, "")
_add("d36_histogram_pivot", lambda d: d.groupBy("lang").pivot("b", ["long", "short"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT lang, count(*) FILTER (n_chars >= 1000) AS long, count(*) FILTER (n_chars < 1000) AS short FROM documents GROUP BY lang",
     lambda s, d: _docs(s, d).select("lang", F.when(F.col("n_chars") >= 1000, "long").otherwise("short").alias("b")), "")
_add("c16_upsert", lambda d: bm.upsert(d.select("doc_id", "n_chars", "lang"), d.select(F.expr("if(doc_id % 3 = 0, doc_id, -doc_id)").alias("doc_id"), (F.col("n_chars") + 1).alias("n_chars"), F.expr("if(doc_id % 9 = 0, null, 'xx')").alias("lang")), "doc_id", ("n_chars", "lang")),
     """b AS (SELECT * FROM documents), p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -doc_id END AS doc_id, n_chars + 1 AS n, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'xx' END AS l FROM documents) SELECT doc_id, coalesce(n, n_chars) AS n_chars, coalesce(l, lang) AS lang FROM b FULL JOIN p USING (doc_id)""", _docs, "WITH ")  # fmt: skip
