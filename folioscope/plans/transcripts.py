"""Queries over transcripts and their pages, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import transcript as tr
from folioscope.operators import pages as pg
from folioscope.sources.tables import load

#: A transcript made from each row of documents, the same in Spark and DuckDB.
TRANSCRIPT = """concat(CASE WHEN doc_id % 5 = 0 THEN concat('Sidebar title', chr(10), 'One', chr(10), 'Two', chr(10), 'Three', chr(10), 'Four', chr(10), 'Five', chr(10), 'Six', chr(10), 'Seven', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 <> 0 THEN concat('<!-- DOC:PAGE:000', doc_id % 3 + 1, ' -->', chr(10)) ELSE '' END, text, chr(10), '<!-- DOC:PAGE_END:000', doc_id % 3 + 1, ' -->', chr(10),
  CASE WHEN doc_id % 4 = 0 THEN concat('<!-- DOC:PAGE:000', doc_id % 2 + 2, ' -->', chr(10), '| a | b |', chr(10), '$$x$$', chr(10), '<!-- DOC:FIGURE:p0002:f0', doc_id % 2 + 1, ' -->', chr(10), 'Fig. ', doc_id % 6 + 1, ': ', lang, chr(10)) ELSE '' END,
  CASE WHEN doc_id % 6 = 0 THEN concat('<!-- DOC:PAGE:0002 -->', chr(10), 'short 1,$234 and de fi ne a', chr(92), '_b max value 12.5% 1,234,567', chr(10), '<!-- DOC:FIGURE:p0002:f01 -->', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 9 = 0 THEN repeat('K. ', 25) WHEN doc_id % 9 = 1 THEN concat(repeat('k', 45), ' min') ELSE '' END)"""
_SRC = f"WITH src AS (SELECT doc_id, lang, {TRANSCRIPT} AS text FROM documents) "
_PAGES = """sp AS (SELECT doc_id, regexp_extract_all(text, '<!--\\s*DOC:PAGE:(\\d{4})\\s*-->', 1) AS nums, regexp_split_to_array(text, '<!--\\s*DOC:PAGE:\\d{4}\\s*-->')[2:] AS bodies FROM src),
ex AS (SELECT doc_id, unnest(nums)::INT AS page, unnest(bodies) AS raw, generate_subscripts(nums, 1) AS pos FROM sp WHERE len(nums) > 0),
pg AS (SELECT doc_id, page, regexp_replace(regexp_replace(raw, '<!--\\s*DOC:PAGE_END:\\d{4}\\s*-->', '', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM ex QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) = 1)"""


def transcripts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(TRANSCRIPT).alias("text"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(transcripts(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = _SRC + sql


_add("k01_split_pages", pg.split, f""", {_PAGES} SELECT doc_id, page, body, length(body) AS chars, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS n_lines, len(regexp_extract_all(body, '\\$\\$')) // 2 AS math_blocks,
  len(regexp_extract_all(body, '(?m)^\\|[^\\n]+\\|')) AS table_rows, len(regexp_extract_all(body, 'DOC:FIGURE')) AS figures FROM pg""")
_add("k02_rebuild_pages", lambda d: pg.rebuild(pg.split(d)), f", {_PAGES} SELECT doc_id, string_agg('<!-- DOC:PAGE:' || lpad(page::VARCHAR, 4, '0') || ' -->' || chr(10) || body, chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY doc_id")
_add("k03_replace_pages", lambda d: pg.replace(pg.split(d), d.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("page"), F.lit("new").alias("body"))),
     f", {_PAGES}, n AS (SELECT doc_id, 2 AS page, 'new' AS nb FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, page, coalesce(nb, body) AS body FROM pg FULL JOIN n USING (doc_id, page)")
_add("k17_figure_markers", pg.figure_markers, """, m AS (SELECT doc_id, regexp_extract_all(text, '<!--\\s*DOC:FIGURE:p(\\d{4}):f(\\d{2})\\s*-->', 2) AS f FROM src), e AS (SELECT doc_id, unnest(f) AS f, generate_subscripts(f, 1) AS pos FROM m), d AS (SELECT doc_id, f, min(pos) AS pos FROM e GROUP BY doc_id, f)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS ord, 2 AS page, f::INT AS figure FROM d""")
_add("b32_page_errors", lambda d: pg.page_errors(d, 1, 3), f""", {_PAGES}, w AS (SELECT doc_id, unnest([1, 2, 3]) AS page FROM src), j AS (SELECT doc_id, page, body, length(body) AS n FROM w LEFT JOIN pg USING (doc_id, page)),
l AS (SELECT *, CASE WHEN regexp_matches(body, '(?m)^\\[\\d{{1,3}}\\]') OR (regexp_matches(body, '\\(\\d{{4}}\\)[.,]') AND regexp_matches(lower(body), 'doi:|http|retrieved from')) THEN 120 WHEN regexp_matches(body, '(?im)^\\s*\\*{{0,2}}\\s*(?:Figure|Fig\\.?)\\s*\\d+') OR regexp_matches(body, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 100 WHEN len(regexp_extract_all(body, '(?m)^\\|[^\\n]+\\|')) >= 4 THEN 180 ELSE 280 END AS least FROM j),
r AS (SELECT doc_id, page, CASE WHEN body IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' WHEN n < least * 0.88 THEN 'short' WHEN n > 28000 THEN 'long' END AS error FROM l) SELECT * FROM r WHERE error IS NOT NULL""")
_add("l25_unique_page_markers", pg.unique_page_markers, """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src),
p AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*<!--\\s*DOC:PAGE:(\\d{4})\\s*-->\\s*$') THEN regexp_extract(line, 'PAGE:(\\d{4})', 1) END AS page FROM l), f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, page) AS first FROM p)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM f WHERE page IS NULL OR pos = first GROUP BY doc_id""")
_add("b33_degenerate", lambda d: d.select("doc_id", tr.degenerate(F.col("text")).alias("degenerate"), tr.references_heavy(F.col("text")).alias("references_heavy"), tr.lacks_structure(F.col("text")).alias("lacks_structure"), F.when(F.col("doc_id") % 7 != 0, tr.contaminated(F.col("text"))).alias("contaminated")), """
SELECT doc_id, doc_id % 9 IN (0, 1) AS degenerate, regexp_matches(substr(text, 1, 12000), '(?i)\\bReferences\\b') OR regexp_matches(substr(text, 1, 12000), '\\[\\d{1,3}\\].{10,}https?://') AS references_heavy,
  CASE WHEN text = '' THEN true WHEN regexp_matches(text, '(?m)^#{1,4}\\s') OR regexp_matches(text, '(?m)^\\|[^\\n]+\\|') OR length(text) < 800 THEN false ELSE (length(text) > 3000 AND len(regexp_extract_all(text, '\\n')) < greatest(8, floor(length(text) / 800.0))) OR (length(text) > 5000 AND len(regexp_extract_all(text, '\\n\\n')) < 6) OR regexp_matches(text, 'DOC:PAGE:\\d{4} -->[^\\n]{40,}') OR (regexp_matches(text, '\\d+\\.\\d+\\s{2,}[A-Z]') AND len(regexp_extract_all(text, '\\n\\n')) < 10) END AS lacks_structure,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 = 0 END AS contaminated FROM src""")
_add("f03_best_transcript", lambda d: pg.best_transcript(d.withColumn("source", F.lit("b")).select("doc_id", "source", "text").unionByName(d.select("doc_id", F.lit("a").alias("source"), F.regexp_replace("text", "[#|]", "").alias("text")))))
_add("h33_directions", lambda d: d.select("doc_id", tr.directions(F.col("text"))[0].alias("maximum"), tr.directions(F.col("text"))[1].alias("minimum"), tr.direction_conflict(F.col("text"), F.expr("if(doc_id % 2 = 0, 'arg min x', 'max y')"), F.expr("if(doc_id % 3 = 0, 'minimum', '')")).alias("conflict")), r"""
, f AS (SELECT doc_id, regexp_matches(text, '(?i)\\max(?:\b|_)|\bmaxim(?:is|um|ize|ise)\b|\bmax\b|arg\s*\\?max|argmax|r\s*\^\s*\{?\s*\*') AS hi, regexp_matches(text, '(?i)\\min(?:\b|_)|\bminim(?:is|um|ize|ise)\b|\bmin\b|arg\s*\\?min|argmin') AS lo FROM src)
SELECT doc_id, hi AS maximum, lo AS minimum, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 <> 0 ELSE (hi AND doc_id % 2 = 0) OR (lo AND doc_id % 2 <> 0) END AS conflict FROM f""")
# ASCII only: RE2 sees a word boundary at an accented letter, Java does not
_add("h62_anchors", lambda d: d.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " ")).select("doc_id", tr.anchors(F.col("text")).alias("a"), F.regexp_replace("text", "[eE]n", "").alias("t")).select("doc_id", F.array_join("a", "|").alias("anchors"), F.size(tr.missing_anchors(F.col("a"), F.col("t"))).cast("long").alias("n_missing")), r"""
, u AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM src), t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM u),
f AS (SELECT *, regexp_extract_all(t, '(?i)\b0\.\d{2,}\b|\b[1-9]\d*\.\d+\b|\b\d+\.\d+%\b|\bN\s*=\s*[\d,]+\b|(?:Eq\.|Equation)\s*\(?\d+\)?|(?:Table|Fig\.|Figure)\s+\d+') AS k, regexp_extract_all(t, '\b[A-Za-z][A-Za-z0-9\-]{5,}\b') AS w FROM t WHERE length(t) >= 80),
e AS (SELECT doc_id, lower(trim(x)) AS x, 0 AS kind, pos FROM (SELECT doc_id, unnest(k) AS x, generate_subscripts(k, 1) AS pos FROM f) UNION ALL SELECT doc_id, lower(x), 1, pos FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM f) WHERE regexp_matches(x, '[A-Za-z]{3,}') AND lower(x) NOT IN (SELECT unnest(string_split('""" + " ".join(tr.ANCHOR_STOP_WORDS) + r"""', ' ')))),
g AS (SELECT doc_id, x, min(kind * 1000000000 + pos) AS place FROM e WHERE NOT regexp_matches(x, '(?i)^(?:\d{7}\.\d{7}|\d{4}|\[\d{1,3}\]|10\.\d+.*|\d{1,4})$') AND length(x) >= 3 GROUP BY doc_id, x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place >= 1000000000 ORDER BY place) AS n, count(*) FILTER (place < 1000000000) OVER (PARTITION BY doc_id) AS numbers FROM g),
l AS (SELECT r.doc_id, r.x, r.place, contains(lower(regexp_replace(text, '[eE]n', '', 'g')), x) OR (regexp_matches(x, '\d') AND contains(regexp_replace(lower(regexp_replace(text, '[eE]n', '', 'g')), '[,\s]', '', 'g'), regexp_replace(x, '[,\s]', '', 'g'))) AS there FROM r JOIN u USING (doc_id) WHERE place < 1000000000 OR n <= greatest(1, 48 - numbers))
SELECT doc_id, coalesce(string_agg(x, '|' ORDER BY place), '') AS anchors, count(*) FILTER (NOT there) AS n_missing FROM (SELECT doc_id FROM src) LEFT JOIN l USING (doc_id) GROUP BY doc_id""")
_add("l22_cleaned", lambda d: d.select("doc_id", tr.cleaned(F.col("text")).alias("cleaned"), tr.repaired_prose(F.col("text")).alias("repaired")), r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<!--\s*DOC:PAGE(?:_END)?:(\d{4})\s*-->', '', 'g'), '(?m)^\s*---+\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS cleaned,
  regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '(\d+),\$(\d{3})\b', '\1,\2', 'g'), '(\d+)\$,(\d{3})\b', '\1,\2', 'g'), chr(92) || '_', '_'), '\b([A-Za-z]+)\s+fi\s+([A-Za-z]+)\b', '\1fi\2', 'g'), '\n\n(\d{1,2})\n\n', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS repaired FROM src""")
_add("h49_math_density", lambda d: d.select("doc_id", tr.math_density(F.col("text")).alias("density"), tr.severity_risk(F.col("doc_id") % 7).alias("risk"), tr.release_failures(F.col("text")).alias("failures"), tr.figure_errors(F.col("text"))[0].alias("unreplaced"), tr.figure_errors(F.col("text"))[1].alias("uncovered")), r"""
, t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM src) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE least(1, len(regexp_extract_all(t, '[=+^_\\{}<>∑∫≤≥]')) / greatest(8.0, length(t) / 12.0)::DOUBLE) END AS density, 1 - 1 / (1 + (doc_id % 7) / 12.0::DOUBLE) AS risk,
  len(regexp_extract_all(text, 'formula-not-decoded')) + len(regexp_extract_all(text, '\$')) % 2 AS failures, len(regexp_extract_all(text, '<!--\s*DOC:FIGURE:p(\d{4}):f(\d{2})\s*-->')) AS unreplaced, greatest(0, len(regexp_extract_all(text, '(?im)^\s*\*{0,2}\s*(?:Figure|Fig\.?)\s*\d+')) - len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'))) AS uncovered FROM t""")
_add("h93_captions", lambda d: d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", tr.caption(F.col("line")).alias("c")).where("c is not null").select("doc_id", "pos", "c.label", "c.number", "c.body"), r"""
, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src) SELECT doc_id, pos::INT AS pos, regexp_extract(line, '(?i)^\s*\*{0,2}\s*((Figure|Fig\.?)\s*(S?\d+))\s*[.:=-]?\s*(.*?)\s*\*{0,2}\s*$', 1) AS label,
  regexp_extract(line, '(?i)^\s*\*{0,2}\s*((Figure|Fig\.?)\s*(S?\d+))\s*[.:=-]?\s*(.*?)\s*\*{0,2}\s*$', 3) AS number, regexp_extract(line, '(?i)^\s*\*{0,2}\s*((Figure|Fig\.?)\s*(S?\d+))\s*[.:=-]?\s*(.*?)\s*\*{0,2}\s*$', 4) AS body FROM l WHERE regexp_matches(line, '(?im)^\s*\*{0,2}\s*(?:Figure|Fig\.?)\s*\d+')""")
_add("h95_subfigure_index", lambda d: d.select("doc_id", tr.subfigure_index(F.expr("element_at(array('a', 'C', 'iv', '7', 'x', 'zz'), cast(doc_id % 6 + 1 as int))")).alias("n")), "SELECT doc_id, [1, 3, 4, 7, 10, NULL][doc_id % 6 + 1]::BIGINT AS n FROM src")
_add("b39_prompt_like", lambda d: d.select("doc_id", tr.prompt_like(F.col("text"), ("Sidebar", "Seven", "DOC:PAGE:")).alias("prompt")), "SELECT doc_id, contains(text, 'Sidebar')::INT + contains(text, 'Seven')::INT + contains(text, 'DOC:PAGE:')::INT >= 2 AND length(text) < 4500 AS prompt FROM src")
_add("h65_from_first_page", lambda d: d.select("doc_id", tr.from_first_page(F.col("text")).alias("body")), r"SELECT doc_id, CASE WHEN regexp_matches(text, '<!--\s*DOC:PAGE:\d{4}') THEN regexp_extract(text, '(?s)(<!--\s*DOC:PAGE:\d{4}\s*-->.*)$', 1) ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS body FROM src")
