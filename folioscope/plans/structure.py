"""Queries over blocks, LaTeX, boxes and matching, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import boxes as bx
from folioscope.functions import latex as lx
from folioscope.operators import blocks as bl
from folioscope.operators import matching as mt
from folioscope.plans.documents import _SRC, markdown
from folioscope.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None, source=markdown, prefix: str = _SRC) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = prefix + sql


# ---- blocks ---------------------------------------------------------------------------------------------------------
_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src),
f AS (SELECT *, sum((trim(line) = '$$')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM l),
k AS (SELECT *, CASE WHEN trim(line) = '$$' THEN 'fence' WHEN f % 2 = 1 THEN 'formula' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '(?i)^\s*(?:PAGE\s+\d+|<!--\s*PAGE\s+\d+\s*-->)\s*$') THEN 'page' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading'
  WHEN regexp_matches(line, '^\|.*\|') THEN 'table' WHEN regexp_matches(line, '!\[[^\]]*\]\([^)]+\)') THEN 'figure' ELSE 'text' END AS kind FROM f),
t AS (SELECT doc_id, pos, line, kind, last_value(CASE WHEN kind = 'page' THEN regexp_extract(line, '(\d+)', 1)::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM k)"""
_BLOCKS = f"""{_LINES}, n AS (SELECT *, sum(CASE WHEN coalesce(kind <> lag(kind) OVER w OR kind = 'heading' OR pos <> lag(pos) OVER w + 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ord0
  FROM (SELECT * FROM t WHERE kind NOT IN ('blank', 'fence', 'page')) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_BLOCKS = f"""{_LINES}, m AS (SELECT *, coalesce(kind <> lag(kind) OVER w OR kind = 'heading' OR pos <> lag(pos) OVER w + 1, true)::INT AS cut FROM t WHERE kind NOT IN ('blank', 'fence', 'page') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM m), b AS (SELECT doc_id, ord::BIGINT AS ord, first(kind ORDER BY pos) AS kind, min(page) AS page, string_agg(line, chr(10) ORDER BY pos) AS content FROM n GROUP BY doc_id, ord)"""
_add("a03_typed_lines", bl.typed_lines, f", {_LINES} SELECT * FROM t")
_add("a03_blocks", bl.blocks, f", {_BLOCKS} SELECT * FROM b")
_add("c19_captions", bl.captions, rf""", {_LINES}, i AS (SELECT doc_id, pos AS image FROM l WHERE regexp_matches(line, '^\s*!\[[^\]]*\]\([^)]+\)\s*$')), c AS (SELECT doc_id, pos AS at, regexp_extract(line, '(\d+)', 1)::INT AS figure FROM l WHERE regexp_matches(line, '(?i)^\s*\*{{0,2}}\s*(?:Figure|Fig\.?)\s*\d+'))
SELECT doc_id, image, "at", figure FROM i JOIN c USING (doc_id) WHERE abs(image - "at") <= 6 QUALIFY row_number() OVER (PARTITION BY doc_id, image ORDER BY abs(image - "at"), "at") = 1""".replace("pos AS at", 'pos AS "at"'))
_add("c17_caption_relations", lambda d: bl.caption_relations(bl.blocks(d)), rf""", {_BLOCKS}, x AS (SELECT doc_id, ord, kind, lead(kind) OVER w AS nk, lead(content) OVER w AS nc, lead(ord) OVER w AS no FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, no AS source_ord, ord AS target_ord FROM x WHERE kind IN ('figure', 'table') AND nk = 'text' AND regexp_matches(nc, '(?im)^\s*\*{{0,2}}\s*(?:Figure|Fig\.?)\s*\d+')""")
_add("l05_table_issues", lambda d: bl.table_issues(bl.blocks(d)), f""", {_BLOCKS}, c AS (SELECT doc_id, ord, list_transform(string_split(content, chr(10)), lambda x: len(x) - len(replace(x, '|', ''))) AS n FROM b WHERE kind = 'table')
SELECT doc_id, ord, len(n) AS rows, list_min(n) <> list_max(n) AS uneven, len(n) < 2 OR list_max(n) - list_min(n) >= 2 AS broken FROM c""")
_add("l01_rewrite_rules", bl.rewritten, None)
_add("a26_merge_turns", lambda d: bl.merged(d, "conv_id", "turn", "text"), "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id", lambda s, d: load(s, d, "conversations").where("text is not null"), "")
_add("e26_plan_batches", lambda d: bl.batches(d, "pages", 10), "SELECT doc_id, start_page::INT AS start_page, least(start_page + 9, n_chars // 200)::INT AS end_page FROM (SELECT doc_id, n_chars, unnest(range(1, n_chars // 200 + 1, 10)) AS start_page FROM documents WHERE n_chars >= 200)",
     lambda s, d: load(s, d, "documents").select("doc_id", F.expr("n_chars div 200").alias("pages")), "")
_add("k16_images", lambda d: bl.lines(d).select("doc_id", "pos", F.regexp_extract("line", r"!\[([^\]]*)\]\(([^)]+)\)", 2).alias("path")).where("path <> ''"), rf", {_LINES} SELECT doc_id, pos, regexp_extract(line, '!\[([^\]]*)\]\(([^)]+)\)', 2) AS path FROM l WHERE regexp_extract(line, '!\[([^\]]*)\]\(([^)]+)\)', 2) <> ''")
_add("k15_parameter_matrix", lambda d: d.select("doc_id", F.explode(F.array(*map(F.lit, (2, 3)))).alias("scale")).select("*", F.explode(F.array(*map(F.lit, ("a", "b")))).alias("prep")).select("*", F.explode(F.array(*map(F.lit, ("x", "y", "z")))).alias("model")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("cut")), "SELECT doc_id, scale, prep, model, cut FROM documents, (VALUES (2), (3)) s(scale), (VALUES ('a'), ('b')) p(prep), (VALUES ('x'), ('y'), ('z')) m(model), (VALUES (true), (false)) c(cut)", prefix="")

# ---- LaTeX ----------------------------------------------------------------------------------------------------------
_TEX = """concat(CASE WHEN doc_id % 2 = 0 THEN '$$ ' ELSE '' END, chr(92), 'mathbf{', lang, '}_{', doc_id % 5, '} = ', chr(92), CASE WHEN doc_id % 3 = 0 THEN 'dfrac{a}{b}' ELSE 'left(x + y' || chr(92) || 'right)' END, CASE WHEN doc_id % 7 = 0 THEN ' {' ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN concat(' ', chr(92), 'tag{', doc_id % 9, '}') WHEN doc_id % 4 = 1 THEN concat(' (', doc_id % 9, ').') ELSE ' ,' END, CASE WHEN doc_id % 2 = 0 THEN ' $$' ELSE '' END)"""
_TEX2 = _TEX.replace("doc_id % 5", "doc_id % 10 % 5").replace("'mathbf{'", "CASE WHEN doc_id % 6 = 5 THEN 'mathcal{' ELSE 'mathrm{' END")
_T = f"WITH s AS (SELECT doc_id, {_TEX} AS tex, {_TEX2} AS tex2 FROM documents) "


def _tex(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.expr(_TEX).alias("tex"), F.expr(_TEX2).alias("tex2"))


def _canon(c: str) -> str:
    """The canonical form in DuckDB; one level of fonts, which is all that these inputs nest."""
    x = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    for pattern in (r"\$", r"\\tag\*?\{[^}]*\}|\\eqno\b\s*(?:\([^)]*\)|\d+)?"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = rf"regexp_replace({x}, '\\(?:mathrm|operatorname|mathbf|boldsymbol|mathit|mathtt|textrm|textbf|text)\s*\{{([^{{}}]*)\}}', '\1', 'g')"
    x = rf"replace(replace(regexp_replace({x}, '\\(?:left|right|big|Big|bigg|Bigg)\s*', '', 'g'), chr(92) || 'dfrac', chr(92) || 'frac'), chr(92) || 'tfrac', chr(92) || 'frac')"
    x = rf"regexp_replace(regexp_replace({x}, '\\(?:quad|qquad|,|;|!)\b|~+', '', 'g'), '[{{}}&]|\s+', '', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '^(.*=.*)[\(]\d{{1,3}}[a-zA-Z]?[\)]\.?$', '\1'), '[.,]+$', '')"


_C = f"{_T}, c AS (SELECT *, {_canon('tex')} AS ca, {_canon('tex2')} AS cb FROM s) "
_add("h01_canonical", lambda d: d.select("doc_id", lx.canonical(F.col("tex")).alias("canonical"), F.size(lx.tokens(F.col("tex"))).cast("long").alias("n_tokens")),
     _C + r"SELECT doc_id, ca AS canonical, len(regexp_extract_all(ca, '\\[a-zA-Z]+|[{}\[\]()^_=+\-*/,]|[A-Za-z0-9]+|\\.|.')) AS n_tokens FROM c", _tex, "")
_add("j03_consensus", lambda d: d.select("doc_id", lx.consensus(F.col("tex"), F.col("tex2")).alias("decision")), _C + "SELECT doc_id, CASE WHEN ca = cb THEN 'ACCEPT' ELSE 'DISAGREE' END AS decision FROM c", _tex, "")
_add("h09_structure", lambda d: d.select("doc_id", *[c.alias(n) for n, c in lx.structure(F.col("tex")).items()]), _T + r"""SELECT doc_id, len(regexp_extract_all(tex, '\\frac\b|\\over\b')) AS n_frac, len(regexp_extract_all(tex, '[_^]')) AS n_scripts, len(regexp_extract_all(tex, '\\begin\{(?:align|aligned|split|gather)')) AS n_align,
  len(regexp_extract_all(tex, '\\(?:sum|prod|int|oint|lim)\b')) AS n_sum, len(regexp_extract_all(tex, '\\(?:mathbf|mathcal|mathrm|boldsymbol|mathscr)\b')) AS n_fonts FROM s""", _tex, "")
_add("h17_signatures", lambda d: d.select("doc_id", lx.compact(F.col("tex")).alias("compact"), lx.signature(F.col("tex")).alias("signature"), lx.left_side(lx.signature(F.col("tex"))).alias("lhs"), lx.gold_match(F.col("tex"), F.col("tex2")).alias("gold_match")),
     _T + r""", c AS (SELECT doc_id, regexp_replace(tex, '\$|\s+', '', 'g') AS compact, regexp_replace(tex2, '\$|\s+', '', 'g') AS c2, lower(regexp_replace(tex, '\$|\s+|\\left|\\right', '', 'g')) AS signature FROM s)
SELECT doc_id, compact, signature, CASE WHEN contains(signature, '=') THEN split_part(signature, '=', 1) ELSE '' END AS lhs, CASE WHEN compact = c2 OR contains(compact, c2) OR contains(c2, compact) THEN 'yes' ELSE 'no' END AS gold_match FROM c""", _tex, "")  # fmt: skip
_add("h06_braces", lambda d: d.select("doc_id", lx.braces_ok(F.col("tex")).alias("braces_ok"), lx.unbalanced(F.col("tex")).alias("unbalanced"), lx.prose_like(F.col("tex")).alias("prose_like")),
     _T + "SELECT doc_id, len(tex) - len(replace(tex, '{', '')) = len(tex) - len(replace(tex, '}', '')) AS braces_ok, len(tex) - len(replace(tex, '{', '')) <> len(tex) - len(replace(tex, '}', '')) AS unbalanced, false AS prose_like FROM s", _tex, "")
_add("h24_tagged_block", lambda d: d.select("doc_id", lx.display_block(lx.with_tag(F.col("tex"), (F.col("doc_id") % 3).cast("string"))).alias("block")),
     _T + r"SELECT doc_id, '$$' || chr(10) || trim(CASE WHEN contains(tex, chr(92) || 'tag{') THEN tex ELSE trim(tex) || ' ' || chr(92) || 'tag{' || (doc_id % 3) || '}' END) || chr(10) || '$$' AS block FROM s", _tex, "")
_add("h61_preservation", lambda d: d.select("doc_id", lx.word_chars(F.col("text")).cast("long").alias("raw"), lx.drop_ratio(F.col("text"), F.col("cleaned")).alias("drop_ratio"), (lx.drop_ratio(F.col("text"), F.col("cleaned")) <= 0.12).alias("ok"), lx.content_hash(F.col("text")).alias("hash")),
     r"""WITH s AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS raw, length(regexp_replace(regexp_replace(text, '[a-e]', '', 'g'), '[^\p{L}\p{N}_]', '', 'g')) AS clean FROM documents), r AS (SELECT *, CASE WHEN raw <= 0 THEN 0 ELSE greatest(0, (raw - clean)::DOUBLE / raw) END AS drop_ratio FROM s)
SELECT doc_id, raw, drop_ratio, drop_ratio <= 0.12 AS ok, left(sha256(text), 16) AS hash FROM r""", lambda s, d: load(s, d, "documents").select("doc_id", "text", F.regexp_replace("text", "[a-e]", "").alias("cleaned")), "")  # fmt: skip
_add("g01_jaccard", lambda d: d.select("doc_id", lx.jaccard(F.array_distinct(F.split("text", " ")), F.array_distinct(F.split(F.replace("text", F.lit("en"), F.lit("an")), " "))).alias("overlap"), lx.stream_percent(10.0, 80.0, F.col("n_chars")).alias("percent")),
     """WITH s AS (SELECT doc_id, n_chars, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(replace(text, 'en', 'an'), ' ')) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS overlap, 10 + 80.0 * n_chars / (n_chars + 400) AS percent FROM s""", lambda s, d: load(s, d, "documents"), "")  # fmt: skip

# ---- boxes ----------------------------------------------------------------------------------------------------------
_XY = {"x0": "l_partkey % 600", "y0": "l_suppkey % 90 * 8", "x1": "l_partkey % 600 + l_quantity", "y1": "l_suppkey % 90 * 8 + l_discount * 100"}
_XY2 = {"x0": "l_partkey % 550", "y0": "l_suppkey % 70 * 8", "x1": "l_partkey % 550 + l_tax * 900", "y1": "l_suppkey % 70 * 8 + 12"}


def _boxes(spark, sf_dir):
    box = lambda xy: F.struct(*[F.expr(f"cast({e} as double)").alias(n) for n, e in xy.items()])
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box(_XY).alias("a"), box(_XY2).alias("b"))


_B = "WITH s AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({e} AS DOUBLE) AS {p}{n}" for p, xy in (("a", _XY), ("b", _XY2)) for n, e in xy.items()) + " FROM lineitem) "
_add("i01_box_overlap", lambda d: d.select("l_orderkey", "l_linenumber", *[f(F.col("a"), F.col("b")).alias(n) for n, f in (("h", bx.h_overlap), ("v", bx.v_overlap), ("gap", bx.v_gap), ("hits", bx.hits_seed))], bx.area(F.col("a")).alias("area")), _B + """SELECT l_orderkey, l_linenumber,
  greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) AS h, greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS v, CASE WHEN ay1 < by0 THEN by0 - ay1 WHEN by1 < ay0 THEN ay0 - by1 ELSE 0 END AS gap,
  least(ax1, bx1 + 4) - greatest(ax0, bx0 - 4) > 0 AND least(ax1, bx1 + 4) - greatest(ax0, bx0 - 4) >= least(6, 0.2 * greatest(1, ax1 - ax0)) AS hits, greatest(0, ax1 - ax0) * greatest(0, ay1 - ay0) AS area FROM s""", _boxes, "")
_add("i20_box_predicates", lambda d: d.select("l_orderkey", "l_linenumber", bx.same_column(600.0, F.col("a"), F.col("b")).alias("same_column"), bx.display_number(600.0, F.col("a")).alias("display_number"), bx.right_bias(F.col("a")).alias("bias"), F.array_join(bx.issues(F.col("a"), F.col("l_linenumber"), 600.0, 760.0), ",").alias("issues")), _B + """SELECT l_orderkey, l_linenumber,
  (ax0 >= 288) = (bx0 >= 288) AS same_column, CASE WHEN greatest(1, ax1 - ax0) > 72 THEN false WHEN ax0 >= 288 THEN ax0 >= 420 ELSE ax1 >= 276 END AS display_number, CASE WHEN ax0 >= 350 THEN 0.12::DOUBLE WHEN ax0 >= 250 THEN 0.06::DOUBLE ELSE 0 END AS bias,
  array_to_string(list_filter([CASE WHEN l_linenumber IS NULL THEN 'missing_page' END, CASE WHEN ax1 <= ax0 OR ay1 <= ay0 THEN 'degenerate_bbox' END, CASE WHEN ax0 < 4 OR ax1 > 596 THEN 'bbox_near_x_edge' END, CASE WHEN ay0 < 4 OR ay1 > 756 THEN 'bbox_near_y_edge' END], lambda x: x IS NOT NULL), ',') AS issues FROM s""", _boxes, "")
_add("i08_box_union", lambda d: d.groupBy("l_orderkey").agg(F.min("a.x0").alias("x0"), F.min("a.y0").alias("y0"), F.max("a.x1").alias("x1"), F.max("a.y1").alias("y1")), _B + "SELECT l_orderkey, min(ax0) AS x0, min(ay0) AS y0, max(ax1) AS x1, max(ay1) AS y1 FROM s GROUP BY l_orderkey", _boxes, "")

# ---- matching and ladders -------------------------------------------------------------------------------------------
_ERR = "CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'CUDA error' WHEN 2 THEN 'Out of Memory' WHEN 3 THEN 'request timed out' WHEN 4 THEN 'model load failed' WHEN 5 THEN 'RuntimeError: x' WHEN 6 THEN 'backend gone' WHEN 7 THEN 'formula_not_found' ELSE 'other' END"
_add("b47_error_class", lambda d: d.select("doc_id", mt.error_class(F.expr(_ERR), F.col("doc_id") % 20 == 0).alias("class")), """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN CASE WHEN doc_id % 20 = 0 THEN 'ok' ELSE 'result_bad' END WHEN 1 THEN 'device_error' WHEN 2 THEN 'oom' WHEN 3 THEN 'timeout' WHEN 4 THEN 'load_error' WHEN 5 THEN 'runtime_error' WHEN 6 THEN 'unavailable' ELSE 'result_bad' END AS class FROM documents""", prefix="")
_REASON = "CASE doc_id % 9 WHEN 0 THEN 'ocr_context_conflict' WHEN 1 THEN 'x, ocr_context_insufficient' WHEN 2 THEN 'identity_unresolved' WHEN 3 THEN 'multi_formula_alignment_ambiguous' WHEN 4 THEN 'empty|y' WHEN 5 THEN 'no_significant_gain' WHEN 6 THEN 'empty' ELSE '' END"
_add("b44_failure_class", lambda d: d.select("doc_id", mt.failure_class(F.expr(_REASON), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'a = b' WHEN doc_id % 4 = 1 THEN 'abc' ELSE '' END"), F.expr("CASE WHEN doc_id % 11 = 0 THEN 'z' ELSE '' END"), F.col("doc_id") % 22 == 0).alias("class")), """SELECT doc_id, CASE WHEN doc_id % 22 = 0 THEN 'accepted' WHEN doc_id % 9 = 0 THEN 'context_strong_conflict' WHEN doc_id % 9 = 1 THEN 'context_insufficient' WHEN doc_id % 9 = 2 THEN 'identity_failure' WHEN doc_id % 9 = 3 THEN 'alignment_failure'
  WHEN doc_id % 9 IN (4, 6) THEN CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN 'extraction_failure' ELSE 'recognition_failure' END WHEN doc_id % 9 = 5 THEN 'validation_failure' ELSE 'unknown' END AS class FROM documents""", prefix="")
_flag = lambda n: F.col("doc_id") % n != 0
_add("b52_failure_layer", lambda d: d.select("doc_id", mt.layer(_flag(11), _flag(7), _flag(5), _flag(3), _flag(2), F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") % 4 < 2), F.col("doc_id") % 6 < 4, F.col("doc_id") % 8 < 5).alias("layer")), """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'DETECTION_FAILURE' WHEN doc_id % 7 = 0 THEN 'GEOMETRY_FAILURE' WHEN doc_id % 5 = 0 THEN 'CROP_CLIPPED'
  WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 13 <> 0 AND doc_id % 4 < 2 AND doc_id % 6 >= 4 THEN 'GATE_FALSE_ACCEPT' ELSE 'OCR_FAILURE' END WHEN doc_id % 2 <> 0 AND doc_id % 13 <> 0 AND doc_id % 4 >= 2 THEN 'GATE_FALSE_REJECT' WHEN doc_id % 13 <> 0 AND doc_id % 4 < 2 AND doc_id % 6 >= 4 THEN 'GATE_FALSE_ACCEPT'
  WHEN doc_id % 13 <> 0 AND doc_id % 4 < 2 AND doc_id % 8 >= 5 THEN 'WRITEBACK_FAILURE' WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 AND doc_id % 6 < 4 THEN 'POSTPROCESS_FAILURE' WHEN doc_id % 2 <> 0 THEN 'OK' ELSE 'OCR_FAILURE' END AS layer FROM documents""", prefix="")
_add("b42_action", lambda d: d.select("doc_id", mt.action(F.expr("CASE doc_id % 5 WHEN 0 THEN 'clipboard_stale' WHEN 1 THEN 'GENERATION_INCOMPLETE' WHEN 2 THEN 'extraction_conflict' WHEN 3 THEN 'MODEL_DEGENERATION' END")).alias("action")), "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'recopy' WHEN 1 THEN 'continue' WHEN 2 THEN 'page_retry' ELSE 'full_batch' END AS action FROM documents", prefix="")


def _sides(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    probe = o.select(F.col("o_orderkey").alias("pid"), F.expr("if(o_orderkey % 2 = 0, o_orderkey, null)").alias("k1"), F.expr("if(o_orderkey % 3 = 0, -o_custkey, o_custkey)").alias("k2"))
    return mt.cascade(probe, o.select(F.expr("if(o_orderkey % 4 <> 1, o_orderkey, -o_orderkey)").alias("bid"), F.expr("if(o_orderkey % 4 <> 1, o_orderkey, -o_orderkey)").alias("k1"), F.col("o_custkey").alias("k2")), "pid", [("k1",), ("k2",)], "bid", "bid")


_add("c02_cascade", lambda d: d, """WITH p AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS k1, CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS k2 FROM orders), b AS (SELECT CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey ELSE -o_orderkey END AS bid, o_custkey AS k2 FROM orders),
c AS (SELECT k2, min(bid) AS m FROM b GROUP BY k2), j AS (SELECT pid, coalesce(bid, m) AS "match", CASE WHEN bid IS NOT NULL THEN 0 ELSE 1 END AS tier FROM p LEFT JOIN b ON p.k1 = b.bid LEFT JOIN c ON p.k2 = c.k2)
SELECT pid, "match", tier FROM j WHERE "match" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "match" ORDER BY tier, pid) = 1""", _sides, "")
_add("c12_enriched", lambda d: d, """SELECT doc_id, lang, quality, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END AS doc_id) FROM documents) d FULL JOIN labels l USING (doc_id)""".replace("SELECT doc_id, lang, quality", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality").replace("USING (doc_id)", "ON d.doc_id = l.doc_id"),
     lambda s, d: mt.enriched(load(s, d, "documents").select(F.expr("if(doc_id % 2 = 0, doc_id, -doc_id)").alias("doc_id"), "lang"), load(s, d, "labels").select("doc_id", "quality"), "doc_id"), "")
_add("c08_latest_outcome", lambda d: mt.latest(d, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", lambda s, d: load(s, d, "orders"), "")
