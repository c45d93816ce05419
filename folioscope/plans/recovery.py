"""Queries over recovery steps and page lines, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import layout as ly
from folioscope.operators import clusters as cl
from folioscope.operators import recovery as rv
from folioscope.plans.transcripts import _SRC as _TRANSCRIPTS
from folioscope.plans.transcripts import transcripts
from folioscope.sources.tables import ATTEMPTS_SQL, attempts, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_e, _c = F.expr, F.col


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _split(columns: str) -> list[str]:
    """Select items of a list whose items all end in AS name."""
    items, held = [], ""
    for part in columns.split(", "):
        held = f"{held}, {part}" if held else part
        if " AS " in part and part.rsplit(" AS ", 1)[1].isidentifier():
            items.append(held)
            held = ""
    return items


#: A key of lineitem within its order.
_ORD = "l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey"

# ---- Steps, anomalies, routes: flags made from keys, the same in both languages

_FLAGS = "o_orderkey % 2 = 0 AS f2, o_orderkey % 3 = 0 AS f3, o_orderkey % 5 = 0 AS f5, o_custkey % 2 = 0 AS g2, o_custkey % 3 = 0 AS g3, o_custkey % 7 AS g7, o_orderkey % 11 AS k11, o_orderkey % 4 AS k4"


def _flags(s, d):
    return load(s, d, "orders").selectExpr("o_orderkey", *_FLAGS.split(", "))


_FL = f"WITH f AS (SELECT o_orderkey, {_FLAGS} FROM orders), "


def _step(s, d):
    rows = _flags(s, d).withColumn("pages", _e("filter(sequence(1, 7), x -> (k11 + x * x) % 4 < 2 and x > k4)")).withColumn("retried", _e("filter(pages, x -> x % 3 = g7 % 3 and f5)"))
    step = rv.next_step(_e("if(k11 = 9, 'MODEL_DEGENERATION', 'OTHER')"), _e("if(k11 = 8, 'recopy', 'page_retry')"), _c("k11") == 7, _c("k11") == 6, _c("pages"), _c("retried"), _c("f2"), _c("f3"), _c("g2"), _c("g3"), _c("g7"))
    return rows.select("o_orderkey", step.alias("s")).selectExpr("o_orderkey", "s.action", "array_join(s.pages, ',') as pages")


_add("b43_next_step", _step, _FL + """p AS (SELECT *, list_filter(range(1, 8), lambda x: (k11 + x * x) % 4 < 2 AND x > k4) AS pages FROM f), r AS (SELECT *, list_filter(pages, lambda x: x % 3 = g7 % 3 AND f5) AS retried FROM p),
d AS (SELECT *, CASE WHEN f3 AND len(retried) = 0 THEN pages ELSE retried END AS done FROM r), n AS (SELECT *, list_filter(pages, lambda x: NOT list_contains(done, x)) AS pending FROM d), t AS (SELECT *, CASE WHEN len(pending) > 0 THEN pending WHEN f3 AND NOT g2 THEN pages ELSE [] END AS target FROM n),
a AS (SELECT *, CASE WHEN k11 = 9 THEN 'full_batch' WHEN k11 = 7 AND NOT g3 THEN 'format_fix' WHEN k11 = 8 AND NOT f2 THEN 'recopy' WHEN k11 = 6 THEN 'accept_warnings' WHEN len(pending) BETWEEN 1 AND 3 THEN 'page_retry'
  WHEN NOT g2 AND len(target) BETWEEN 2 AND 5 AND list_max(target) - list_min(target) + 1 = len(target) THEN 'sub_batch' WHEN g7 >= 2 THEN 'full_batch' WHEN len(pending) > 0 THEN 'page_retry' ELSE 'full_batch' END AS action FROM t)
SELECT o_orderkey, action, array_to_string(CASE action WHEN 'full_batch' THEN pages WHEN 'sub_batch' THEN target WHEN 'page_retry' THEN pending[1:3] ELSE [] END, ',') AS pages FROM a""")  # fmt: skip

_CLASS = "CASE k11 WHEN 0 THEN 'context_strong_conflict' WHEN 1 THEN 'extraction_failure' WHEN 2 THEN 'validation_failure' WHEN 3 THEN 'identity_failure' WHEN 4 THEN 'alignment_failure' WHEN 5 THEN 'recognition_failure' WHEN 6 THEN '' WHEN 7 THEN 'context_insufficient' WHEN 8 THEN 'odd' WHEN 9 THEN 'extraction_failure' ELSE ' validation_failure ' END"
_GATE = "CASE g7 WHEN 0 THEN 'ocr_context_conflict' WHEN 1 THEN 'no_significant_gain' WHEN 2 THEN 'ocr_truncated,no_significant_gain' WHEN 3 THEN 'x_insufficient' ELSE '' END"
_SKIP = "CASE WHEN k4 = 3 AND f5 THEN 'candidate_page_mismatch' WHEN k4 = 2 AND f5 THEN 'semantic_context_conflict:a' ELSE '' END"


def _anomaly(s, d):
    a = rv.anomaly(_e(_CLASS), _e(_GATE), _e("if(f3, 'a = b', 'ab')"), _e("if(f2, 'x', ' ')"), _e(_SKIP), _e("if(g3, 'm', '')"), _c("k4") == 0, _c("g2"), _c("g3"))
    return _flags(s, d).select("o_orderkey", a.alias("a")).select("o_orderkey", "a.*")


_add("b48_anomaly", _anomaly, _FL + f"""v AS (SELECT *, CASE WHEN trim({_CLASS}) = '' THEN 'unknown' ELSE trim({_CLASS}) END AS c, {_GATE} AS gate, {_SKIP} AS skip, k4 = 0 AS acc FROM f),
a AS (SELECT *, CASE WHEN acc AND g2 THEN 0 WHEN c = 'context_strong_conflict' OR contains(gate, 'ocr_context_conflict') THEN 1 WHEN c = 'extraction_failure' AND f3 AND NOT f2 THEN 2 WHEN skip <> '' THEN 3
  WHEN f2 AND NOT acc AND g7 <> 2 AND (g7 IN (1, 3) OR c = 'validation_failure') THEN 4 WHEN c IN ('identity_failure', 'alignment_failure') THEN 5 WHEN c = 'recognition_failure' THEN 6 WHEN c = 'unknown' THEN 7
  WHEN c IN ('extraction_failure', 'validation_failure', 'context_insufficient') THEN 8 WHEN NOT acc THEN 9 ELSE 10 END AS r FROM v)
SELECT o_orderkey, r NOT IN (0, 10) AS is_anomaly, CASE r WHEN 1 THEN 'ocr_bad_output' WHEN 2 THEN 'extractor_missed_valid_raw' WHEN 3 THEN 'writeback_alignment_blocked' WHEN 4 THEN 'gate_false_negative' WHEN 5 THEN replace(c, 'failure', 'ambiguous') WHEN 6 THEN 'ocr_bad_output'
  WHEN 7 THEN 'unexpected_pipeline_state' WHEN 8 THEN 'recovery_' || c WHEN 9 THEN 'unexpected_pipeline_state' ELSE '' END AS anomaly,
  CASE WHEN r IN (2, 3, 4, 7) OR (r = 8 AND g3 AND NOT f2) THEN 'high' WHEN r IN (5, 6, 8) THEN 'medium' ELSE 'low' END AS actionability,
  CASE r WHEN 0 THEN 'accepted' WHEN 1 THEN 'strong_context_conflict_gate_ok' WHEN 2 THEN 'raw_mathy_but_no_latex' WHEN 3 THEN skip WHEN 4 THEN 'selected_cleanish_but_rejected' WHEN 7 THEN 'unknown_class' WHEN 8 THEN CASE WHEN g3 THEN 'm' ELSE c END WHEN 10 THEN 'skip' ELSE c END AS reason FROM a""")  # fmt: skip


def _route(s, d):
    score = _c("k11") / 10.0
    hard = rv.severe(_e("if(f5, repeat('\\\\quad ', 8), 'x')"), score, _c("g7") == 0)
    return _flags(s, d).select("o_orderkey", hard.alias("hard"), rv.model_route(hard, score, _e("if(k4 < 3, 'k5_specialist', 'legacy')"), _e("element_at(array('fast', 'quality', 'balanced'), cast(g7 % 3 + 1 as int))"), _c("f2"), _c("f3"), _c("g3"), _c("g2")).alias("route"))


_add("b57_model_route", _route, _FL + """h AS (SELECT *, k11 / 10.0 >= 0.8 OR f5 OR g7 = 0 AS hard, ['fast', 'quality', 'balanced'][g7 % 3 + 1] AS preset FROM f)
SELECT o_orderkey, hard, CASE WHEN k4 < 3 THEN CASE WHEN preset = 'fast' THEN CASE WHEN f2 THEN 'specialist_primary' ELSE 'abstain' END WHEN hard AND f3 THEN 'vlm_fallback' WHEN f2 THEN 'specialist_primary' WHEN f3 AND (preset = 'quality' OR NOT hard) THEN 'vlm_fallback' ELSE 'abstain' END
  WHEN f3 AND (g3 OR hard OR (g2 AND k11 >= 5)) THEN 'deepseek_direct' ELSE 'unimernet' END AS route FROM h""")  # fmt: skip

_REASON = "CASE k11 WHEN 0 THEN 'ocr_context_conflict' WHEN 1 THEN 'low_gain, x' WHEN 2 THEN 'ocr_empty' WHEN 3 THEN 'ocr_other' WHEN 4 THEN 'identity' WHEN 5 THEN 'no_bbox' WHEN 6 THEN '' ELSE 'other' END"
_CROP = "CASE g7 WHEN 0 THEN 'Likely_Prose' WHEN 1 THEN 'likely_too_small' ELSE 'formula' END"
_add(
    "b59_failure_stage",
    lambda s, d: _flags(s, d).select("o_orderkey", rv.failure_stage(_e("if(f5 and f3, 'known', '')"), _e(_REASON), _e("if(g7 = 2, 'crop_hits_a', 'writeback')"), _e(_CROP), _e("cast(k4 as int)"), ~_c("g3"), _e("cast(k11 as int)"), _e("if(f2, 'recovery_failed', 'new')")).alias("stage")),
    _FL + "x AS (SELECT 1) SELECT o_orderkey, CASE WHEN f5 AND f3 THEN 'known' WHEN k4 = 0 OR g3 THEN 'geometry' WHEN g7 IN (0, 2) THEN 'crop_prose' WHEN g7 = 1 THEN 'geometry' WHEN k11 IN (0, 1) THEN 'gate' WHEN k11 IN (2, 3) THEN 'ocr' WHEN k11 IN (4, 6) THEN 'writeback' WHEN k11 = 5 THEN 'ocr' WHEN f2 THEN 'gate' ELSE 'ocr' END AS stage FROM f",
)
_add(
    "b61_repair_method",
    lambda s, d: _flags(s, d).select("o_orderkey", rv.repair_method(_e("if(f3, 'unicode_math', 'hat_corruption')"), _c("k11") / 11.0, _e("if(k4 = 0, 'safe', 'smart')"), _c("g7") > 0, _c("g2"), _c("g3"), _c("f5")).alias("method")),
    _FL + "x AS (SELECT 1) SELECT o_orderkey, CASE WHEN g7 = 0 THEN 'keep' WHEN k4 = 0 THEN CASE WHEN f3 THEN 'safe' ELSE 'keep' END WHEN k11 / 11.0 < 0.20 THEN 'keep' WHEN k11 / 11.0 < 0.45 THEN CASE WHEN g2 THEN 'geometry' ELSE 'safe' END WHEN k11 / 11.0 < 0.70 THEN CASE WHEN g3 THEN 'vision' ELSE 'safe' END WHEN f5 THEN 'reasoning' WHEN g3 THEN 'vision' ELSE 'safe' END AS method FROM f",
)

# ---- Running scores and the memory of failures

_SCORED = "doc, ord, page, CASE WHEN event_id % 4 = 0 THEN '' ELSE class END AS source, event_id % 3 = 0 AS numbered, event_id % 5 = 0 AS accepted, CASE event_id % 3 WHEN 0 THEN 'extraction_failure' WHEN 1 THEN 'context_strong_conflict' ELSE NULL END AS class, ord / 10.0 AS score"
_add(
    "e10_running_score",
    lambda s, d: rv.running_scores(attempts(s, d).selectExpr("doc", "ord", "page", "case when event_id % 4 = 0 then '' else class end as source", "event_id % 3 = 0 as numbered", "event_id % 5 = 0 as accepted", "case event_id % 3 when 0 then 'extraction_failure' when 1 then 'context_strong_conflict' end as class", "cast(ord as double) / 10 as score")),
    f"""WITH {ATTEMPTS_SQL}, i AS (SELECT {_SCORED} FROM attempts), s AS (SELECT *, ord - 1 AS done, avg(accepted::INT) OVER p AS pr, count(*) OVER p AS pn, avg(accepted::INT) FILTER (numbered) OVER w AS nr, count(*) FILTER (numbered) OVER w AS nn,
  CASE WHEN source <> '' THEN avg(accepted::INT) OVER o END AS sr, coalesce(avg(accepted::INT) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.5) AS rr,
  ord - 1 - coalesce(max(ord) FILTER (class IS DISTINCT FROM 'extraction_failure') OVER w, 0) AS m, ord - 1 - coalesce(max(ord) FILTER (class IS DISTINCT FROM 'context_strong_conflict') OVER w, 0) AS c FROM i
  WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY doc, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY doc, source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT doc, ord, score, (CASE WHEN pr >= 0.5 THEN 0.55::DOUBLE + 0.35::DOUBLE * pr WHEN pr = 0 AND pn >= 2 THEN -0.45 ELSE 0 END) + (CASE WHEN numbered AND nr >= 0.5 THEN 0.5 WHEN numbered AND nr = 0 AND nn >= 2 THEN -0.35 ELSE 0 END) + (CASE WHEN sr >= 0.5 THEN 0.25 ELSE 0 END)
  + (CASE WHEN m < 2 THEN 0 WHEN numbered THEN -0.25 * least(3, m - 1) ELSE 0.35 END) + (CASE WHEN c < 2 THEN 0 WHEN numbered THEN 0.3 ELSE -0.4 END) + (CASE WHEN rr <= 0.2 AND done >= 3 AND numbered AND nr > 0 THEN 0.2 ELSE 0 END) AS delta FROM s)
SELECT doc, ord, round(delta, 4) AS delta, round(score + delta, 4) AS total FROM d""",
)
_MEMORY = "concat('f', p_partkey) AS fingerprint, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS class, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS anomaly, CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE 'medium' END AS actionability, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS occurrences, CASE WHEN p_size = 9 THEN NULL ELSE p_retailprice END AS seconds"


def _memory(s, d):
    return load(s, d, "part").selectExpr(*[x.strip() for x in _MEMORY.replace(" AS ", " as ").split(", ") if x.startswith("CASE")], "concat('f', p_partkey) as fingerprint")


_MEM = f"WITH m AS (SELECT {_MEMORY} FROM part) "
_add("d11_memory_totals", lambda s, d: rv.memory_totals(_memory(s, d)), _MEM + """, e AS (SELECT 'class' AS "by", CASE WHEN class = '' THEN 'unknown' ELSE class END AS value, * FROM m UNION ALL SELECT 'anomaly', anomaly, * FROM m WHERE anomaly IS NOT NULL UNION ALL SELECT 'actionability', coalesce(actionability, 'low'), * FROM m)
SELECT "by", value, sum(coalesce(occurrences, 1))::BIGINT AS occurrences, round(sum(coalesce(seconds, 0)), 3) AS seconds, count(*) AS fingerprints, count(*) FILTER (occurrences > 1) AS repeated FROM e GROUP BY ALL""")  # fmt: skip
_add("d11_costliest", lambda s, d: rv.costliest(_memory(s, d)), _MEM + "SELECT fingerprint, occurrences, seconds FROM m ORDER BY coalesce(seconds, 0) DESC, occurrences DESC NULLS LAST, fingerprint LIMIT 20")

# ---- Blocks and captions

_BLOCK = "CASE l_linenumber % 3 WHEN 0 THEN 'text' ELSE 'formula' END AS kind, CASE l_partkey % 4 WHEN 0 THEN concat(' (', l_linenumber, 'a) ') WHEN 1 THEN concat(chr(92), 'tag{3}') WHEN 2 THEN 'see (3) there' ELSE NULL END AS content"
_add(
    "c18_formula_tags",
    lambda s, d: rv.formula_tags(load(s, d, "lineitem").selectExpr("l_orderkey as doc_id", f"{_ORD} as ord", *_split(_BLOCK))),
    f"WITH b AS (SELECT l_orderkey AS doc_id, {_ORD} AS ord, {_BLOCK} FROM lineitem), a AS (SELECT doc_id, ord, kind, lead(kind) OVER w AS k, lead(content) OVER w AS c, lead(ord) OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, n AS source_ord, ord AS target_ord FROM a WHERE kind = 'formula' AND k = 'text' AND (c LIKE ' (%' OR c LIKE '%tag{{3}}')",
)
_CAPTIONED = "concat(text, chr(10), repeat(concat('filler', chr(10)), CAST(doc_id % 9 AS INT)), 'Figure ', doc_id % 5, ': shown', chr(10), 'figure 7. again', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('![](a.png)', chr(10)) ELSE '' END, '**Figure 8: last')"
_add(
    "e06_with_figure_markers",
    lambda s, d: rv.with_figure_markers(transcripts(s, d).select("doc_id", _e(_CAPTIONED).alias("text"))),
    _TRANSCRIPTS + f""", t AS (SELECT doc_id, string_split({_CAPTIONED}, chr(10)) AS a FROM src), l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM t),
x AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '<!--\\s*DOC:PAGE:\\d{{4}}\\s*-->') THEN regexp_extract(line, 'DOC:PAGE:(\\d{{4}})', 1)::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page,
  regexp_matches(trim(line), '(?i)^(\\*\\*)?\\s*Figure\\s+\\d+\\s*[.:：]') AND NOT coalesce(bool_or(contains(line, 'DOC:FIGURE') OR contains(line, '![')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), false) AS bare FROM l),
m AS (SELECT *, sum(bare::INT) OVER (PARTITION BY doc_id, page ORDER BY pos) AS nth FROM x)
SELECT doc_id, string_agg(CASE WHEN bare THEN format('<!-- DOC:FIGURE:p{{:04d}}:f{{:02d}} -->', page, nth::INT) || chr(10) || chr(10) ELSE '' END || line, chr(10) ORDER BY pos) AS text, sum(bare::INT)::BIGINT AS put FROM m GROUP BY doc_id""",
)
_EQ = f"l_orderkey AS doc_id, {_ORD} AS ord, l_partkey % 50 AS place, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 6 AS VARCHAR(9)) END AS number, CASE l_partkey % 5 WHEN 0 THEN 'Bias' WHEN 1 THEN 'Loss' ELSE '' END AS label, CASE l_partkey % 6 WHEN 0 THEN 'a = b' WHEN 1 THEN concat(chr(92), 'frac{{1}}{{2}}') WHEN 2 THEN 'Eq x' WHEN 3 THEN 'the loss' WHEN 4 THEN concat(chr(92), 'left( TP )') ELSE NULL END AS content"
_ASKED = "o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey % 6 AS VARCHAR(9)) END AS number, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 END AS mention"


def _chosen(s, d):
    blocks = load(s, d, "lineitem").where("l_orderkey % 5 > 0 or l_linenumber = 1").selectExpr(*_split(_EQ))
    asked = load(s, d, "orders").selectExpr(*_split(_ASKED), "case o_orderkey % 3 when 0 then array('Loss', 'Bias') when 1 then array('Bias') else array() end as labels")
    return rv.chosen_block(asked, blocks.withColumnRenamed("place", "at"))


_add("f08_chosen_block", _chosen, f"""WITH b AS (SELECT {_EQ} FROM lineitem WHERE l_orderkey % 5 > 0 OR l_linenumber = 1), a AS (SELECT {_ASKED}, CASE o_orderkey % 3 WHEN 0 THEN ['Loss', 'Bias'] WHEN 1 THEN ['Bias'] ELSE [] END AS labels FROM orders),
j AS (SELECT a.doc_id, a.number AS want, mention, labels, ord, place, b.number, coalesce(label, '') AS label, coalesce(content, '') AS t, count(ord) OVER (PARTITION BY a.doc_id) AS n FROM a LEFT JOIN b ON a.doc_id = b.doc_id),
q AS (SELECT *, CASE WHEN contains(t, '=') THEN 3 WHEN contains(t, 'frac') THEN 4 WHEN contains(t, 'left') THEN 4 WHEN contains(t, 'Eq') THEN -5 ELSE 0 END AS q, CASE WHEN label <> '' THEN list_position(labels, label) * 2 - 2 END AS eq, CASE WHEN contains(t, 'loss') THEN list_position(labels, 'Loss') * 2 - 1 END AS inside FROM j),
w AS (SELECT *, least(CASE WHEN eq >= 0 THEN eq END, CASE WHEN inside >= 0 THEN inside END) AS lab FROM q), v AS (SELECT *, CASE WHEN ord IS NULL THEN NULL WHEN want <> '' AND number = want AND q >= 0 THEN 0 WHEN want <> '' AND place >= mention THEN 1 WHEN lab IS NOT NULL THEN 2 WHEN n = 1 THEN 3 END AS way FROM w)
SELECT doc_id, coalesce(['exact_number', 'number_nearby', 'label_match', 'order_fallback'][way + 1], 'none') AS method, CASE WHEN way IS NOT NULL THEN ord END AS ord FROM v
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY way NULLS LAST, CASE WHEN way = 0 THEN -q END, CASE WHEN way = 0 THEN length(t) END, CASE WHEN way = 2 THEN lab END, ord) = 1""")  # fmt: skip

# ---- Page lines

_LINE = "CASE l_partkey % 8 WHEN 0 THEN 'a = b (3)' WHEN 1 THEN '(12a)' WHEN 2 THEN 'see Eq. (4)' WHEN 3 THEN 'one two three where four five six seven eight nine ten' WHEN 4 THEN 'SECTION 2' WHEN 5 THEN 'word' WHEN 6 THEN 'step_num * (x)' ELSE ' + ' END"
_BOX = "l_orderkey AS doc_id, 1 AS page, l_linenumber AS ord, l_suppkey * 3.0 % 400 AS x0, l_partkey * 7.0 % 700 AS y0, l_suppkey * 3.0 % 400 + 5.0 + l_quantity * 6.0 AS x1, l_partkey * 7.0 % 700 + 12.0 AS y1, 600.0 AS page_w, 800.0 AS page_h, l_orderkey % 400 + 0.0 AS seed0, l_orderkey % 600 + 0.0 AS seed1, l_orderkey % 400 + 60.0 AS seed2, l_orderkey % 600 + 150.0 AS seed3"
_BOXES = f"WITH l AS (SELECT {_LINE} AS text, {_BOX} FROM lineitem) "


def _lines(s, d):
    rows = load(s, d, "lineitem").selectExpr(f"{_LINE} as text", *_split(_BOX))
    return rows.select(*[_c(n).cast("double").alias(n) if n[0] in "xy" or n.startswith(("seed", "page_")) else _c(n) for n in rows.columns])


_add(
    "i09_line_predicates",
    lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", _e(_LINE).alias("t")).select("l_orderkey", "l_linenumber", ly.line_number(_c("t")).alias("number"), ly.section_header(_c("t")).alias("section"), ly.prose(_c("t")).alias("prose"), ly.formula_line(_c("t")).alias("formula"), ly.math_fragment(_c("t")).alias("fragment")),
    "WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey % 8 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN '3' WHEN 1 THEN '12a' ELSE '' END AS number, k = 4 AS section, k IN (3, 4) AS prose, k IN (0, 1, 6, 7, 2) AS formula, k IN (0, 1, 2, 6, 7) AS fragment FROM k",
)
_COLUMNS = """, g AS (SELECT doc_id, page, max(page_w) AS w, max(seed0) AS s0, max(seed2) AS s2, count(*) FILTER (wide) AS n, min(x0) FILTER (wide) AS wl, max(x1) FILTER (wide) AS wr, min(x0) FILTER (r) AS rl, max(x1) FILTER (r) AS rr, min(x0) FILTER (f) AS ll, max(x1) FILTER (f) AS lr
  FROM (SELECT *, body AND x1 - x0 >= 288 AS wide, body AND x0 > 240 AND text <> '(12a)' AS r, body AND x1 < 348 AS f FROM (SELECT *, y0 > 56 AND y1 < 744 AND x1 - x0 > 20 AS body FROM l)) GROUP BY doc_id, page),
c AS (SELECT doc_id, page, greatest(0, (CASE WHEN n >= 3 THEN wl WHEN (s0 + s2) / 2 >= 288 AND rl IS NOT NULL THEN rl WHEN ll IS NOT NULL THEN ll ELSE s0 - 72 END) - 8)::DOUBLE AS "left", least(w, (CASE WHEN n >= 3 THEN wr WHEN (s0 + s2) / 2 >= 288 AND rl IS NOT NULL THEN rr WHEN ll IS NOT NULL THEN lr ELSE s2 + 16 END) + 8)::DOUBLE AS "right" FROM g) """
_add("i14_column_bounds", lambda s, d: rv.column_bounds(_lines(s, d)), _BOXES + _COLUMNS + "SELECT * FROM c")
_add("i18_band_lines", lambda s, d: rv.band_lines(_lines(s, d), rv.column_bounds(_lines(s, d))), _BOXES + _COLUMNS + """SELECT l.doc_id, l.page, ord FROM l JOIN c USING (doc_id, page) WHERE y1 >= seed1 - 10 AND y0 <= seed3 + 10 AND x1 >= "left" - 1 AND x0 <= "right" + 1 AND text NOT IN ('SECTION 2', 'word') AND text NOT LIKE 'one%'""")


def _clusters(s, d):
    rows = _lines(s, d)
    first = rows.where(ly.line_number(_c("text")) != "").groupBy("doc_id", "page").agg(F.min("ord").alias("_t"))
    return cl.clusters(rows.join(rv.column_bounds(rows), ["doc_id", "page"]).join(first, ["doc_id", "page"]).withColumn("target", _c("ord") == _c("_t")))


_add("i16_clusters", _clusters)


def _tags(s, d):
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    p = load(s, d, "part")
    near = F.array(box(_c("p_partkey") % 90, _c("p_size"), F.lit(40), F.lit(20)))
    return p.select("p_partkey", F.array_join(ly.crop_tags(box(_c("p_partkey") % 70, _c("p_partkey") % 30, F.lit(60), F.lit(30)), (_c("p_size") % 20).cast("double"), near), ",").alias("tags"))


_add("i07_crop_tags", _tags, """WITH b AS (SELECT p_partkey, p_partkey % 70 AS x, p_partkey % 30 AS y, p_size % 20 AS h, greatest(0, least(p_partkey % 70 + 60, p_partkey % 90 + 40) - greatest(p_partkey % 70, p_partkey % 90)) AS o, greatest(0, least(p_partkey % 30 + 30, p_size + 20) - greatest(p_partkey % 30, p_size)) AS v FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN h > 0 AND y < h - 0.5 THEN 'header_overlap' END, CASE WHEN o >= 12 AND o * v / 1800.0 >= 0.12 THEN 'neighbor_eq' END) AS tags FROM b""")  # fmt: skip

# ---- Texts

_FENCED = "CASE doc_id % 5 WHEN 0 THEN concat(' ```md', chr(10), text, chr(10), '```', chr(10)) WHEN 1 THEN concat('```', chr(10), 'x') WHEN 2 THEN '  ' WHEN 3 THEN 'a' ELSE concat('a', chr(10), '```') END"
_add("l18_unfenced", lambda s, d: load(s, d, "documents").select("doc_id", ly.unfenced(_e(_FENCED)).alias("text")), "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN rtrim(text, ' ' || chr(9) || chr(10)) || chr(10) WHEN 1 THEN 'x' || chr(10) WHEN 2 THEN '' WHEN 3 THEN 'a' || chr(10) ELSE 'a' || chr(10) || '```' || chr(10) END AS text FROM documents")
_add("k05_protected_regions", lambda s, d: rv.spans(load(s, d, "pages").selectExpr("page_id as doc_id", "html as text"), rv.protected_of))
_add("k09_math_spans", lambda s, d: rv.spans(transcripts(s, d), rv.math_of))
