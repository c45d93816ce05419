"""Queries over evidence for formulas, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import evidence as ev
from folioscope.functions import vocabulary as vc
from folioscope.operators import identity as idn
from folioscope.operators import recovery as rv
from folioscope.operators.sequential import _per_text
from folioscope.plans.transcripts import transcripts
from folioscope.sources.tables import attempts, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _by_case(name: str, cases: list[tuple], made, kind: str = "string") -> None:
    """A query that gives each document one of the cases (inputs..., expected result) by its id."""
    quoted = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    plain = lambda x: x if kind != "string" else "'" + str(x) + "'"
    width = len(cases[0]) - 1

    def build(spark, sf_dir):
        pick = lambda k: F.expr("CASE doc_id %% %d %s END" % (len(cases), " ".join(f"WHEN {i} THEN {quoted(c[k])}" for i, c in enumerate(cases))))
        rows = load(spark, sf_dir, "documents").select("doc_id", *[pick(k).alias(f"a{k}") for k in range(width)])
        return rows.select("doc_id", made(*[_c(f"a{k}") for k in range(width)]).alias("found"))

    _add(name, build, "SELECT doc_id, CAST(CASE doc_id %% %d %s END AS %s) AS found FROM documents" % (len(cases), " ".join(f"WHEN {i} THEN {plain(c[-1])}" for i, c in enumerate(cases)), kind))


_by_case("h29_context_mismatch", [
    ("x", "calculated recall", "context_mismatch_recall"), ("x = y", "calculated recall", ""), ("a b", "the F1 score is $F1$", "context_mismatch_f1"), ("f1 = 2", "the F1 score", ""), ("out comes", "Brier score follows", "context_mismatch_brier"),
    ("x", "TPR given by", "context_mismatch_tpr"), ("x", "the false positive rate follows", "context_mismatch_fpr"), ("\\omega", "expected MSE", "semantically_suspicious"), ("\\omega + bias", "expected MSE", ""), ("x", "$recall$ given by", ""), ("x", "recall", ""),
], lambda body, before: F.array_join(ev.context_mismatch(body, before), ","))
_by_case("h30_validated", [("$$ $$", "", "false 1.0 empty"), ("", "", "false 1.0 empty"), ("$x$", "TPR given by", "false 0.85 context_mismatch_tpr"), ("a = b", "", "true 0.0 "), ("$$" + "ab = cd + " * 40 + "1$$", "", "true 0.7 too_long")],
         lambda t, b: F.concat_ws(" ", ev.validated(t, b)["valid"].cast("string"), ev.validated(t, b)["severity"].cast("string"), F.array_join(ev.validated(t, b)["issues"], ",")))
_by_case("h43_span_score", [("abc", 0), ("a = b", 0.23), ("we are in the house", 0), ("TPR = TP + {x}[1]", 0.66), ("$a = b$", 0), ("alpha beta gamma delta", 0.2), ("α ≤ β ≥ γ ∈ δ → x", 0.57)], ev.span_score, "double")
_by_case("h41_mention_class", [("see", "x", "reference"), ("is defined by", "x", "defining"), ("see", " : x", "defining"), ("the Recall ", "x", "defining"), ("Eq. (3), Eq. (4), and", "", "defining"), ("word", "", "reference"), ("by", "", "defining")], lambda b, a: ev.mention_class(b, a, (r"defined\s+(?:by|as)", r"given\s+(?:by|in|as)", r"as\s+follows")))
_by_case("i22_crop_class", [("", 80, "likely_too_small"), ("a | b | c | d |", 80, "likely_table"), ("seven words that make up prose for a crop of text here", 80, "likely_prose"), ("x = y", 30, "likely_too_small"), ("x = y", 50, "likely_formula"), ("a b c 1\nd e f 2\ng h i 3\nj k l 4\nm", 50, "likely_table")], lambda t, h: ev.crop_class(t, h.cast("double")))
_by_case("l32_without_orphan_markers", [("![a](b)\n\n<!-- DOC:FIGURE:p0001:f01 -->\n\nx", "![a](b)~~x"), ("x\n<!-- DOC:FIGURE:p0001:f01 -->\ny", "x~<!-- DOC:FIGURE:p0001:f01 -->~y"), ("![a](b)\ny\n<!-- DOC:FIGURE:p0001:f01 -->", "![a](b)~y~<!-- DOC:FIGURE:p0001:f01 -->"), ("![a](b)\n<!-- DOC:FIGURE:p0001:f01 -->", "![a](b)~")], lambda t: F.translate(rv.without_orphan_markers(t), "\n", "~"))
_by_case("h82_folded", [("𝐀𝑏 = 𝟏", "Ab = 1"), ("plain", "plain"), ("𝛼𝜷", "αβ")], ev.folded)
_add(
    "g15_cache_keys",
    lambda s, d: load(s, d, "part").select("p_partkey", ev.page_key(_c("p_brand"), _c("p_size"), _c("p_type"), F.create_map(F.lit("b"), _c("p_name"), F.lit("a"), _c("p_type"))).alias("p"), ev.region_key(_c("p_brand"), _c("p_size"), F.struct(*[((_c("p_partkey") * k % 997) / 8).alias(x) for k, x in ((3, "x0"), (5, "y0"), (7, "x1"), (11, "y1"))]), _c("p_type"), F.lit(2.004), _c("p_name"), F.lit("region")).alias("r"))
    .select("p_partkey", F.col("p.page").alias("page"), F.col("p.config").alias("config"), F.array_join(F.transform("r.box", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("box"), F.col("r.scale").alias("scale"), F.col("r.prompt").alias("prompt")),
    """SELECT p_partkey, p_size AS page, sha1('[{"key":"a","value":"' || p_type || '"},{"key":"b","value":"' || p_name || '"}]') AS config, concat_ws(',', round((p_partkey * 3 % 997) / 8 * 10.0)::BIGINT, round((p_partkey * 5 % 997) / 8 * 10.0)::BIGINT, round((p_partkey * 7 % 997) / 8 * 10.0)::BIGINT, round((p_partkey * 11 % 997) / 8 * 10.0)::BIGINT) AS box, 2.0::DOUBLE AS scale, left(sha1(p_name), 10) AS prompt FROM part""",
)
_add("k06_format_issues", lambda s, d: rv.spans(transcripts(s, d), rv.format_issues_of))
_add("k08_text_issues", lambda s, d: rv.spans(transcripts(s, d), rv.text_issues_of))
_add("l30_placed", lambda s, d: _per_text(transcripts(s, d), "text", rv.placed_of, "text", "string"))

# ---- Identities and audits

_TEXT = "concat('Value is defined by Eq. (', doc_id % 9, '): ', text, ' see Equation (', doc_id % 7, 'a) and word Eqs (', doc_id % 5, ') end')"
_add(
    "k14_mentions",
    lambda s, d: idn.mentions(load(s, d, "documents").select("doc_id", F.expr(_TEXT).alias("text"))).select("doc_id", "label", "kind"),
    "SELECT doc_id, (doc_id % 9)::VARCHAR AS label, 'defining' AS kind FROM documents UNION ALL SELECT doc_id, (doc_id % 7) || 'a', 'reference' FROM documents UNION ALL SELECT doc_id, (doc_id % 5)::VARCHAR, 'reference' FROM documents",
)


def _identities(s, d):
    rows = load(s, d, "lineitem")
    at = F.expr("cast(l_partkey % 40 as int) * 60 + l_linenumber")
    slots = rows.where("l_suppkey % 2 = 0").select(_c("l_orderkey").alias("doc"), at.alias("start"))
    said = rows.where("l_suppkey % 2 = 1").groupBy(_c("l_orderkey").alias("doc"), at.alias("pos")).agg((F.min("l_suppkey") % 9).cast("string").alias("label"), F.when(F.min("l_partkey") % 3 > 0, "defining").otherwise("reference").alias("kind"))
    printed = slots.where("start % 5 = 0").select("doc", "start", (_c("start") % 7).cast("string").alias("label"), F.lit(1.0).alias("score")).distinct()
    return idn.identities(slots, said.withColumn("end", _c("pos") + 8), printed)


_add("c04_identities", _identities)
_RANKED = "user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 13 / 13.0::DOUBLE AS score, event_id % 3 = 0 AS accepted"
_add(
    "d26_ranking_errors",
    lambda s, d: idn.ranking_errors(attempts(s, d).select("doc", "ord", (_c("event_id") % 13 / 13.0).alias("score"), (_c("event_id") % 3 == 0).alias("accepted"))),
    f"WITH i AS (SELECT {_RANKED} FROM events), l AS (SELECT *, round(avg(score) FILTER (accepted AND ord >= 8) OVER (PARTITION BY doc), 4) AS late_score FROM i), g AS (SELECT doc, any_value(late_score) AS late_score, round(avg(score) FILTER (NOT accepted AND ord BETWEEN 2 AND 8), 4) AS early_rejected, count(*) FILTER (NOT accepted AND abs(score - late_score) < 0.08) AS same_tier, round(avg(score) FILTER (NOT accepted AND abs(score - late_score) < 0.08), 4) AS same_tier_score FROM l GROUP BY doc) SELECT *, coalesce(same_tier > 0 AND abs(late_score - same_tier_score) < 0.08, false) AS alike FROM g",
)
_AUDIT = "user_id AS doc, event_id % 4 = 0 AS accepted, CASE WHEN event_id % 5 = 0 THEN event_type END AS bucket, event_id % 10 = 5 AND event_id % 4 > 0 AS safe, CASE WHEN user_id % 3 = 0 OR event_id % 20 = 5 THEN 'insufficient' WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'ok' END AS status, value AS seconds"
_AUDITED = f"WITH i AS (SELECT {_AUDIT} FROM events), a AS (SELECT doc, count(*) AS attempts, count(bucket) AS missed, count(*) FILTER (safe) AS safe, round(coalesce(sum(seconds) FILTER (safe), 0), 3) AS safe_seconds, count(*) FILTER (status = 'conflict' AND NOT accepted) AS conflicts, count(*) FILTER (safe) >= 2 AND count(*) FILTER (safe AND status <> 'insufficient') = 0 AS advised FROM i GROUP BY doc) "


def _audit(s, d):
    kind = "case when user_id % 3 = 0 or event_id % 20 = 5 then 'insufficient' when event_id % 7 = 0 then 'conflict' else 'ok' end as status"
    return idn.gate_audit(load(s, d, "events").selectExpr("user_id as doc", "event_id % 4 = 0 as accepted", "case when event_id % 5 = 0 then event_type end as bucket", "event_id % 10 = 5 and event_id % 4 > 0 as safe", kind, "value as seconds"))


_add("d14_gate_audit", _audit, _AUDITED + "SELECT * FROM a")
_add("d15_audit_total", lambda s, d: idn.audit_total(_audit(s, d)), _AUDITED + "SELECT count(*) AS scanned, count(*) FILTER (safe > 0) AS with_safe, sum(safe)::BIGINT AS safe_total, sum(safe) >= 2 AND count(*) FILTER (safe > 0) >= 1 AS advised FROM a")

# ---- Vocabulary

_joined = lambda c: F.array_join(F.array_sort(c), ",")
_by_case("h31_math_tokens", [("\\frac{TP}{TP+FN} ε", "epsilon,fn,frac,tp"), ("the true positive rate, ROC-AUC", "auc,roc,tp"), ("F_{1} score", "f1"), ("", ""), ("Bias and var", "bias,var")], lambda t: _joined(vc.math_tokens(t)))
_by_case("h32_symbols", [("R(t;H) + H_{lc}", "h,lc,r,t"), ("\\mathcal{F} \\pi \\frac", "f,pi"), ("a Markov chain", "r"), ("word", ""), ("", "")], lambda t: _joined(vc.symbols(t)))
_by_case("h35_consistency", [
    ("recall is", "TP / (TP + FN)", "0.25 "), ("recall is", "recall = x", "1.0 "), ("recall of", "macro = 3", "0.25 "), ("the mse", "\\omega", "0.0 ocr_context_conflict"), ("the mse", "\\varepsilon^2", "0.25 "), ("recall", "", "0.35 ocr_context_insufficient"),
    ("Markov", "H_{lc}", "0.32 symbol_signature_support"), ("recall", "markov 3", "0.0 ocr_context_conflict"), ("word", "TP 3", "0.4 ocr_context_insufficient"), ("let x = 1", "x = 2", "1.0 symbol_signature_support"), ("plain", "1 + 2", "1.0 "),
], lambda a, b: F.concat_ws(" ", vc.consistency(a, b)["overlap"].cast("string"), vc.consistency(a, b)["reason"]))
_by_case("b63_formula_tags", [("\\frac{1}{2}\\sum", "fraction,sum_prod_int"), ("\\begin{cases}\\mathbb{R}", "cases_or_array,fonts"), ("中 \\int", "sum_prod_int,text_or_zh"), ("x", "other"), ("x" * 121, "long")], lambda t: F.array_join(vc.formula_tags(t), ","))
_by_case("h78_scrapped", [("\n".join("αx=12+b(c)y"), "true"), ("\n".join("αx=12+b(c)"), "true"), ("\n".join("αx=12+b(c"), "false"), ("$$x$$\n" + "\n".join("αx=12+b(c)y"), "false"), ("a longer line here\n" * 12, "false"), ("", "false")], lambda t: vc.scrapped(t).cast("string"))
_by_case("h83_undefined_commands", [("\\frac\\foo\\bar\\foo", "foo,bar"), ("a \\\\ab \\frac", ""), ("", "")], lambda t: F.array_join(vc.undefined_commands(t, F.array(F.lit("frac"))), ","))
_by_case("h38_display_number", [("x = 1 (1 2)", "12"), ("p(0)", ""), ("a (3) \\\\ b", "3"), ("a (4) & b (5)", "4"), ("", "")], vc.display_number)
_by_case("h22_id_page", [("page7_eq6", "7"), ("x", "-"), ("Page-12", "12")], lambda t: F.coalesce(vc.id_page(t, F.lit(None)).cast("string"), F.lit("-")))
_by_case("l34_fallback_markup", [("a,b,c,d", "lost: {reason}", "lost: a,b,c"), ("", " ", vc.VISIBLE % "recovery_failed"), ("x", "gone", "gone")], lambda i, p: vc.fallback_markup(F.filter(F.split(i, ","), lambda x: x != ""), p))
