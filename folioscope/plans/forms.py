"""Queries over formula comparison, labels, keys, page and release predicates, with expected values or DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import forms as fm
from folioscope.plans import evidence
from folioscope.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def _add(name: str, build, sql: str) -> None:
    QUERIES[name], ORACLES[name] = build, sql


def _by_case(name: str, cases: list[tuple], made, kind: str = "string") -> None:
    evidence._by_case(name, cases, made, kind)
    QUERIES[name], ORACLES[name] = evidence.QUERIES.pop(name), evidence.ORACLES.pop(name)


_bool = lambda x: x.cast("string")
_by_case("h07_environments", [("\\begin{a}\\end{a}", "true"), ("\\begin{a}\\begin{b}\\end{a}\\end{b}", "false"), ("\\end{a}", "false"), ("x", "true"), ("\\begin{a}", "false"), ("\\begin{a}\\begin{b}\\end{b}\\end{a}", "true")], lambda t: _bool(fm.environments_ok(t)))
_by_case("h08_compiles", [("x^{2}", "true"), ("", "false"), ("x^{2", "false"), ("}{", "false"), ("\\endgroup", "false"), ("\\begin{a}x\\end{a}", "true")], lambda t: _bool(fm.compiles(t)))
_by_case("h05_token_distance", [("a+b", "a+b", 0), ("a+b", "a-b", 1), ("", "abc = d", 3), ("\\frac{a}{b}", "\\frac{a}{c}", 1), ("x y z", "x", 1), ("\\alpha+1", "1", 2)], fm.token_distance, "int")
_by_case("h11_lenient", [("$$ \\frac{A}{B} $$", "fracab"), ("\\mathrm{Var}(x)", "v(x)"), ("a \\quad b~~c & d", "abcd"), ("\\left( X \\right)", "(x)"), ("\\begin{align} a \\end{align}", "a"), ("A × B", "a*b"), ("\\epsilon", "eps")], fm.lenient)
_by_case("h10_comparison", [("a = b", "a=b", "true 0.0 true true"), ("a = b + c", "a = b", "false 0.6667 true true"), ("", "a", "false 1.0 false false"), ("a", "", "false 1.0 false false"), ("\\frac{a}{b", "\\frac{a}{b}", "true 0.0 false true"), ("x", "y", "false 1.0 true false")],
         lambda a, b: F.concat_ws(" ", *[x.cast("string") for x in fm.comparison(a, b).values()]))
_by_case("h39_label", [(" 3 a", "3a"), ("A. 1", "A.1"), ("", "")], fm.label)
_by_case("h40_label_token", [(" (3 a)", "3a"), ("A. 1", "A.1"), ("-", "i"), ("", "i")], fm.label_token)
_by_case("h23_id_label", [("page7_eq6", "6"), ("page7_eqA.1", "A.1"), ("page7_eqi2", ""), ("page7_eq6_2", "6"), ("none", ""), ("", "")], fm.id_label)
_by_case("h54_profile_key", [("cuda:0", "rec 2", "cuda_0|rec_2|M"), ("", "--", "unknown|unknown|M"), (" a ", "b", "a|b|M")], lambda a, b: fm.profile_key(a, b, F.lit("M")))
_by_case("h56_clean_math", [("$$ a = b $$", "a = b"), ("\\( x \\)", "x"), ("\\[ y \\quad (3) \\]", "y"), ("a = b \\quad (12)", "a = b"), ("z \\qquad", "z")], fm.clean_math)
_by_case("h57_formula_like", [("a = b", "true"), ("ab", "false"), ("see Eq. (3) = x", "false"), ("given in Eq.", "false"), ("^{12,23}", "false"), ("these words make prose_", "false"), ("TP/FN", "true"), ("plain", "false")], lambda t: _bool(fm.formula_like(t)))
_by_case("h59_raw_holds_gold", [("x y = z + w", "", "-"), ("", "a", "no"), ("junk a=b junk", "a = b", "yes"), ("junk TP/(TP+FN) end", "Recall = TP/(TP+FN)", "yes"), ("abc", "d = e", "no"), ("TP+FN then Bias", "Bias + (TP+FN)", "yes")], fm.raw_holds_gold)
_by_case("h48_known_subscripts", [("H_{ic} here", "H_{ lc } = 1", "H_{ic} = 1"), ("none", "H_{lc}", "H_{lc}"), ("h_{ i c }", "h_{lc}+x", "H_{ic}+x")], fm.known_subscripts)
_by_case("b26_figure_only", [("Figure 3", "true"), ("![a](b.png) and a good deal of other text that goes on and on", "false"), ("", "false"), ("words only", "false"), ("<!-- DOC:FIGURE:p0001:f01 -->", "true")], lambda t: _bool(fm.figure_only(t)))
_by_case("b29_continued_references", [("(contd. from page 3)", "true"), ("(Contd.from  page", "true"), ("contd", "false")], lambda t: _bool(fm.continued_references(t)))
_by_case("b46_math_like", [("a = b", "true"), ("TP and", "true"), ("STP and", "false"), ("words", "false"), ("x^2", "true")], lambda t: _bool(fm.math_like(t)))
_by_case("b54_layer_or_ok", [("1", "a", "a", "OK"), ("0", "a", "", "NO_GOLD"), ("0", " ", "a", "EMPTY_CANDIDATE"), ("0", "b", "a", "OCR_FAILURE")], lambda e, a, b: fm.layer_or_ok(e == "1", a, b))
_by_case("d28_release", [("clean $a$ text", "0", "0 true "), ("odd $ sign", "0", "1 false unbalanced_dollar"), ("formula-not-decoded twice formula-not-decoded", "0", "2 false unresolved_formula_not_decoded"), ("fine", "2", "2 false recovery_failed_count"),
                         ("\\quad " * 8, "0", "1 false quad_spam_in_markdown"), ("$$" + "\\, " * 120 + "$$", "1", "2 false long_low_info_display,recovery_failed_count")],
         lambda t, n: F.concat_ws(" ", *[x.cast("string") for x in fm.release(t, n.cast("long"), F.lit(False), F.lit(0)).values()]))
_by_case("i29_geometry", [("1", "10,10,50,50", "", ""), ("", "10,10,50,50", "", "missing_page"), ("1", "", "", "missing_bbox"), ("1", "50,10,10,50", "likely_prose", "degenerate_bbox,suspicious_crop:likely_prose"), ("1", "1,10,599,798", "", "bbox_near_x_edge,bbox_near_y_edge")],
         lambda p, b, c: fm.geometry(F.when(p != "", p), F.when(b != "", F.split(b, ",").cast("array<double>")), c, F.lit(600.0), F.lit(800.0)))

_add("d31_recovery_yield", lambda s, d: load(s, d, "supplier").select("s_suppkey", fm.recovery_yield(_c("s_suppkey") % 5, _c("s_nationkey")).alias("yield")), "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN round_even(s_nationkey / (s_suppkey % 5)::DOUBLE, 4) END AS yield FROM supplier")
_add("d29_risk_score", lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_c("l_discount").cast("double")).alias("x")).select("l_orderkey", F.round(fm.risk_score(_c("x")), 6).alias("risk")), "SELECT l_orderkey, round(1 - 1 / (1 + sum(l_discount) / 12), 6) AS risk FROM lineitem GROUP BY l_orderkey")
_add("e02_reading_order", lambda s, d: load(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) - 1).alias("position")), "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position FROM conversations")
_by_key = lambda: Window.partitionBy("id").orderBy("part")
_add("d38_first_of_files", lambda s, d: load(s, d, "documents").select(_c("doc_id").alias("id"), "lang", F.lit(0).alias("part")).unionByName(load(s, d, "labels").select(_c("doc_id").alias("id"), F.lit("label").alias("lang"), F.lit(1).alias("part"))).withColumn("n", F.row_number().over(_by_key())).where("n = 1").groupBy("lang").agg(F.count("*").alias("n")),
     "SELECT lang, count(*) AS n FROM (SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY lang")
_add("f07_inventory", lambda s, d: load(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(_c("lang") == "en").alias("english"), F.count_if(_c("lang") != "en").alias("other")), "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang <> 'en') AS other FROM documents GROUP BY source")
_add("b03_multicolumn", lambda s, d: load(s, d, "lineitem").selectExpr("l_suppkey as page", "l_partkey % 400 as x0", "l_partkey % 400 + l_quantity * 5 as x1").where("x1 - x0 >= 40").groupBy("page").agg((F.count_if(_c("x1") < 330) >= 3).alias("l"), (F.count_if(_c("x0") > 270) >= 3).alias("r"), (F.count("*") >= 6).alias("n")).select("page", F.expr("l and r and n").alias("multicolumn")),
     "SELECT l_suppkey AS page, count(*) >= 6 AND count(*) FILTER (l_partkey % 400 + l_quantity * 5 < 330) >= 3 AND count(*) FILTER (l_partkey % 400 > 270) >= 3 AS multicolumn FROM lineitem WHERE l_quantity * 5 >= 40 GROUP BY l_suppkey")
_used = lambda: Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
_add("e24_may_read", lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fm.may_read(_c("l_linenumber") % 3, _c("l_quantity"), F.count("*").over(_used()), F.coalesce(F.sum("l_quantity").over(_used()), F.lit(0)), 2, 4, 45.0, 90.0).alias("allowed")),
     "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 < 2 AND count(*) OVER w < 4 AND l_quantity < 45 AND coalesce(sum(l_quantity) OVER w, 0) < 90 AS allowed FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
