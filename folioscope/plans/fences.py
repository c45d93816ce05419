"""Queries over fences, completeness, risk, equation margins, averages and groups, with expected values or DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import fences as fe
from folioscope.functions import transcript as tr
from folioscope.operators import attempts as op
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


_page, _figure = "<!-- DOC:PAGE:0001 -->", "<!-- DOC:FIGURE:p0002:f01 -->"
_by_case("h70_without_amounts", [("costs $50 today", "costs 50 today"), ("$x$ and $50", "$x$ and 50"), ("$5 + x$", "$5 + x$"), ("a 5$ b", "a 5 b"), ("$50$", "$50$"), ("", ""), ("$3, and $y$ then $7.", "3, and $y$ then 7."), ("$4 $x", "$4 $x"), ("\\$5 is", "\\$5 is"), ("plain", "plain")],
         fe.without_amounts)
_by_case("h69_fence_errors", [("a $$x$$", ""), ("$$x", fe.DISPLAY_ODD), ("a $x", fe.INLINE_ODD), ("pay $50 now", ""), ("$$x $", fe.DISPLAY_ODD + "," + fe.INLINE_ODD), ("\\$", ""), ("", "")], lambda t: F.array_join(fe.fence_errors(t), ","))
_by_case("b35_looks_truncated", [("", "true"), ("x" * 599, "true"), ("x" * 600, "false"), ("x" * 3001, "true"), ("x" * 3500, "false"), (_page + " " + "x" * 400, "false"), (_page + " x", "true"), ("References " + "y" * 3100, "false")], lambda t: fe.looks_truncated(t).cast("string"))
_by_case("h75_figure_errors", [("x", "0 0"), (_figure, "1 0"), ("Figure 1. a\nFigure 2. b\n![a](b)", "0 1"), ("", "0 0")], lambda t: F.concat_ws(" ", *[x.cast("string") for x in tr.figure_errors(t)]))
_by_case("j02_formula_risk", [("", "a = b", "", "0", "low accept all_layers_ok"), ("", "a = b", "", "1", "medium abstain no_dual_consensus"), ("", "a = b", "ACCEPT", "1", "low accept all_layers_ok"), ("", "a = b", "DISAGREE", "0", "high abstain consensus_disagree"),
                              ("", "a = b", "DISAGREE", "1", "high abstain no_dual_consensus,consensus_disagree"), ("", "a = b", "INCOMPLETE", "0", "medium accept single_model_no_peer"), ("missing_bbox", "x^{2", "", "0", "high abstain missing_bbox,syntax_or_compile_fail,render_untrusted"),
                              ("", "", "ACCEPT_VISUAL", "0", "high abstain syntax_or_compile_fail,render_untrusted")],
         lambda g, t, k, r: F.concat_ws(" ", *fe.risk(g, t, F.when(k != "", k), r == "1").values()))
_by_case("j07_regression_gate", [("hard-1 a", "7", "0", "true true"), ("hard-1 a", "7", "1", "true false"), ("hard-1", "", "0", "true false"), ("other", "0", "9", "false true")],
         lambda n, a, r: F.concat_ws(" ", *[x.cast("string") for x in fe.regression_gate(n, a.try_cast("int"), r.try_cast("int"), "hard-1", (7, 0)).values()]))
_by_case("i28_display_number", [("100", "400", "420", "false"), ("600", "540", "560", "true"), ("600", "310", "330", "false"), ("600", "250", "280", "true"), ("600", "100", "120", "false"), ("600", "450", "560", "false")],
         lambda w, a, b: fe.display_number(*[x.cast("double") for x in (w, a, b)]).cast("string"))

_order = lambda: Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
_add("e25_recorded", lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count("*").over(_order()).alias("calls"), F.sum("l_quantity").over(_order()).alias("seconds")),
     "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER w AS calls, sum(l_quantity) OVER w AS seconds FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_add("h99_stable", lambda s, d: load(s, d, "nation").select("n_nationkey", F.to_json(fe.stable(F.create_map(F.lit("z"), _c("n_name"), F.lit("a"), _c("n_regionkey").cast("string")))).alias("value")), """SELECT n_nationkey, '{"a":"' || n_regionkey || '","z":"' || n_name || '"}' AS value FROM nation""")

_PAGES = (("", "empty 0 high false"), ("Short words.", "text_short 12 high true"), ("INTRODUCTION", "title 12 low true"), ("plain words here " * 10 + "and on.", "text 177 low false"), ("word " * 800, "text 3999 low true"))
_by_case("b23_page_analysis", list(_PAGES), lambda t: F.concat_ws(" ", *[fe.page_analysis(t)[k].cast("string") for k in ("page_type", "chars", "risk", "need_format_fix")]))


def _batch_report(s, d):
    # fixed pages, one for each document, so that a source's report counts them by the table's rows
    page = F.element_at(F.array(*[F.lit(t) for t, _ in _PAGES]), (_c("doc_id") % len(_PAGES) + 1).cast("int"))
    own = fe.page_analysis(page)
    pages = load(s, d, "documents").select("source", own["risk"].alias("risk"), own["chars"].alias("chars"))
    high = F.count_if(_c("risk") == "high")
    return pages.groupBy("source").agg(F.greatest(F.lit(0), 100 - 15 * high).alias("score"), high.alias("errors"), F.count_if((_c("risk") == "low") & (_c("chars") < 100)).alias("warnings"))


_add("d30_batch_report", _batch_report, "SELECT source, greatest(0, 100 - 15 * count(*) FILTER (doc_id % 5 < 2)) AS score, count(*) FILTER (doc_id % 5 < 2) AS errors, count(*) FILTER (doc_id % 5 = 2) AS warnings FROM documents GROUP BY source")
_lines = lambda s, d: load(s, d, "lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
_seen = lambda value: f"list(({value})::DOUBLE ORDER BY l_linenumber, l_partkey, l_suppkey)"
_fold = lambda start: f"CASE WHEN len(x) = 0 THEN {start}::DOUBLE ELSE list_reduce(x, lambda s, v: 0.3::DOUBLE * CASE WHEN s > 0 THEN least(v, 3.0::DOUBLE * s) ELSE v END + 0.7::DOUBLE * s, {start}::DOUBLE) END"
_add("e16_page_average", lambda s, d: op.observed_average(_lines(s, d).withColumn("seconds", _c("l_quantity").cast("double")), "l_orderkey", (_c("l_returnflag") != "A") & (_c("l_linestatus") == "F"), 4.0),
     f"SELECT l_orderkey, len(x) AS samples, {_fold(4.0)} AS average FROM (SELECT l_orderkey, coalesce({_seen('l_quantity')} FILTER (l_returnflag <> 'A' AND l_linestatus = 'F'), []) AS x FROM lineitem GROUP BY l_orderkey)")
_add("e17_load_average", lambda s, d: op.observed_average(_lines(s, d).withColumn("seconds", _c("l_tax").cast("double") * 20), "l_orderkey", (_c("l_linestatus") == "F") & (_c("seconds") > 0.5), 0.0),
     f"SELECT l_orderkey, len(x) AS samples, {_fold(0.0)} AS average FROM (SELECT l_orderkey, coalesce({_seen('l_tax::DOUBLE * 20')} FILTER (l_linestatus = 'F' AND l_tax::DOUBLE * 20 > 0.5), []) AS x FROM lineitem GROUP BY l_orderkey)")
_add("e18_deficit_average", lambda s, d: op.moving_average(_lines(s, d).withColumn("value", F.greatest(F.lit(0.0), _c("l_quantity").cast("double") - 25)), "l_orderkey"),
     f"SELECT l_orderkey, len(x) AS samples, list_reduce(x, lambda s, v: 0.3::DOUBLE * v + 0.7::DOUBLE * s, 0::DOUBLE) AS average FROM (SELECT l_orderkey, {_seen('greatest(0, l_quantity::DOUBLE - 25)')} AS x FROM lineitem GROUP BY l_orderkey)")
