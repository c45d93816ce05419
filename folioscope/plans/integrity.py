"""Queries over transcripts' and formulas' integrity, with expected values derived by hand or DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import boxes as bx
from folioscope.functions import forms as fm
from folioscope.functions import integrity as it
from folioscope.functions import latex as lx
from folioscope.functions import text as tx
from folioscope.functions import transcript as tr
from folioscope.operators import rewriting as rw
from folioscope.operators.benchmark import match_summary
from folioscope.operators.reconcile import keep_filled
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
_list = lambda x: F.array_join(x.cast("array<string>"), ",")
_page, _figure = "<!-- DOC:PAGE:0003 -->", "<!-- DOC:FIGURE:p0002:f01 -->"

_by_case("b28_reference_body", [("[12] Some work", "true"), ("A. Author (2019). Title. doi:10.1/x", "true"), ("A. Author (2019). Title.", "false"), ("text", "false"), ("", "false"), ("B. (2001), Retrieved from a site", "true")], lambda t: _bool(tx.reference_page(t)))
_by_case("b30_header_page", [("Published in partnership with a university", "true"), ("NPJ science of learning", "true"), ("www.nature.com/scientificreports", "true"), ("plain", "false"), ("", "false"), ("Published in partnership " + "x" * 280, "false")], lambda t: _bool(it.header_page(t)))
_by_case("b34_references_heavy", [("REFERENCES", "true"), ("[3] A long enough entry https://a.b", "true"), ("[3] short https", "false"), ("preferences", "false"), ("", "false")], lambda t: _bool(tr.references_heavy(t)))
_by_case("b37_lacks_structure", [("", "true"), ("short", "false"), ("## Head\n" + "x" * 900, "false"), ("|a|b|\n" + "x" * 4000, "false"), ("x" * 3001, "true"), ("x" * 900, "false"), ("x\n" * 2000, "false")], lambda t: _bool(tr.lacks_structure(t)))
_by_case("b38_example_images", [("![a](https://example.com/fig_3.png)", "true"), ("see HTTPS://EXAMPLE.COM/figure-2.jpg", "true"), ("https://example.com/other.png", "false"), ("![a](figures/1.png)", "false"), ("", "false")], lambda t: _bool(it.example_images(t)))
_by_case("b40_contaminated", [("Home\nNew chat\nSettings\nAlpha\nBeta\nGamma\nDelta\nPlans\n" + _page, "true"), ("Home\n" + _page, "false"), ("Home\nNew chat", "false"), (_page + "\nbody", "false")], lambda t: _bool(tr.contaminated(t)))
_by_case("b41_validation_class", [("模型输出退化（x）", "MODEL_DEGENERATION"), ("formula gap;缺页标记: [3]", "FORMULA_INTEGRITY_FAILED"), ("缺页标记: [3]", "PAGE_MARKER_MISSING"), ("未找到任何 DOC:PAGE 标记", "PAGE_MARKER_MISSING"), ("SourceGuard: 2", "PAGE_CONTENT_SUSPECT"),
                                  ("EXTRACTION_UNSTABLE", "EXTRACTION_UNSTABLE"), ("copy 未触发", "COPY_NOT_FIRED"), ("copy", "EXTRACTION_CONFLICT"), ("", "EXTRACTION_CONFLICT")], lambda t: it.validation_class(F.split(t, ";")))
_by_case("b55_contaminated_formula", [("x = 1", "false"), ("f(a)(b)(c) \\frac \\quad", "true"), ("\\quad{}\\quad", "true"), ("by Eq. (3)", "true"), ("THE MODEL", "true"), ("", "false"), ("(a)(b)(c) \\frac", "false")], lambda t: _bool(it.contaminated_formula(t)))
_by_case("b58_slot_conflict", [("isotonic  fit", "\\frac{Pr(M}{1}", "isotonic"), ("the Bayes\nfactor", "x_{i-1}", "bayes"), ("a random walk", "H_{lc}", "transition"), ("a random walk", "x", ""), ("plain", "H_{lc}", ""), ("isotonic", "pr(m", ""), ("isotonic" + " " + "z" * 300, "\\frac{Pr(M}{1}", ""), ("", "", "")], it.slot_conflict)
_by_case("c22_lost_anchors", [("0.11 0.22 0.33", "none of them", "0.11,0.22,0.33"), ("0.11 0.22 0.33", "only 0.33", ""), ("0.11", "", ""), ("1 2 3 4 5 6 7 8 9", "", "1,2,3,4,5,6,7,8"), ("1,234 0.5 0.6 0.7 n=1 n=2 n=3 n=4", "1234 and 0.5, N = 1, n=2", "0.6,0.7,n=3,n=4"), ("", "", "")],
         lambda a, t: _list(it.lost_anchors(F.filter(F.split(a, " "), lambda x: x != ""), t)))
_by_case("c26_identity_conflict", [("page7_eq6", "FPR = a", "true"), ("page7_eq6", "FPR = 1 - TPR", "false"), ("page7_eq7", "tpr=b", "true"), ("page7_eq7", "FPR = a", "false"), ("page7_eq8", "FPR = a", "false"), ("page7_eq6", "FPR", "false"), ("", "", "false")], lambda n, t: _bool(it.identity_conflict(n, t)))
_by_case("h42_context_window", [("Alpha beta gamma\n\nx\n\nDelta words here", "Alpha beta gamma\n\nDelta words here"), ("One two three\n<!-- formula-not-decoded -->\nfour five six", "One two three\n\nfour five six"), ("", "")],
         lambda t: it.context_window(t, F.length(t)))
_by_case("h52_prior", [("0", "0", "0", "none", "0", "0.55"), ("1", "1", "0", "confirmed_equation_number", "1", "0.7"), ("0", "5", "0", "plausible_equation_number", "0", "0.7"), ("9", "1", "0", "non_equation_number", "0", "0.4")], lambda a, b, c, k, p: it.prior(*[x.cast("int") for x in (a, b, c)], k, p == "1").cast("string"))
_by_case("h53_conflict_penalty", [("5", "10", "none", "0.2"), ("9", "10", "unnumbered", "0.3"), ("4", "10", "none", "0.0"), ("9", "10", "confirmed_equation_number", "0.0"), ("0", "0", "none", "0.0")], lambda a, b, k: it.conflict_penalty(a.cast("int"), b.cast("int"), k).cast("string"))
_by_case("h55_without_noise", [("<|ref|>text<|/ref|><|det|>[[1]]<|/det|>x = y", "x = y"), ("a<|end|>b", "ab"), ("a </end of text> b", "a  b"), ("", "")], it.without_noise)
_by_case("h58_metric_label", [("The Recall is", "recall"), ("F1 - score", "f1"), ("true positive  rate", "tpr"), ("fpr and precision", "fpr"), ("mean squared error", "mse"), ("bias", "mse"), ("accuracy", "accuracy"), ("precisions", ""), ("", "")], it.metric_label)
_by_case("h66_recovered", [("junk\r\n" + _page + "\nbody", _page + "\\nbody"), ("plain answer", "plain answer"), ("Role: copier. Task: copy pages", ""), ("  ", ""), ("Recent chats: one", "")], lambda t: F.replace(it.recovered(t, ("Role:", "Task:"), ("Recent chats",)), F.lit("\n"), F.lit("\\n")))
_by_case("h68_page_numbers", [(_page + " a <!-- DOC:PAGE:0012 -->", "3,12"), ("PAGE 3", ""), ("", "")], lambda t: _list(tr.page_numbers(t)))
_by_case("h71_equation_numbers", [("$$\na = b (1)\n$$", "1"), ("solve this. (3)", ""), ("x_1 = 2 \\quad (4)", "4"), ("$a$ (2)\nplain (5)\n$$\nq\n(6)\n$$\nend (7)", "2,6"), ("", ""), ("$$ a (8)", "8")], lambda t: _list(it.equation_numbers(t)))
_by_case("h72_formula_penalty", [("x_1 (1)\nx_2 (3)", "1", 2000000), ("x_1 (2)\nx_2 (3)", "1", 2000000), ("x_1 (2)\nx_2 (3)", "0", 0), ("The model:\n\nwhere a", "0", 2000000), ("$$a$$ the model:\n\nwhere a", "0", 0), ("the model:\nwhere a \\tag{2}", "1", 4000000), ("", "1", 0)], lambda t, o: it.formula_penalty(t, o == "1"), "bigint")
_by_case("h73_figure_numbers", [(_figure + "\n\n**Figure 4.** Words", "p0002:f01=4"), (_figure + "\nFIGURE 12: a " + _figure.replace("f01", "f02") + " Figure 5.", "p0002:f01=12,p0002:f02=5"), (_figure + "\ntext Figure 4.", ""), ("", "")], lambda t: _list(it.figure_numbers(t)))
_by_case("h74_figure_captions", [("Figure 1: a\nfig. 2 b\n**Figure 3** c", 3), ("see Figure 1", 0), ("", 0)], lambda t: tx.count(t, tx.FIGURE_CAPTION), "bigint")
_by_case("h77_fragment", [("Version:0.9\nStartFragment:49\nEndFragment:53\n<b>xx<p>ab</p>", "<p>a"), ("junk <HTML><p>a</p></HTML> tail", "<HTML><p>a</p></HTML>"), ("plain", "plain"), ("", "")], it.fragment)
_by_case("h86_same_projection", [("a $x$ b", "a x b", "true"), ("\\(x\\)", "$x$", "true"), ("(n)", "n", "false"), ("a", "b", "false"), ("", " ", "true")], lambda a, b: _bool(rw.projection(a) == rw.projection(b)))
_by_case("h87_same_but_brackets", [("(n) items", "$n$ items", "true"), ("(3) items", "3 items", "false"), ("a", "b", "false"), ("", "", "true")], lambda a, b: _bool(rw.same_content(a, b)))
_by_case("h90_display_only", [("x", "false"), ("", "true"), ("a\nb", "true"), ("y" * 49, "true"), ("\\begin{a}", "true"), ("\\a\\b\\c\\d\\e\\f", "true")], lambda t: _bool(rw.display_only(t)))
_by_case("h94_subfigure_labels", [("(a) one (b) two (A) again", "a,b"), ("(iv) and (x)", "iv,x"), ("(ab)", ""), ("", "")], lambda t: _list(lx.subfigures(t)))
_by_case("h98_compatible", [("qa", "1.7", "true"), ("qa", "2.0", "false"), ("run", "", "true"), ("run", " 1 ", "true"), ("other", "1.0", "false"), ("qa", "one", "false")], lambda s, v: _bool(it.compatible(s, v, {"document_ir": "1.0", "qa": "1.0", "run": "1.0", "provider": "1.0"})))

_box = lambda t: F.struct(*[F.split(t, ",")[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
_by_case("i24_vertically_distinct", [("0,0,9,10", "0,30,9,50", "true"), ("0,0,9,10", "0,20,9,30", "false"), ("0,0,9,10", "0,22,9,32", "false"), ("0,60,9,70", "0,0,9,10", "true")], lambda a, b: _bool(bx.vertically_distinct(_box(a), _box(b))))
_by_case("i30_box_area", [("0,0,4,5", "20.0"), ("4,0,0,5", "0.0"), ("1,1,1,9", "0.0"), ("-1,-1,1,1", "4.0")], lambda t: bx.area(_box(t)).cast("string"))
_by_case("i32_rounded_box", [("0.24,0.26,1,10.04", "0.2,0.3,1.0,10.0"), ("5,6,7,8", "5.0,6.0,7.0,8.0")], lambda t: F.concat_ws(",", *[bx.rounded(_box(t))[c].cast("string") for c in ("x0", "y0", "x1", "y1")]))

_PAIRS = (("a = b", "a=b", 1, 0.0, 1), ("a = b + c", "a = b", 0, 0.6667, 1), ("\\frac{a}{b", "\\frac{a}{b}", 1, 0.0, 0), ("x", "y", 0, 1.0, 1))


def _match_summary(s, d):
    # fixed pairs, one for each document, so that means and rates weigh them by the table's rows
    side = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in _PAIRS]), (_c("doc_id") % len(_PAIRS) + 1).cast("int"))
    return match_summary(load(s, d, "documents").select("lang", *[v.alias(k) for k, v in fm.comparison(side(0), side(1)).items()]), "lang")


_case = lambda k: "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(_PAIRS)) + " END"
_add("d21_match_summary", _match_summary, f"SELECT lang, count(*) AS n, round(avg({_case(2)}), 4) AS exact_rate, round(avg({_case(3)}), 4) AS mean_edit_ratio, round(avg({_case(4)}), 4) AS compile_rate FROM documents GROUP BY lang")
_add("d16_accepted_chars", lambda s, d: load(s, d, "documents").groupBy("source").agg(F.count_if(_c("lang") == "en").alias("accepted"), F.sum(F.when(_c("lang") == "en", F.length("text")).otherwise(0)).alias("chars")),
     "SELECT source, count(*) FILTER (lang = 'en') AS accepted, sum(CASE WHEN lang = 'en' THEN length(text) ELSE 0 END) AS chars FROM documents GROUP BY source")
_add("g14_keep_filled", lambda s, d: keep_filled(load(s, d, "orders").select(_c("o_orderkey").alias("id"), F.when(_c("o_orderkey") % 3 == 0, _c("o_orderstatus")).otherwise("").alias("path")), load(s, d, "orders").select(_c("o_orderkey").alias("id"), F.when(_c("o_orderkey") % 2 == 0, _c("o_orderpriority")).alias("path")), "id", ("path",)),
     "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS path FROM orders")
