"""Queries over routing and sequential operators; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import routing as rt
from folioscope.operators import sequential as sq
from folioscope.plans.documents import _CHECKS, _NAMES, _SRC, checked, markdown
from folioscope.sources.tables import attempts, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _providers(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_nationkey").alias("scope"), F.col("s_name").alias("id"), F.col("s_suppkey").alias("ord"), F.expr("if(s_suppkey % 2 = 0, array('parse', 'ocr'), array('ocr'))").alias("capabilities"),
        (F.col("s_acctbal") > 0).alias("installed"), (F.col("s_suppkey") % 5 != 0).alias("enabled"), (F.col("s_suppkey") % 7 != 0).alias("available"), (F.col("s_suppkey") % 3 == 0).alias("experimental"), (F.col("s_suppkey") % 11 == 0).alias("network_required"),
    )


_add("b08_resolve", lambda s, d: rt.resolve(_providers(s, d), "ocr", ("Supplier#000000004", "Supplier#000000002"), network=False, experimental=True), """SELECT s_nationkey AS scope, s_name AS id,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_name WHEN 'Supplier#000000004' THEN 1 WHEN 'Supplier#000000002' THEN 2 ELSE 3 END, s_suppkey % 3 = 0, s_suppkey) AS rank FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""")
_add("b10_provider_status", lambda s, d: _providers(s, d).select("id", rt.provider_status(F.col("installed"), F.col("enabled"), F.col("available"), ~F.col("experimental")).alias("status")),
     "SELECT s_name AS id, CASE WHEN s_acctbal <= 0 THEN 'not_installed' WHEN s_suppkey % 5 = 0 THEN 'disabled' WHEN s_suppkey % 7 = 0 THEN 'unavailable' WHEN s_suppkey % 3 = 0 THEN 'unhealthy' ELSE 'ok' END AS status FROM supplier")
_add("b11_promotion", lambda s, d: rt.promotion(load(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("current"), (F.col("p_partkey") % 5).alias("target"), (F.col("p_size") > 10).alias("tests"), (F.col("p_size") < 40).alias("docs"), F.col("p_brand").alias("license"), (F.col("p_partkey") % 4 == 0).alias("experimental"), (F.col("p_partkey") % 2 == 0).alias("benchmark_ok")), ("tests", "docs"), ("brand#11", "brand#12")),
     """WITH r AS (SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 5 <= p_partkey % 3 THEN 'not_an_upgrade' END, CASE WHEN NOT p_size > 10 THEN 'gate:tests' END, CASE WHEN NOT p_size < 40 THEN 'gate:docs' END, CASE WHEN p_partkey % 5 >= 3 AND lower(p_brand) IN ('brand#11', 'brand#12') THEN 'license_blocked' END,
  CASE WHEN p_partkey % 5 >= 3 AND p_partkey % 4 = 0 THEN 'still_experimental' END, CASE WHEN p_partkey % 5 >= 3 AND p_partkey % 2 <> 0 THEN 'benchmark_required' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part) SELECT id, reasons = '' AS allowed, reasons FROM r""")  # fmt: skip
_NEEDS = {"page_coverage": "vision_page", "formula_unresolved": "formula_recognition", "formula_structural_validity": "formula_recognition", "equation_number_preservation": "formula_recognition", "text_anchor_preservation": "layout", "placeholder_or_fake_url": "figure"}
_add("c15_plan_recovery", lambda s, d: rt.plan(checked(markdown(s, d)).select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.check_id", "c.status", "c.blocking"), _NEEDS, 2), _SRC + f""", {_CHECKS}, e AS (SELECT doc_id, unnest({_NAMES}) AS check_id, unnest(cs) AS status FROM v),
n AS (SELECT *, CASE check_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NEEDS.items())} END AS capability, CASE WHEN status = 'fail' THEN 0 ELSE 2 END AS severity FROM e WHERE status IN ('fail', 'warn')),
o AS (SELECT doc_id, capability, check_id, severity FROM n WHERE capability IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, capability ORDER BY severity, check_id) = 1)
SELECT doc_id, capability, check_id, row_number() OVER (PARTITION BY doc_id ORDER BY severity, check_id) AS rank FROM o QUALIFY rank <= 2""")
_add("e22_page_mode", lambda s, d: load(s, d, "documents").select("doc_id", rt.page_mode(F.col("n_chars") % 40, F.col("doc_id") % 6 == 0).alias("mode")),
     "SELECT doc_id, CASE WHEN n_chars % 40 <= 0 THEN 'skip' WHEN doc_id % 6 = 0 THEN 'page_reuse' WHEN n_chars % 40 = 1 THEN 'formula' WHEN n_chars % 40 < 8 THEN 'formula_batch' WHEN 40 * 1.2 < (n_chars % 40) * 2.65 THEN 'page' ELSE 'formula_batch' END AS mode FROM documents")
_add("g08_copy_consensus", lambda s, d: rt.copy_consensus(load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.expr("if(turn < 2, 'same', text)").alias("text"))), """WITH r AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn < 2 THEN 'same' ELSE text END AS text FROM conversations), p AS (SELECT doc_id, sha256(trim(text, ' ')) AS h, count(*) AS k, min(ord) AS first, max(length(trim(text, ' '))) AS n FROM r WHERE trim(text, ' ') <> '' GROUP BY 1, 2),
b AS (SELECT doc_id, first(h ORDER BY k DESC, first) AS h, max(k) AS k, sum(k) AS rounds, min(n) AS low, max(n) AS high FROM p GROUP BY doc_id)
SELECT doc_id, left(h, 16) AS hash, k >= 2 AS stable, CASE WHEN k >= 2 THEN '' WHEN rounds >= 2 AND high - low > greatest(800, floor(high * 0.08)) THEN 'EXTRACTION_UNSTABLE' ELSE '' END AS failure FROM b""")
_add("g10_page_sequence", lambda s, d: attempts(s, d).where("page is not null").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page"))), lambda x: x["page"]).alias("p")).select("doc", *[c.alias(n) for n, c in rt.page_sequence(F.col("p"), F.lit(1), F.lit(20)).items()]),
     """WITH a AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, CAST(json_extract(props, '$.k') AS INT) AS page FROM events), l AS (SELECT doc, list(page ORDER BY ord) AS p FROM a WHERE page IS NOT NULL GROUP BY doc)
SELECT doc, 20 - len(list_distinct(list_filter(p, lambda x: x BETWEEN 1 AND 20))) AS missing, len(list_distinct(list_filter(p, lambda x: x NOT BETWEEN 1 AND 20))) AS extra, len(p) - len(list_distinct(p)) AS repeated, p = list_sort(p) AS in_order FROM l""")  # fmt: skip

# Sequential operators: no SQL oracle; tests compare them with plain Python.
_add("h76_html_to_markdown", lambda s, d: sq.html_to_markdown(load(s, d, "pages")))
_add("k04_chunks", lambda s, d: sq.chunks(load(s, d, "documents"), 2000))
_add("h96_mend_json", lambda s, d: sq.mend_json(load(s, d, "events").select(F.col("event_id").alias("doc_id"), F.expr("substr(concat('{\"a\": [1, 2, ', props, '], \"b\": \"x\"}'), 1, cast(8 + event_id % 30 as int))").alias("text"))))
_add("h20_similarity", lambda s, d: sq.similarity(load(s, d, "documents").select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("en"), F.lit("an")).alias("b"))))
_add("c03_assign", lambda s, d: sq.assign(load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("i"), (F.col("l_partkey") % 4).alias("j"), F.col("l_quantity").alias("score")), 5.0))
_add("f10_non_overlapping", lambda s, d: sq.non_overlapping(load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity")).cast("long").alias("end"), F.col("l_discount").alias("score"))))
_add("m07_adaptive_replay", lambda s, d: sq.adaptive_replay(attempts(s, d)))
_add("e29_renumber", lambda s, d: sq.renumbered(load(s, d, "documents").select("doc_id", F.expr("concat('<!-- i', lpad(cast(doc_id % 100 as string), 4, '0'), ':f01 --> ', text)").alias("text")), 6))
