"""Queries that write documents, reports, catalogues, manifests, lines and texts and read them back, with DuckDB oracles over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.sources import json_io as js
from folioscope.sources.scratch import scratch
from folioscope.sources.tables import load
from folioscope.sources.texts import read_texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def _add(name: str, build, sql: str) -> None:
    QUERIES[name], ORACLES[name] = build, sql


def _each(df, path: str) -> str:
    """Every row as a JSON file of its own."""
    df.write.option("maxRecordsPerFile", 1).json(path)
    return path


def _documents(spark, sf_dir):
    block = "named_struct('id', concat('b', {0}), 'type', '{1}', 'content', {2}, 'page', {0}, 'reading_order', {0}, 'provider', lang, 'attributes', map('n', cast(n_chars as string)))"
    blocks = f"array({block.format(0, 'heading', 'source')}, {block.format(1, 'text', 'text')})"
    docs = load(spark, sf_dir, "documents").select(_c("doc_id").cast("string").alias("source"), _c("lang").alias("title"), F.lit(None).cast("string").alias("schema_version"), F.expr(blocks).alias("blocks"), F.lit("dropped").alias("qa"))
    path = scratch(spark, "documents")
    js.write_documents(docs, path)
    return js.read_lines(spark, path, js.DOCUMENT)


_add("a02_documents", lambda s, d: _documents(s, d).select("source", "title", "schema_version", F.size("blocks").cast("long").alias("n_blocks"), _c("_corrupt_record").isNull().alias("whole")),
     "SELECT doc_id::VARCHAR AS source, lang AS title, '1.0' AS schema_version, 2 AS n_blocks, true AS whole FROM documents")
_add("a01_document_blocks", lambda s, d: js.blocks(_documents(s, d)).select("source", "pos", "id", "type", F.md5("content").alias("content"), "page", "provider", F.element_at("attributes", "n").alias("n")),
     "SELECT doc_id::VARCHAR AS source, p AS pos, 'b' || p AS id, CASE p WHEN 0 THEN 'heading' ELSE 'text' END AS type, md5(CASE p WHEN 0 THEN source ELSE text END) AS content, p AS page, lang AS provider, n_chars::VARCHAR AS n FROM documents, (VALUES (0), (1)) t(p)")


def _markdown(documents):
    """Documents as text: the blocks' contents in reading order, headings marked."""
    part = lambda b: F.when(b["type"] == "heading", F.concat(F.lit("# "), b["content"])).otherwise(b["content"])
    ordered = F.array_sort("blocks", lambda a, b: F.coalesce(a["reading_order"], F.lit(0)) - F.coalesce(b["reading_order"], F.lit(0)))
    return documents.select("source", F.array_join(F.transform(ordered, part), "\n\n").alias("markdown"))


_add("a04_markdown", lambda s, d: _markdown(_documents(s, d)).select("source", F.md5("markdown").alias("markdown")), "SELECT doc_id::VARCHAR AS source, md5('# ' || source || chr(10) || chr(10) || text) AS markdown FROM documents")


def _reports(spark, sf_dir):
    old = "r_regionkey % 2 = 0"
    check = "named_struct('check_id', r_name, 'status', 'pass', 'severity', '', 'blocking', if(r_regionkey > 2, false, null), 'score', r_regionkey / 2D)"
    rows = load(spark, sf_dir, "region").selectExpr(f"if({old}, r_name, null) as verdict", f"if({old}, null, r_name) as status", f"if({old}, array('w'), null) as reasons", f"if({old}, null, array('x', 'y')) as warnings", f"array({check}) as checks", "1 as unknown")
    return js.reports(spark, _each(rows, scratch(spark, "reports")))


_add("a05_reports", lambda s, d: _reports(s, d).select("status", F.array_join("warnings", ",").alias("warnings"), _c("checks")[0]["blocking"].alias("blocking"), _c("checks")[0]["score"].alias("score")),
     "SELECT r_name AS status, CASE WHEN r_regionkey % 2 = 0 THEN 'w' ELSE 'x,y' END AS warnings, r_regionkey <= 2 AS blocking, r_regionkey / 2.0::DOUBLE AS score FROM region")


def _catalog(spark, sf_dir):
    case = "struct(n_name as id, if(n_nationkey % 2 = 0, 'scan', 'other') as suite, array('formula', 'unknown') as tags, n_name as fixture, cast(n_nationkey as int) as page_count, if(n_nationkey % 3 = 0, 'FAILED', null) as expect_status)"
    rows = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr(f"collect_list({case})").alias("cases")).select("cases")  # nations of a region
    return js.catalog(spark, _each(rows, scratch(spark, "catalog")))


_add("a08_catalog", lambda s, d: _catalog(s, d).select("id", "suite", F.array_join("tags", ",").alias("tags"), "page_count", "expect_status"),
     "SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'scan' ELSE 'academic' END AS suite, 'formula' AS tags, n_nationkey AS page_count, CASE WHEN n_nationkey % 3 = 0 THEN 'FAILED' ELSE 'DONE_VERIFIED' END AS expect_status FROM nation")


def _gold(spark, sf_dir):
    base = load(spark, sf_dir, "nation").selectExpr("n_name as id", "array(n_name) as anchors", "array('1', '2') as ids")
    over = load(spark, sf_dir, "nation").selectExpr("n_name as id", "if(n_nationkey % 2 = 0, array('a', 'b'), array()) as anchors", "if(n_nationkey % 3 = 0, array('9'), null) as ids")
    schema, paths = "id string, anchors array<string>, ids array<string>", [_each(x, scratch(spark, "gold")) for x in (base, over)]
    return js.overlay(*[js.read_json(spark, p, schema) for p in paths], "id", ("anchors", "ids"))


_add("a09_gold_overlay", lambda s, d: _gold(s, d).select("id", F.array_join("anchors", ",").alias("anchors"), F.array_join("ids", ",").alias("ids")),
     "SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE n_name END AS anchors, CASE WHEN n_nationkey % 3 = 0 THEN '9' ELSE '1,2' END AS ids FROM nation")


def _manifest(spark, sf_dir):
    batch = "struct(cast(n_nationkey as int) as id, cast(n_nationkey * 5 as int) as start_page, cast(n_nationkey * 5 + 4 as int) as end_page, if(n_nationkey % 2 = 0, 'accepted', 'pending') as status, n_name as text)"
    rows = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr(f"collect_list({batch})").alias("batches")).selectExpr("if(n_regionkey % 2 = 0, '2.0', null) as schema_version", "'1.0' as schema", "batches")
    return js.batches(spark, _each(rows, scratch(spark, "manifest")))


_add("a12_manifest", lambda s, d: _manifest(s, d).select("schema_version", "id", "start_page", "end_page", "status", "text"),
     "SELECT CASE WHEN n_regionkey % 2 = 0 THEN '2.0' ELSE '1.0' END AS schema_version, n_nationkey AS id, n_nationkey * 5 AS start_page, n_nationkey * 5 + 4 AS end_page, CASE WHEN n_nationkey % 2 = 0 THEN 'accepted' ELSE 'pending' END AS status, n_name AS text FROM nation")
_add("a24_next_batch", lambda s, d: js.next_pending(_manifest(s, d)).select("id", "status"), "SELECT n_nationkey AS id, 'pending' AS status FROM nation WHERE n_nationkey % 2 = 1 ORDER BY n_nationkey LIMIT 1")


def _lines(spark, sf_dir):
    path = scratch(spark, "lines")
    rows = load(spark, sf_dir, "customer").select(F.to_json(F.struct(_c("c_custkey").alias("id"), _c("c_name").alias("name"))).alias("line"), "c_custkey")
    rows.select(F.when(_c("c_custkey") % 10 == 3, F.lit("{broken")).when(_c("c_custkey") % 10 == 4, "").otherwise(_c("line")).alias("value")).write.text(path)
    return js.read_lines(spark, path, "id long, name string")


_add("a15_lines", lambda s, d: _lines(s, d).select("id", "name", _c("_corrupt_record").alias("broken")), "SELECT CASE WHEN c_custkey % 10 <> 3 THEN c_custkey END AS id, CASE WHEN c_custkey % 10 <> 3 THEN c_name END AS name, CASE WHEN c_custkey % 10 = 3 THEN '{broken' END AS broken FROM customer WHERE c_custkey % 10 <> 4")


def _texts(spark, sf_dir):
    path = scratch(spark, "texts")
    load(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" é 日本")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_texts(spark, path).where(F.regexp(_c("path"), F.lit("part-")))


_add("a28_texts", lambda s, d: _texts(s, d).select("text", "encoding", "mark"), "SELECT n_name || ' é 日本' || chr(10) AS text, 'utf-8-sig' AS encoding, '' AS mark FROM nation")
