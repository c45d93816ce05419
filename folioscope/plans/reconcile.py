"""Queries over reconciling operators, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import gates as g
from folioscope.operators import blocks as bl
from folioscope.operators import reconcile as rc
from folioscope.plans.transcripts import _SRC as _TRANSCRIPTS
from folioscope.plans.transcripts import transcripts
from folioscope.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def _add(name: str, build, sql: str) -> None:
    QUERIES[name], ORACLES[name] = build, sql


def _lookup(s, d):
    docs = load(s, d, "documents").select((_c("doc_id") % 40).alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc", _c("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN concat('x', text) ELSE concat('none ', doc_id, text) END").alias("raw"))
    outcomes = docs.select("doc", F.expr("if(doc_id % 2 = 0, doc_id, -doc_id)").alias("oid"), F.expr("if(doc_id % 5 = 0, concat(doc_id, text), text)").alias("text"), F.expr("if(doc_id % 4 = 0, 'ok', 'bad')").alias("outcome"))
    return rc.tiered_lookup(rows, outcomes)


_LOOK = """WITH r AS (SELECT doc_id % 40 AS doc, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN concat('x', text) ELSE concat('none ', doc_id, text) END AS raw FROM documents),
o AS (SELECT doc_id % 40 AS doc, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END AS oid, CASE WHEN doc_id % 5 = 0 THEN concat(doc_id, text) ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN 'ok' ELSE 'bad' END AS outcome FROM documents),
t AS (SELECT doc, text, first(outcome ORDER BY oid) AS o2 FROM o GROUP BY doc, text), k AS (SELECT r.*, o.outcome AS o1, o2 FROM r LEFT JOIN o ON r.doc = o.doc AND r.id = o.oid LEFT JOIN t ON r.doc = t.doc AND r.raw = t.text),
n AS (SELECT k.doc, k.id, first(o.outcome ORDER BY oid) AS o3 FROM k JOIN o ON k.doc = o.doc AND length(k.raw) >= 24 AND length(o.text) >= 24 AND (contains(o.text, k.raw) OR contains(k.raw, o.text)) WHERE o1 IS NULL AND o2 IS NULL GROUP BY k.doc, k.id),
f AS (SELECT k.doc, k.id, coalesce(o1, o2, o3) AS outcome, CASE WHEN o1 IS NOT NULL THEN 1 WHEN o2 IS NOT NULL THEN 2 WHEN o3 IS NOT NULL THEN 3 END AS tier FROM k LEFT JOIN n ON k.doc = n.doc AND k.id = n.id) """
_add("c09_tiered_lookup", _lookup, _LOOK + "SELECT * FROM f")
_add("c10_counts_after", lambda s, d: rc.counts_after(_lookup(s, d)), _LOOK + "SELECT doc, count(*) AS n, count(*) FILTER (outcome = 'ok') AS recovered, count(*) FILTER (outcome <> 'ok') AS failed, count(*) FILTER (outcome IS NULL) AS unknown FROM f GROUP BY doc")
_add("c06_anchor_lookup", lambda s, d: rc.anchor_lookup(load(s, d, "orders").select(_c("o_orderkey").alias("qid"), (_c("o_custkey") % 100).alias("number"), (_c("o_orderkey") % 7).alias("page")), load(s, d, "part").select(_c("p_partkey").alias("aid"), (_c("p_partkey") % 100).alias("number"), (_c("p_partkey") % 7).alias("page"), (_c("p_size") > 25).alias("margin"), _c("p_size").alias("y"), _c("p_retailprice").alias("x"))),
     "SELECT o_orderkey AS qid, p_partkey AS aid FROM orders JOIN part ON o_custkey % 100 = p_partkey % 100 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY (p_partkey % 7 <> o_orderkey % 7)::INT, (p_size <= 25)::INT, p_partkey % 7, p_size, p_retailprice DESC, p_partkey) = 1")
_add("c24_alignment_conflicts", lambda s, d: rc.alignment_conflicts(load(s, d, "part").select(_c("p_partkey").alias("id"), (_c("p_partkey") % 50).alias("page"), _c("p_brand").alias("sig"), (_c("p_size") / 50.0).alias("score"))),
     "WITH i AS (SELECT p_partkey AS id, p_partkey % 50 AS page, p_brand AS sig, p_size / 50.0::DOUBLE AS score FROM part), b AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best FROM i WINDOW w AS (PARTITION BY page, sig)), x AS (SELECT *, sum((score >= best - 0.06::DOUBLE)::INT) OVER (PARTITION BY page, sig) AS near FROM b) SELECT id, near > 1 OR score < best AS blocked FROM x WHERE n > 1")
_docs = lambda s, d: load(s, d, "documents")
_add("g13_keep_verified", lambda s, d: rc.keep_verified(_docs(s, d).select("doc_id", "lang", "n_chars"), load(s, d, "labels").select("doc_id", (_c("quality") == 1).alias("verified"), F.lit("old").alias("lang"), _c("toxic").cast("long").alias("n_chars")), "doc_id", ("lang", "n_chars")),
     "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'old' ELSE lang END AS lang, CASE WHEN quality = 1 THEN toxic ELSE n_chars END AS n_chars, coalesce(quality = 1, false) AS verified FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_add("c27_review_queue", lambda s, d: rc.review_queue([_docs(s, d).select(F.expr("if(doc_id % 2 = 0, doc_id, -doc_id)").alias("doc_id"), "lang"), _docs(s, d).select("doc_id", F.lit("new").alias("lang"))], load(s, d, "labels").where("quality = 0"), "doc_id"),
     "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'new' END AS lang, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS source_rank FROM documents UNION ALL SELECT -doc_id, lang, 0 FROM documents WHERE doc_id % 2 <> 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
_add("c30_reviewed", lambda s, d: rc.reviewed(_docs(s, d).select("doc_id", F.lit("open").alias("status"), _c("lang").alias("text")), load(s, d, "labels").select("doc_id", F.when(_c("quality") == 1, "verify").otherwise("reject").alias("action"), F.lit("fixed").alias("text")), "doc_id"),
     "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'rejected' ELSE 'open' END AS status, CASE WHEN quality = 1 THEN 'fixed' ELSE lang END AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


def _batches(s, d):
    o = load(s, d, "orders")
    return o.select(_c("o_custkey").alias("run"), _c("o_orderkey").alias("id"), F.when(_c("o_orderstatus") == "F", "accepted").otherwise("open").alias("status"), (_c("o_orderkey") % 9000).cast("long").alias("chars"), (_c("o_orderkey") % 5 + 1).cast("int").alias("start_page"), (_c("o_orderkey") % 5 + 1 + _c("o_custkey") % 12).cast("int").alias("end_page"))


_B = "WITH b AS (SELECT o_custkey AS run, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS status, o_orderkey % 9000 AS chars, o_orderkey % 5 + 1 AS s, o_orderkey % 5 + 1 + o_custkey % 12 AS e FROM orders) "
_add("m10_batch_state", lambda s, d: rc.batch_state(_batches(s, d)), _B + "SELECT run, bool_and(status = 'accepted') AS complete, min(id) FILTER (status <> 'accepted') AS next_id, count(*) FILTER (status <> 'accepted') AS to_reset FROM b GROUP BY run")
_add("e27_split_for_retry", lambda s, d: rc.split_for_retry(_batches(s, d)), _B + ", x AS (SELECT *, CASE WHEN e - s + 1 > 5 THEN 5 ELSE 1 END AS w FROM b), u AS (SELECT run, id, e, w, unnest(range(s, e + 1, w)) AS start_page FROM x) SELECT run, id, start_page::INT AS start_page, least(start_page + w - 1, e)::INT AS end_page FROM u")
_add("e30_offsets", lambda s, d: rc.offsets(_batches(s, d), _c("chars")), _B + "SELECT run, id, coalesce(sum(chars) OVER (PARTITION BY run ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM b")
_add("d17_fidelity", lambda s, d: rc.fidelity(_batches(s, d), load(s, d, "customer").select(F.expr("if(c_custkey % 3 <> 0, c_custkey, -c_custkey - 1)").alias("run"), (_c("c_custkey") * 10).alias("final_chars"))),
     _B + ", t AS (SELECT run, sum(CASE WHEN status = 'accepted' THEN chars ELSE 0 END)::BIGINT AS source_chars FROM b GROUP BY run) SELECT run, source_chars, c_custkey * 10 AS final_chars, CASE WHEN source_chars <> 0 THEN c_custkey * 10.0 / source_chars END AS ratio FROM t LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON run = c_custkey")
_add("d19_seconds_summary", lambda s, d: rc.seconds_summary(load(s, d, "supplier").select(F.expr("if(s_suppkey % 3 = 0, null, s_acctbal)").alias("cold"), F.expr("if(s_suppkey % 2 = 0, null, 5D)").alias("loading"), F.expr("if(s_suppkey % 4 = 0, null, 7D)").alias("steady"), F.lit(1000.0).alias("total"))),
     "WITH s AS (SELECT coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, CASE WHEN s_suppkey % 2 <> 0 THEN 5 END, 0) AS cold, CASE WHEN s_suppkey % 4 <> 0 THEN 7 END AS steady FROM supplier) SELECT sum(cold) AS cold, sum(coalesce(steady, greatest(0, 1000 - cold))) AS steady, count(*) AS runs FROM s")
_add("d18_recognised", lambda s, d: rc.recognised(_docs(s, d).select(_c("doc_id").alias("doc"), (_c("n_chars") % 20).alias("total"), (_c("doc_id") % 25).alias("attempted"), (_c("doc_id") % 11).alias("succeeded"))), "SELECT doc_id AS doc, least(n_chars % 20, greatest(0, n_chars % 20 - doc_id % 25) + doc_id % 11) AS recognised FROM documents")
_LINES = ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src), "
_add("e05_marker_runs", lambda s, d: rc.marker_runs(bl.lines(transcripts(s, d)), r"^(?:\||\s*<!--)"), _TRANSCRIPTS + _LINES + r"n AS (SELECT *, regexp_matches(line, '^(?:\||\s*<!--)') AS m, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE trim(line) <> ''), k AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n WHERE m) SELECT doc_id, min(pos)::INT AS first, max(pos)::INT AS last, count(*) AS n FROM k GROUP BY doc_id, k HAVING count(*) >= 2")
_add("l31_without_repeats", lambda s, d: rc.without_repeats(bl.lines(transcripts(s, d)), r"^(?:\||\s*<!--)"), _TRANSCRIPTS + _LINES + r"m AS (SELECT *, regexp_matches(line, '^(?:\||\s*<!--)') AS m FROM l), b AS (SELECT *, last_value(CASE WHEN trim(line) <> '' THEN m END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m) SELECT doc_id, pos::INT AS pos, line FROM b WHERE NOT (m AND coalesce(p, false))")


def _clipped(s, d):
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    p = load(s, d, "part")
    seed = box(_c("p_partkey") % 100, _c("p_partkey") % 60, F.lit(80), F.lit(40))
    near = F.array(box(_c("p_partkey") % 90, _c("p_partkey") % 60 + _c("p_size") - 25, F.lit(60), F.lit(20)))
    return p.select("p_partkey", g.clipped_box(seed, near).alias("b")).select("p_partkey", "b.*")


_add("i06_clipped_box", _clipped, """WITH b AS (SELECT p_partkey, (p_partkey % 100)::DOUBLE AS x0, (p_partkey % 60)::DOUBLE AS y0, p_partkey % 100 + 80.0::DOUBLE AS x1, p_partkey % 60 + 40.0::DOUBLE AS y1, p_partkey % 90 AS nx, p_partkey % 60 + p_size - 25 AS ny FROM part),
c AS (SELECT *, least(x1, nx + 60) - greatest(x0, nx) >= 12 AND least(y1, ny + 20) - greatest(y0, ny) >= 6 AS near, 0.5::DOUBLE * (greatest(y0, ny) + least(y1, ny + 20)) AS mid, y0 + 20 <= ny + 10 AS above FROM b),
r AS (SELECT *, CASE WHEN near AND NOT above THEN greatest(y0, mid) ELSE y0 END AS r0, CASE WHEN near AND above THEN least(y1, mid) ELSE y1 END AS r1 FROM c) SELECT p_partkey, x0, CASE WHEN r1 <= r0 + 4 THEN y0 ELSE r0 END AS y0, x1, CASE WHEN r1 <= r0 + 4 THEN y1 ELSE r1 END AS y1 FROM r""")
