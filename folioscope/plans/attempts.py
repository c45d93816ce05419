"""Queries over the attempt log, with DuckDB oracles; names begin with inventory ids."""

from __future__ import annotations

from folioscope.operators import attempts as op
from folioscope.sources.tables import ATTEMPTS_SQL, attempts

_A = f"WITH {ATTEMPTS_SQL} "
_W = "PARTITION BY doc ORDER BY ord"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, operator, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(attempts(spark, sf_dir))
    ORACLES[name] = _A + sql


_add("d10_accept_curve", op.accept_curve, f""", c AS (SELECT *, sum(accepted::INT) OVER ({_W}) AS cum FROM attempts)
SELECT doc, count(*) AS n, sum(accepted::INT)::BIGINT AS n_accepted, min(ord) FILTER (accepted) AS first_accept, max(ord) FILTER (accepted) AS last_accept,
  CASE WHEN sum(accepted::INT) > 0 THEN sum(cum)::DOUBLE / (count(*) * sum(accepted::INT)) END AS auc FROM c GROUP BY doc""")
_add("d09_class_waste", op.class_waste, "SELECT doc, class, count(*) AS calls, sum(seconds) AS wasted_seconds FROM attempts WHERE NOT accepted GROUP BY doc, class")
_add("b49_document_profile", op.document_profile, """, p AS (SELECT doc, count(*) AS attempted, sum(accepted::INT)::BIGINT AS n_accepted, sum(seconds) AS total_seconds,
  max(CASE WHEN ord = 1 THEN seconds END) AS cold FROM attempts GROUP BY doc),
t AS (SELECT doc, class, k FROM (SELECT doc, class, count(*) AS k, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, min(ord)) AS r FROM attempts WHERE NOT accepted GROUP BY doc, class) WHERE r = 1)
SELECT doc, attempted, n_accepted, attempted - n_accepted AS rejected, n_accepted::DOUBLE / attempted AS accept_rate,
  CASE WHEN n_accepted > 0 THEN total_seconds / n_accepted END AS seconds_per_accept, CASE WHEN n_accepted > 0 THEN attempted::DOUBLE / n_accepted END AS calls_per_accept,
  CASE WHEN total_seconds > 1e-6 THEN n_accepted / total_seconds END AS efficiency,
  CASE WHEN cold >= 30 THEN 'cold_start_affected' WHEN n_accepted::DOUBLE / attempted >= 0.85 AND n_accepted >= 1 THEN 'healthy'
    WHEN k >= CASE WHEN attempted > n_accepted THEN greatest(2, floor(0.4 * (attempted - n_accepted))) ELSE 2 END THEN class || '_dominated'
    WHEN n_accepted::DOUBLE / attempted < 0.35 AND attempted >= 6 THEN 'low_yield' WHEN n_accepted::DOUBLE / attempted < 0.5 AND attempted - n_accepted >= 3 THEN 'low_yield' ELSE 'mixed' END AS profile
FROM p LEFT JOIN t USING (doc)""")
_add("e07_trajectory", op.trajectory, f"""SELECT doc, ord, ord - 1 AS tried, coalesce(sum(accepted::INT) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS won,
  ord - 1 - coalesce(max(CASE WHEN accepted THEN ord END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reject_streak,
  coalesce(avg(accepted::INT) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.5) AS recent_rate,
  avg(accepted::INT) OVER (PARTITION BY doc, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page_rate FROM attempts""")
_add("e13_clipped_average", op.clipped_average, """, l AS (SELECT doc, list(seconds ORDER BY ord) AS x FROM attempts WHERE accepted GROUP BY doc)
SELECT doc, len(x) AS samples, list_reduce(x, lambda s, v: 0.3::DOUBLE * least(v, 3.0::DOUBLE * s) + 0.7::DOUBLE * s, 2.65::DOUBLE) AS average FROM l""")
_S = f""", c AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({_W}) > 7200000000 THEN 1 ELSE 0 END AS cut FROM attempts),
n AS (SELECT *, sum(cut) OVER ({_W}) AS session FROM c),
s AS (SELECT doc, session::BIGINT AS session, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM n GROUP BY doc, session)"""
_add("e03_sessions", op.sessions, _S + " SELECT * FROM s")
_add("e03_latest_session", op.latest_session, _S + " SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY session DESC) = 1")
_add("e04_page_islands", op.page_islands, """, d AS (SELECT DISTINCT doc, page FROM attempts WHERE page IS NOT NULL), k AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM d)
SELECT doc, min(page) AS first_page, max(page) AS last_page FROM k GROUP BY doc, k""")
_add("e31_missing_pages", op.missing_pages, "SELECT doc, max(page) - min(page) + 1 - count(DISTINCT page) AS n_missing FROM attempts WHERE page IS NOT NULL GROUP BY doc")
_add("e19_budget_replay", op.budget_replay, """SELECT doc, k, CASE WHEN sum(accepted::INT) > 0 THEN count(*) FILTER (ord <= k AND accepted)::DOUBLE / sum(accepted::INT) END AS recall,
  count(*) FILTER (ord > k) AS calls_saved, coalesce(sum(seconds) FILTER (ord > k), 0) AS seconds_saved FROM attempts, (VALUES (4), (6), (8), (10)) t(k) GROUP BY doc, k""")
_add("e20_running_budget", op.running_budget, f""", s AS (SELECT *, coalesce(sum(seconds) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM attempts)
SELECT doc, ord, spent, CASE WHEN spent + seconds > 300 THEN 'hard' WHEN spent + seconds > 90 THEN 'soft' WHEN ord > 10 THEN 'calls' ELSE 'none' END AS stopped_by FROM s""")
_add("m09_breaker", op.breaker, f"""SELECT doc, ord, coalesce(max(class = 'error') OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked,
  max(seconds) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most_so_far FROM attempts""")
_add("g04_fingerprints", op.fingerprints, """SELECT sha256(lower(class) || '|' || coalesce(page::VARCHAR, '')) AS fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT doc) AS documents, sum(seconds) AS total_seconds FROM attempts WHERE NOT accepted GROUP BY 1""")
_add("d13_cost_audit", op.cost_audit, """, p AS (SELECT class, count(*) AS calls, sum(seconds) AS wasted FROM attempts WHERE NOT accepted GROUP BY class), s AS (SELECT *, wasted / sum(wasted) OVER () AS share FROM p)
SELECT class, calls, wasted, share, CASE WHEN share >= 0.35 THEN 'fix_first' WHEN share >= 0.25 THEN 'investigate' WHEN share >= 0.15 THEN 'watch' ELSE 'ignore' END AS advice FROM s""")
_add("d27_fastest_accept", op.fastest_accept, "SELECT page, avg(accepted::INT) AS accept_rate, first(event_id ORDER BY seconds, event_id) FILTER (accepted) AS fastest FROM attempts GROUP BY page")
_add("g06_first_by_key", op.first_by_key, "SELECT doc, class, page, min(ord) AS ord FROM attempts GROUP BY doc, class, page")
_add("g07_pending", op.pending, "SELECT doc, page FROM attempts WHERE page IS NOT NULL GROUP BY doc, page HAVING NOT bool_or(accepted)")
_add("e11_rank_moves", op.rank_moves, """, r AS (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY seconds DESC, ord) AS new_rank FROM attempts) SELECT doc, ord, new_rank, ord - new_rank AS move FROM r""")
_add("e01_collapse_repeats", op.collapse_repeats, f""", s AS (SELECT *, ord > 1 AND class IS NOT DISTINCT FROM lag(class) OVER ({_W}) AND page IS NOT DISTINCT FROM lag(page) OVER ({_W}) AS same FROM attempts)
SELECT doc, ord, row_number() OVER ({_W}) - 1 AS new_ord FROM s WHERE NOT same""")
_add("c07_neighbours", op.neighbours, f"SELECT doc, ord, lag(class) OVER ({_W}) AS before, lead(class) OVER ({_W}) AS after, accepted AND NOT lag(accepted) OVER ({_W}) AS recovered FROM attempts")
_add("c25_order_conflicts", op.order_conflicts, f""", f AS (SELECT doc, (page < lag(page) OVER ({_W}))::INT AS fall FROM attempts WHERE page IS NOT NULL)
SELECT doc, coalesce(sum(fall), 0)::BIGINT AS falls, coalesce(sum(fall), 0) > 0 AS conflict FROM f GROUP BY doc HAVING count(*) >= 2""")
_add("b19_retry_ladder", op.retry_ladder, """SELECT doc, CASE WHEN count(*) >= 8 AND sum(accepted::INT) = 0 THEN 'fail' WHEN count(*) >= 4 AND sum(accepted::INT) = 0 THEN 'warn' ELSE 'pass' END AS status FROM attempts GROUP BY doc""")
