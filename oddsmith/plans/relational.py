"""Reads of the prediction store, joins, aggregations, windows, ranking and set operations."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R


def plans(d: Spark) -> dict[str, str]:
    pred, outs, games, team = R.predictions(d), R.model_outputs(d), R.games(d), R.team_games(d)
    first_max = "row_number() OVER (PARTITION BY id ORDER BY p DESC, ord)"
    return {
        # reads of the store (QRY)
        "latest_prediction": f"""WITH {pred}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY generated_at DESC, id DESC) AS rn FROM predictions)
SELECT subject, key, id, round(p, 6) AS p, confidence FROM ranked WHERE rn = 1""",
        "list_predictions": f"""WITH {pred}, heads AS (SELECT DISTINCT id, subject, generated_at, confidence, is_demo FROM predictions)
SELECT id, subject, confidence FROM heads
WHERE confidence >= 0.5e0 AND NOT is_demo AND generated_at >= TIMESTAMP '1995-01-01 00:00:00' AND subject % 2 = 0
ORDER BY generated_at DESC, id DESC LIMIT 50 OFFSET 10""",
        "unsettled_queue": """SELECT o_orderkey AS id, o_orderdate AS generated_at FROM orders
WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 200""",
        "resolved_predictions": f"""WITH {pred}, outcomes AS (SELECT o_orderkey AS oid, o_orderstatus AS actual_key FROM orders WHERE o_orderstatus <> 'P')
SELECT p.id, p.key, round(p.p, 6) AS p, o.actual_key FROM predictions p JOIN outcomes o ON o.oid = p.id
WHERE NOT p.is_demo AND p.generated_at >= TIMESTAMP '1997-06-01 00:00:00'""",
        "settle_outcome": f"""WITH {pred}
SELECT id, round(sum(power(p - CASE WHEN key = actual THEN 1e0 ELSE 0e0 END, 2)), 6) AS brier,
  round(-ln({P.clamp_probability("max(CASE WHEN key = actual THEN p END)")}), 6) AS log_loss,
  max(p) <= max(CASE WHEN key = actual THEN p END) AS was_correct
FROM predictions GROUP BY id""",
        "model_performance": f"""WITH {R.predictions(d)}, {outs}, per AS (
  SELECT id, model, sum(power(p - CASE WHEN key = actual THEN 1e0 ELSE 0e0 END, 2)) AS brier,
    -ln(greatest(max(CASE WHEN key = actual THEN p END), 1e-12)) AS log_loss,
    max(CASE WHEN rk = 1 AND key = actual THEN 1e0 ELSE 0e0 END) AS hit
  FROM (SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY p DESC, ord) AS rk FROM model_outputs WHERE NOT abstained) AS x GROUP BY id, model)
SELECT model, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss, round(avg(hit), 6) AS accuracy FROM per GROUP BY model""",
        "list_markets": f"""WITH {R.quotes(d)}
SELECT market, venue, round(p, 6) AS p, updated FROM quotes WHERE volume > 20000e0 AND venue % 3 = 0 ORDER BY updated DESC, market, venue LIMIT 100""",
        "dislocations_from_links": f"""WITH {R.quotes(d)}, grouped AS (
  SELECT market, count(*) AS n_quotes, max(p) - min(p) AS spread, max_by(venue, p * 1000 - venue * 1e-6) AS highest, min_by(venue, p * 1000 + venue * 1e-6) AS lowest
  FROM quotes GROUP BY market)
SELECT market, n_quotes, round(spread, 6) AS spread, highest, lowest FROM grouped WHERE n_quotes >= 2 AND spread >= 0.03e0""",
        "public_prediction_view": f"""WITH {R.predictions(d)}, {outs}, members AS (SELECT c_custkey AS org FROM customer WHERE c_mktsegment = 'BUILDING'),
voting AS (SELECT id, count(DISTINCT model) AS n_models FROM model_outputs WHERE NOT abstained GROUP BY id),
listed AS (SELECT id, {d.join(d.collect("concat(key, '=', CAST(CAST(round(p * 1000) AS BIGINT) AS VARCHAR(20)))"), ";")} AS outcomes FROM predictions GROUP BY id)
SELECT h.id, l.outcomes, coalesce(v.n_models, 0) AS n_models
FROM (SELECT DISTINCT id, subject FROM predictions) AS h JOIN listed l ON l.id = h.id LEFT JOIN voting v ON v.id = h.id
WHERE h.subject IN (SELECT org FROM members) OR h.subject <= 3""",
        "row_visibility": """WITH ranks AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('MACHINERY', 3), ('HOUSEHOLD', 4)) AS t(tier, r))
SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN ranks r ON r.tier = c.c_mktsegment
WHERE r.r >= (SELECT r FROM ranks WHERE tier = 'FURNITURE') AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3)""",
        # projections and filters (FLT)
        "finished_games": f"""WITH {games} SELECT game_id, kickoff, home, away, hs, aws FROM games
WHERE hs IS NOT NULL AND aws IS NOT NULL AND kickoff <= 852076800000""",
        "team_view": f"""WITH {games}, {team} SELECT league, team, game_id, is_home, opponent, gf, ga, result, ago FROM team_games WHERE ago < 15""",
        "nested_membership": f"""SELECT doc_id FROM documents WHERE {d.contains(d.split("lower(text)", " "), "'the'")}""",
        # joins (JN)
        "join_hash_inner": f"""WITH {pred} SELECT c.c_nationkey, count(*) AS n, round(avg(p.p), 6) AS mean_p FROM predictions p JOIN customer c ON c.c_custkey = p.subject GROUP BY c.c_nationkey""",
        "join_skip_abstained": f"""WITH {R.predictions(d)}, {outs} SELECT p.id, p.key, count(*) AS voters, round(avg(m.p), 6) AS mean_p
FROM predictions p JOIN model_outputs m ON m.id = p.id AND m.key = p.key WHERE NOT m.abstained GROUP BY p.id, p.key""",
        "join_left_default": """SELECT s.source, s.n, coalesce(r.reliability, 'SECONDARY') AS reliability
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) AS s
LEFT JOIN (VALUES ('src0', 'OFFICIAL'), ('src1', 'PRIMARY'), ('src2', 'SOCIAL')) AS r(source, reliability) ON r.source = s.source""",
        "join_latest_per_key": """WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c.c_custkey, l.o_orderkey, l.o_totalprice FROM customer c LEFT JOIN last l ON l.o_custkey = c.c_custkey AND l.rn = 1""",
        "join_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000e0)",
        "join_anti": "SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000e0)",
        # |kickoff difference| <= 3 h with agreement of both names, one match only; the range is bucketed so that it is an equi-join
        "join_fuzzy_range_unique": f"""WITH {games}, feed AS (
  SELECT game_id + 1000000 AS event, kickoff + (game_id % 9 - 4) * 3600000 AS at_ms, home, away FROM games WHERE game_id % 3 > 0),
wide AS (SELECT event, at_ms, home, away, CAST(floor(at_ms / 10800000e0) AS BIGINT) + s AS b FROM feed CROSS JOIN (VALUES (-1), (0), (1)) AS t(s)),
matched AS (
  SELECT g.game_id, w.event, count(*) OVER (PARTITION BY g.game_id) AS n
  FROM games g JOIN wide w ON w.b = CAST(floor(g.kickoff / 10800000e0) AS BIGINT) AND w.home = g.home AND w.away = g.away AND abs(w.at_ms - g.kickoff) <= 10800000)
SELECT game_id, event FROM matched WHERE n = 1""",
        "join_asof_backward": f"""WITH u AS (
  SELECT user_id AS k, {d.epoch_ms("ts")} AS t, event_id AS q, CAST(NULL AS DOUBLE) AS x, 1 AS side FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, {d.epoch_ms("ts")}, event_id, value, 0 FROM events WHERE event_type = 'purchase'),
f AS (SELECT q, side, last_value(x{" IGNORE NULLS" if d.name == "duckdb" else ", true"}) OVER (PARTITION BY k ORDER BY t, side, q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM u)
SELECT q AS event_id, round(x, 6) AS last_purchase FROM f WHERE side = 1""",
        "join_band_overlap": f"""WITH {R.bars(d, 86_400_000)}, levels AS (SELECT asset, max_by(c, open_time) AS level FROM bars GROUP BY asset)
SELECT b.asset, count(*) AS touches, round(sum(b.v), 4) AS volume FROM bars b JOIN levels x ON x.asset = b.asset
  AND b.l <= x.level * 1.005e0 AND b.h >= x.level * 0.995e0 GROUP BY b.asset""",
        "join_broadcast_lookup": """SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name""",
        "join_parse_key": f"""WITH subjects AS (SELECT concat('game:league:', CAST(n_regionkey AS VARCHAR(20)), ':', CAST(n_nationkey AS VARCHAR(20))) AS s FROM nation)
SELECT s, {d.regex_one("s", "^game:(.+):([^:]+)$", 1)} AS league, n.n_name FROM subjects
JOIN nation n ON CAST(n.n_nationkey AS VARCHAR(20)) = {d.regex_one("s", "^game:(.+):([^:]+)$", 2)}""",
        "join_pair_history": f"""WITH {games}
SELECT least(home, away) AS a, greatest(home, away) AS b, count(*) AS n,
  count(CASE WHEN (home < away AND hs > aws) OR (home > away AND aws > hs) THEN 1 END) AS a_wins, count(CASE WHEN hs = aws THEN 1 END) AS draws
FROM (SELECT DISTINCT home, away, kickoff, hs, aws FROM games) AS g GROUP BY 1, 2""",
        # aggregations (AGG)
        "agg_count_sum_mean": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
        "agg_count_distinct": "SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
        "agg_conditional": "SELECT l_returnflag, count(CASE WHEN l_quantity > 25e0 THEN 1 END) AS big, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS open FROM lineitem GROUP BY l_returnflag",
        "agg_leading_outcome": f"WITH {pred} SELECT id, key AS leading, round(p, 6) AS p FROM (SELECT *, {first_max} AS rk FROM predictions) AS x WHERE rk = 1",
        "agg_mode_first_seen": """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first_seen FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT c_nationkey, c_mktsegment AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first_seen) AS rk FROM n) AS x WHERE rk = 1""",
        "agg_median": f"SELECT event_type, round({d.quantile('value', 0.5)}, 6) AS median FROM events GROUP BY event_type",
        "agg_quantile_linear": f"SELECT l_returnflag, round({d.quantile('l_extendedprice', 0.25)}, 6) AS q1, round({d.quantile('l_extendedprice', 0.75)}, 6) AS q3, round({d.quantile('l_extendedprice', 0.9)}, 6) AS p90 FROM lineitem GROUP BY l_returnflag",
        "agg_midrank": """SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 + count(*) OVER (PARTITION BY c_nationkey, c_acctbal) / 2e0)
  / count(*) OVER (PARTITION BY c_nationkey), 6) AS midrank FROM customer""",
        "agg_weighted_mean": "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_discount FROM lineitem GROUP BY l_suppkey",
        "agg_inverse_simpson": "SELECT l_suppkey, round(power(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 6) AS effective FROM lineitem GROUP BY l_suppkey",
        "agg_entropy": f"WITH {pred} SELECT id, round(-sum(CASE WHEN p > 0e0 THEN p * ln(p) ELSE 0e0 END) / ln(3e0), 6) AS entropy FROM predictions GROUP BY id",
        "agg_histogram_fixed": f"""WITH {pred}, bins AS (SELECT {d.series(0, 9)} AS bin), seen AS (
  SELECT least(CAST(floor(p * 10e0) AS BIGINT), 9) AS bin, count(*) AS n FROM predictions GROUP BY 1)
SELECT CAST(b.bin AS BIGINT) AS bin, coalesce(s.n, 0) AS n FROM bins b LEFT JOIN seen s ON s.bin = b.bin""",
        "agg_custom_buckets": f"""WITH {pred} SELECT b.lo, b.hi, count(*) AS n, round(avg(CASE WHEN p.key = p.actual THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM (SELECT *, {first_max} AS rk FROM predictions) AS p
JOIN (VALUES (0e0, 0.3e0), (0.3e0, 0.5e0), (0.5e0, 0.65e0), (0.65e0, 0.8e0), (0.8e0, 0.9e0), (0.9e0, 1.0001e0)) AS b(lo, hi) ON p.confidence >= b.lo AND p.confidence < b.hi
WHERE p.rk = 1 GROUP BY b.lo, b.hi""",
        "agg_stdev": "SELECT event_type, round(coalesce(stddev_pop(value), 0e0), 6) AS sd_pop, round(coalesce(stddev_samp(value), 0e0), 6) AS sd_samp FROM events GROUP BY event_type",
        "agg_collect_ordered": f"SELECT n_regionkey, {d.join(d.collect('n_name'), ',')} AS names FROM nation GROUP BY n_regionkey",
        "agg_geometric_weighted": "SELECT l_suppkey, round(power(avg(l_quantity), 0.5e0) * power(avg(l_extendedprice), 0.25e0) * power(1e0 + avg(l_tax), 0.15e0) * power(1e0 + avg(l_discount), 0.1e0), 6) AS score FROM lineitem GROUP BY l_suppkey",
        "agg_rollup": """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
        # windows (WIN)
        "window_lag_returns": f"""WITH {R.bars(d)} SELECT asset, rn, CASE WHEN c > 0e0 AND lag(c) OVER w > 0e0 THEN round(ln(c / lag(c) OVER w), 6) ELSE 0e0 END AS r
FROM bars WINDOW w AS (PARTITION BY asset ORDER BY rn)""",
        "window_flips": f"""WITH {R.bars(d)}, m AS (
  SELECT asset, rn, avg(c) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fast,
    CASE WHEN rn >= 20 THEN avg(c) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS slow FROM bars),
x AS (SELECT asset, rn, round(fast, 9) AS f, round(slow, 9) AS s, lag(round(fast, 9)) OVER (PARTITION BY asset ORDER BY rn) AS pf, lag(round(slow, 9)) OVER (PARTITION BY asset ORDER BY rn) AS ps FROM m)
SELECT asset, rn, CASE WHEN pf <= ps AND f > s THEN 'bullish' ELSE 'bearish' END AS cross FROM x WHERE (pf <= ps AND f > s) OR (pf >= ps AND f < s)""",
        "window_walk_forward_base_rate": f"""WITH {games}, s AS (
  SELECT league, game_id, CASE WHEN hs > aws THEN 1e0 ELSE 0e0 END AS y, row_number() OVER (PARTITION BY league ORDER BY kickoff, game_id) AS rn FROM games),
folds AS (SELECT *, CAST(floor((rn - 1 - 120) / 40e0) AS BIGINT) AS fold, CAST(count(*) OVER (PARTITION BY league) AS BIGINT) AS n FROM s),
cum AS (SELECT league, rn, avg(y) OVER (PARTITION BY league ORDER BY rn ROWS UNBOUNDED PRECEDING) AS base FROM s)
SELECT f.league, f.fold, count(*) AS n, round(avg(power(c.base - f.y, 2)), 6) AS brier FROM folds f JOIN cum c ON c.league = f.league AND c.rn = 120 + f.fold * 40
WHERE f.rn > 120 GROUP BY f.league, f.fold""",
        # sorts, limits, sets (RNK, SET)
        "rank_orders_multi": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, abs(o_totalprice - 150000e0), o_orderkey LIMIT 100",
        "topk_per_group": "SELECT o_custkey, o_orderkey, CAST(rk AS BIGINT) AS rk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) AS x WHERE rk <= 3",
        "nulls_last_order": f"WITH {games} SELECT game_id, CASE WHEN game_id % 4 = 0 THEN NULL ELSE kickoff END AS ending FROM games ORDER BY ending ASC NULLS LAST, game_id LIMIT 50",
        "set_union_all": "SELECT CAST(c_custkey AS BIGINT) AS k, 'customer' AS side FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'supplier' FROM supplier",
        "set_distinct_two_stage": f"""WITH a AS (SELECT doc_id, source, lower(substr(text, 1, 40)) AS head, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS first_url FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY doc_id DESC) AS first_print FROM a WHERE first_url = 1)
SELECT doc_id, source FROM b WHERE first_print = 1 OR n < 3""",
        "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
        "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000e0",
    }
