"""Scans by month, dataset assembly, comparisons, cluster summaries, alerts and model-lab reports."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R


def plans(d: Spark) -> dict[str, str]:
    games, team = R.games(d), R.team_games(d)
    month = d.month_start("o_orderdate")
    return {
        "scan_month_chunks": f"""WITH m AS (SELECT DISTINCT {month} AS first_day FROM orders)
SELECT first_day, lead(first_day) OVER (ORDER BY first_day) AS next_day FROM m""",
        # later chunks win, then unfinished games drop out; the oldest input dates the set
        "dataset_assembly": f"""WITH {games}, chunks AS (SELECT game_id, kickoff, home, away, hs, aws, game_id % 3 AS chunk FROM games UNION ALL SELECT game_id, kickoff, home, away, hs + 1, aws, 3 FROM games WHERE game_id % 10 = 0),
latest AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY chunk DESC) AS r FROM chunks)
SELECT game_id, home, away, hs, aws FROM latest WHERE r = 1 AND hs IS NOT NULL AND aws IS NOT NULL""",
        "dataset_quality": """SELECT count(*) AS chunks, round(avg(CASE WHEN n >= 100 THEN 1e0 ELSE 0e0 END), 6) AS success_ratio, min(first_seen) AS data_as_of
FROM (SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS first_seen FROM orders GROUP BY o_orderpriority) AS c""",
        "sports_model_lab": f"""WITH {games} SELECT league, count(*) AS finished, count(*) < 30 AS early_season, round(avg(CASE WHEN hs > aws THEN 1e0 ELSE 0e0 END), 6) AS home_rate, round(avg(CASE WHEN hs = aws THEN 1e0 ELSE 0e0 END), 6) AS draw_rate,
  round(1e0 - power(avg(CASE WHEN hs > aws THEN 1e0 ELSE 0e0 END), 2) - power(avg(CASE WHEN hs = aws THEN 1e0 ELSE 0e0 END), 2) - power(avg(CASE WHEN hs < aws THEN 1e0 ELSE 0e0 END), 2), 6) AS base_brier FROM games GROUP BY league""",
        "sports_venue_rates": f"""WITH {games}, {team} SELECT league, team, round(avg(CASE WHEN is_home = 1 THEN gf END), 6) AS home_for, round(avg(CASE WHEN is_home = 0 THEN gf END), 6) AS away_for,
  round({P.shrink("avg(CASE WHEN is_home = 1 THEN result END)", "sum(is_home)", "0.5e0", "6e0")}, 6) AS home_result FROM team_games GROUP BY league, team""",
        "text_novelty": f"""WITH {R.articles(d)}, h AS (SELECT id, published, md5(lower(title)) AS k FROM articles), o AS (SELECT k, min(published) AS first_seen FROM h GROUP BY k)
SELECT h.id, CASE WHEN o.first_seen < h.published THEN 0 ELSE 1 END AS novel FROM h JOIN o ON o.k = h.k""",
        "entity_cooccurrence": """WITH w AS (SELECT o_custkey AS event, o_orderpriority AS entity FROM orders), p AS (SELECT DISTINCT event, entity FROM w)
SELECT a.entity AS src, b.entity AS dst, count(*) AS evidence, round(count(*) / 1000e0, 6) AS weight FROM p a JOIN p b ON b.event = a.event AND a.entity < b.entity GROUP BY a.entity, b.entity""",
        "alert_triggers_once": """SELECT o_custkey AS alert, o_orderkey AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_totalprice > 100000e0) AS x WHERE r = 1""",
        "season_start": f"""WITH {games}, newest AS (SELECT league, max_by(season, kickoff) AS season FROM games GROUP BY league) SELECT n.league, n.season, min(g.kickoff) AS start FROM newest n JOIN games g ON g.league = n.league AND g.season = n.season GROUP BY n.league, n.season""",
        "trader_profile": """WITH t AS (SELECT user_id AS trader, ts, event_id, value - 50e0 AS pnl FROM events)
SELECT trader, count(*) AS n, round(avg(CASE WHEN pnl > 0e0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(sum(CASE WHEN pnl > 0e0 THEN pnl ELSE 0e0 END) / nullif(-sum(CASE WHEN pnl < 0e0 THEN pnl ELSE 0e0 END), 0e0), 5) AS profit_factor,
  round(avg(pnl), 6) AS expectancy, round(avg(pnl) / nullif(stddev_pop(pnl), 0e0), 6) AS sharpe FROM t GROUP BY trader""",
        "trader_drawdown": """WITH t AS (SELECT user_id AS trader, sum(value - 50e0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity, ts, event_id FROM events),
p AS (SELECT trader, equity, max(equity) OVER (PARTITION BY trader ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM t) SELECT trader, round(max(greatest(peak, 0e0) - equity), 4) AS max_drawdown FROM p GROUP BY trader""",
        "integrity_checks": f"""WITH {R.predictions(d)} SELECT 'probabilities sum to one' AS rule, count(*) AS broken FROM (SELECT id, sum(p) AS s FROM predictions GROUP BY id) AS x WHERE abs(s - 1e0) > 0.000001e0
UNION ALL SELECT 'order has a customer', count(*) FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL UNION ALL SELECT 'finished has price', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NULL""",
    }
