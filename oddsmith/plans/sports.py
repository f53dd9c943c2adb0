"""Team ratings' closed forms, score matrices and every betting market derived from them, odds comparison, settlement."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R
from oddsmith.plans.core import devig_power

def plans(d: Spark) -> dict[str, str]:
    games, team = R.games(d), R.team_games(d)
    cells, raw = R.matrix(d), R.matrix(d, -0.13, normalised=False)
    rec = "WITH RECURSIVE" if d.name == "duckdb" else "WITH"
    odds = """game_odds AS (SELECT g.game_id AS gid, b.book AS book, g.game_id * 10 + b.book AS id, k.key AS key, k.ord AS ord, 1.5e0 + CAST((g.game_id * k.m + b.book * 13) % 45 AS DOUBLE) / 10e0 AS odds
  FROM games g CROSS JOIN (VALUES (1), (2), (3)) AS b(book) CROSS JOIN (VALUES ('home', 0, 3), ('draw', 1, 7), ('away', 2, 11)) AS k(key, ord, m))"""
    return {
        "sports_league_means": f"WITH {games} SELECT league, season, round(avg(hs), 6) AS home_goals, round(avg(aws), 6) AS away_goals, count(*) AS n FROM games GROUP BY league, season",
        "sports_team_rates": f"""WITH {games}, {team}, m AS (SELECT league, avg(gf) AS mean FROM team_rows GROUP BY league)
SELECT t.league, t.team, round({P.shrink("avg(t.gf) / min(m.mean)", "count(*)", "1e0", "6e0")}, 6) AS attack, round({P.shrink("avg(t.ga) / min(m.mean)", "count(*)", "1e0", "6e0")}, 6) AS defence,
  round(least(greatest((min(m.mean) + 0.125e0) * avg(t.gf) / min(m.mean), 0.05e0), 6e0), 6) AS lambda_home
FROM team_games t JOIN m ON m.league = t.league GROUP BY t.league, t.team""",
        "sports_dc_matrix": f"WITH {raw} SELECT pair, CAST(h AS BIGINT) AS h, CAST(a AS BIGINT) AS a, round(p, 9) AS p FROM cells",
        "sports_dc_matrix_normalised": f"WITH {cells} SELECT pair, CAST(h AS BIGINT) AS h, CAST(a AS BIGINT) AS a, round(p, 9) AS p FROM cells",
        "sports_dc_outcomes": f"""WITH {raw} SELECT pair, round(sum(CASE WHEN h > a THEN p ELSE 0e0 END) / sum(p), 6) AS home, round(sum(CASE WHEN h = a THEN p ELSE 0e0 END) / sum(p), 6) AS draw,
  round(sum(CASE WHEN h < a THEN p ELSE 0e0 END) / sum(p), 6) AS away, round(sum(CASE WHEN h + a > 2 THEN p ELSE 0e0 END) / sum(p), 6) AS over25, round(sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0e0 END) / sum(p), 6) AS btts FROM cells GROUP BY pair""",
        "sports_expected_goals": f"WITH {R.rates(d)} SELECT league, home, away, round(lh, 6) AS lh, round(la, 6) AS la FROM pairs",
        "sports_dc_weights": f"""WITH {games}, w AS (SELECT league, home, away, hs, aws, exp(-0.0065e0 * (max(kickoff) OVER (PARTITION BY league) - kickoff) / 86400000e0) AS w FROM games)
SELECT league, round(sum(w * (hs + aws)) / (2e0 * sum(w)), 6) AS mu, round(sum(w * hs) / sum(w * aws), 6) AS home_ratio, round(sum(w), 6) AS effective FROM w GROUP BY league""",
        "sports_absence_impact": f"""WITH {games}, {team}, x AS (SELECT team, avg(CASE WHEN game_id % 3 = 0 THEN gf END) AS without_p, avg(CASE WHEN game_id % 3 <> 0 THEN gf END) AS with_p,
    avg(CASE WHEN game_id % 3 = 0 THEN CASE WHEN gf > ga THEN 1e0 ELSE 0e0 END END) AS w0, avg(CASE WHEN game_id % 3 <> 0 THEN CASE WHEN gf > ga THEN 1e0 ELSE 0e0 END END) AS w1,
    count(CASE WHEN game_id % 3 = 0 THEN 1 END) AS n0, count(CASE WHEN game_id % 3 <> 0 THEN 1 END) AS n1 FROM team_games GROUP BY team)
SELECT team, CASE WHEN least(n0, n1) < 4 THEN NULL ELSE round(least(0.8e0, n0 / (n0 + 6e0)) * (without_p - with_p) / nullif(with_p, 0e0) * 100e0, 5) END AS goals_pct,
  CASE WHEN least(n0, n1) < 4 THEN NULL ELSE round(least(0.8e0, n0 / (n0 + 6e0)) * (w0 - w1) * 100e0, 5) END AS win_pp FROM x""",
        "sports_season_start": f"WITH {games} SELECT league, max_by(season, kickoff) AS newest, min(kickoff) AS first_kickoff FROM games GROUP BY league",
        "sports_league_board": f"""WITH {games}, s AS (SELECT *, kickoff > 883612800000 AS upcoming, row_number() OVER (PARTITION BY league ORDER BY CASE WHEN kickoff > 883612800000 THEN 0 ELSE 1 END, kickoff, game_id) AS rk FROM games)
SELECT league, game_id, rk <= 12 AS predicted FROM s WHERE upcoming AND rk <= 20""",
        "sports_settle": f"""WITH {games}, p AS (SELECT game_id, kickoff - (game_id % 5 - 1) * 86400000 AS generated_at FROM games)
SELECT CASE WHEN g.hs IS NULL THEN 'pending' WHEN p.generated_at > g.kickoff THEN 'skipped' WHEN g.hs > g.aws THEN 'home' WHEN g.hs = g.aws THEN 'draw' ELSE 'away' END AS outcome, count(*) AS n
FROM p LEFT JOIN games g ON g.game_id = p.game_id GROUP BY 1""",
        "bets_1x2_double_chance": f"""WITH {cells}, o AS (SELECT pair, sum(CASE WHEN h > a THEN p ELSE 0e0 END) AS hw, sum(CASE WHEN h = a THEN p ELSE 0e0 END) AS dr, sum(CASE WHEN h < a THEN p ELSE 0e0 END) AS aw, sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0e0 END) AS btts FROM cells GROUP BY pair)
SELECT pair, round(hw, 6) AS home, round(dr, 6) AS draw, round(aw, 6) AS away, round(hw + dr, 6) AS home_or_draw, round(hw + aw, 6) AS home_or_away, round(dr + aw, 6) AS draw_or_away, round(hw / (hw + aw), 6) AS dnb_home, round(dr, 6) AS dnb_push, round(btts, 6) AS btts FROM o""",
        "bets_totals": f"""WITH {cells} SELECT pair, t.side, t.line, round(sum(CASE WHEN x.g > t.line THEN p ELSE 0e0 END) / nullif(sum(CASE WHEN x.g <> t.line THEN p ELSE 0e0 END), 0e0), 6) AS over_p, round(sum(CASE WHEN x.g = t.line THEN p ELSE 0e0 END), 6) AS push
FROM (SELECT pair, p, 'match' AS side, h + a AS g FROM cells UNION ALL SELECT pair, p, 'home', h FROM cells UNION ALL SELECT pair, p, 'away', a FROM cells) AS x
JOIN (VALUES ('match', 0.5e0), ('match', 1.5e0), ('match', 2.5e0), ('match', 3.0e0), ('match', 3.5e0), ('match', 4.5e0), ('home', 0.5e0), ('home', 1.5e0), ('home', 2.5e0), ('away', 0.5e0), ('away', 1.5e0), ('away', 2.5e0)) AS t(side, line) ON t.side = x.side GROUP BY pair, t.side, t.line""",
        "bets_correct_scores": f"""WITH {cells}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(p, 12) DESC, h, a) AS rk FROM cells)
SELECT pair, CAST(h AS BIGINT) AS h, CAST(a AS BIGINT) AS a, CAST(rk AS BIGINT) AS rk, round(p, 6) AS p, round(1e0 - sum(p) OVER (PARTITION BY pair), 6) AS remainder FROM r WHERE rk <= 8""",
        "bets_expected_goals": f"WITH {cells} SELECT pair, round(sum(h * p), 6) AS home_goals, round(sum(a * p), 6) AS away_goals FROM cells GROUP BY pair",
        # a quarter line is two half stakes on the adjacent half lines
        "bets_asian_handicap": f"""WITH {cells}, lines AS (SELECT {d.series(-8, 8)} AS q), l AS (SELECT q / 4e0 AS line, CASE WHEN abs(q) % 2 = 0 THEN q / 4e0 ELSE (q - 1) / 4e0 END AS lo, CASE WHEN abs(q) % 2 = 0 THEN q / 4e0 ELSE (q + 1) / 4e0 END AS hi FROM lines),
s AS (SELECT c.pair, l.line, c.p, sign(h - a + l.lo) + sign(h - a + l.hi) AS outcome FROM cells c CROSS JOIN l),
g AS (SELECT pair, line, sum(CASE WHEN outcome = 2e0 THEN p ELSE 0e0 END) AS fw, sum(CASE WHEN outcome = 1e0 THEN p ELSE 0e0 END) AS hw, sum(CASE WHEN outcome = 0e0 THEN p ELSE 0e0 END) AS push, sum(CASE WHEN outcome = -1e0 THEN p ELSE 0e0 END) AS hl, sum(CASE WHEN outcome = -2e0 THEN p ELSE 0e0 END) AS fl FROM s GROUP BY pair, line)
SELECT pair, line, round(fw, 6) AS full_win, round(hw, 6) AS half_win, round(push, 6) AS push, round(hl, 6) AS half_loss, round(fl, 6) AS full_loss, round(1e0 + (fl + hl / 2e0) / nullif(fw + hw / 2e0, 0e0), 5) AS fair_odds FROM g""",
        "bets_european_handicap": f"""WITH {cells} SELECT pair, CAST(l.line AS BIGINT) AS line, round(sum(CASE WHEN h + l.line > a THEN p ELSE 0e0 END), 6) AS home, round(sum(CASE WHEN h + l.line = a THEN p ELSE 0e0 END), 6) AS draw, round(sum(CASE WHEN h + l.line < a THEN p ELSE 0e0 END), 6) AS away
FROM cells CROSS JOIN (VALUES (-2), (-1), (1), (2)) AS l(line) GROUP BY pair, l.line""",
        "odds_book_comparison": f"""{rec} {games}, {odds}, {devig_power(d, "game_odds")}, per AS (SELECT o.gid, v.key, min(v.ord) AS ord, {d.quantile("v.fair", 0.5)} AS med, max(v.odds) AS best, {d.quantile("v.odds", 0.5)} AS med_odds FROM devig v JOIN (SELECT DISTINCT gid, id FROM game_odds) AS o ON o.id = v.id GROUP BY o.gid, v.key),
m AS (SELECT *, med / sum(med) OVER (PARTITION BY gid) AS market, CAST((gid * 3 + ord * 7) % 50 + 20 AS DOUBLE) / 120e0 AS model FROM per)
SELECT gid, key, round(market, 6) AS market, round(model - market, 6) AS edge, best, med_odds, CASE WHEN model - market > 0e0 AND model > 1e0 / best THEN round(least(0.02e0, 0.25e0 * {P.kelly_fraction("model", "best")}), 6) END AS stake FROM m""",
    }
