"""Registered plans over all fixtures that need ratings replayed game by game; their oracles replay them recursively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import DUCK, SPARK, Spark
from oddsmith.operators import fixtures, ratings
from oddsmith.plans import relations


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    from oddsmith.plans.catalog import register

    register(spark, sf_dir, text)
    return spark.sql(text)


def _rounded(df: DataFrame, places: int) -> DataFrame:
    from oddsmith.plans.custom import _rounded as rounded

    return rounded(df, places)


class _Season:
    """Games, both sides of them, and the ratings before and after each, of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        from oddsmith.plans.custom import _stored

        self.games = _sql(spark, sf_dir, f"WITH {relations.games(SPARK)} SELECT * FROM games")
        expected = _sql(spark, sf_dir, f"WITH {relations.expected_goals(SPARK)} SELECT * FROM expected")
        self.views = _stored(fixtures.team_views(self.games, expected), "views")
        self.history = _stored(ratings.elo_history(self.games), "elo-history")

    def pairs(self) -> DataFrame:
        return self.games.select("league", "home", "away").distinct()

    def form(self) -> DataFrame:
        return fixtures.form(self.views, self.history)


def sports_form_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Season(spark, sf_dir).form()
    return _rounded(found.select("league", "team", "n", "xg_games", "raw", fixtures.form_score(found["raw"]).alias("score")), 6)


def sports_form_league_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.league_form(_Season(spark, sf_dir).form())
    return _rounded(found.selectExpr("league", "team", f"n < {fixtures.LEAST_GAMES} AS insufficient", "score"), 5)


def sports_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    return _rounded(fixtures.two_model_predictions(season.pairs(), season.games, season.views, season.history), 5)


def sports_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    return _rounded(fixtures.counterfactual_factors(season.pairs(), ratings.batch_elo(season.games), fixtures.league_form(season.form())), 5)


def sports_team_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    missing = _sql(spark, sf_dir, f"WITH {relations.absences(SPARK)} SELECT * FROM absences")
    return _rounded(fixtures.team_strength(season.games, season.views, season.history, missing), 5)


def sports_strength_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    return _rounded(fixtures.strength_percentiles(season.views, season.history), 5)


def sports_learned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratings.learned_features(_sql(spark, sf_dir, f"WITH {relations.games(SPARK)} SELECT * FROM games")), 5)


def sports_compare_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    return _rounded(fixtures.compared_teams(season.views, season.history), 5)


def sports_decayed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _sql(spark, sf_dir, f"WITH {relations.games(SPARK)} SELECT * FROM games")
    return _rounded(ratings.decayed_rates(fixtures.team_views(games)), 5)


def sports_elo_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _sql(spark, sf_dir, f"WITH {relations.games(SPARK)} SELECT * FROM games")
    return _rounded(fixtures.rating_chances(games.select("league", "home", "away").distinct(), ratings.batch_elo(games)), 5)


def sports_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = _Season(spark, sf_dir)
    return _rounded(fixtures.match_factors(season.games, season.views, season.history, ratings.batch_elo(season.games)), 5)


REGISTERED = (sports_decayed_features, sports_elo_davidson, sports_factors, sports_compare_teams, sports_form_score, sports_form_league_scaled, sports_two_models, sports_counterfactuals, sports_team_strength, sports_strength_percentile, sports_learned_features)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def elo_replay(d: Spark, step: str, home: str) -> str:
    """CTEs games, g, rec: a league's state after each game is a list of ratings and one of games played, a place for each of the 25 nations."""
    gain = f"({step}) * (CASE WHEN g.hs > g.aws THEN 1e0 WHEN g.hs = g.aws THEN 0.5e0 ELSE 0e0 END - 1e0 / (1e0 + power(10e0, -(s.r[g.home + 1] + {home} - s.r[g.away + 1]) / 400e0)))"
    return f"""{relations.games(d)}, g AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY kickoff, game_id) AS k FROM games),
rec AS (SELECT DISTINCT league, CAST(0 AS BIGINT) AS k, list_transform(range(25), lambda x: 1500e0) AS r, list_transform(range(25), lambda x: CAST(0 AS BIGINT)) AS n, CAST(NULL AS BIGINT) AS game_id, CAST(0 AS INT) AS home, CAST(0 AS INT) AS away, 0e0 AS a, 0e0 AS b, 0e0 AS step FROM g
  UNION ALL SELECT league, k, list_transform(r, lambda v, i: v + CASE WHEN i = home + 1 THEN step WHEN i = away + 1 THEN -step ELSE 0e0 END), list_transform(n, lambda v, i: v + CASE WHEN i IN (home + 1, away + 1) THEN 1 ELSE 0 END), game_id, home, away, a, b, step
  FROM (SELECT s.league, g.k, s.r, s.n, g.game_id, g.home, g.away, s.r[g.home + 1] AS a, s.r[g.away + 1] AS b, {gain} AS step FROM rec s JOIN g ON g.league = s.league AND g.k = s.k + 1))"""


#: The step that shrinks with experience, as SQL over the recursion's state.
ADAPTIVE = "(40e0 + 20e0 * exp(-s.n[g.home + 1] / 25e0) + 20e0 * exp(-s.n[g.away + 1] / 25e0)) / 2e0 * ln(1e0 + greatest(1, abs(g.hs - g.aws))) / ln(2e0)"
CONSTANT = "20e0 * sqrt(greatest(1, abs(g.hs - g.aws)))"


def _form_ctes(d: Spark) -> str:
    sq = lambda x: f"(1e0 / (1e0 + exp(-2e0 * ({x}) / 3e0)))"  # noqa: E731  half of one plus the hyperbolic tangent
    return f"""{elo_replay(d, ADAPTIVE, "65e0")}, {relations.expected_goals(d)},
sides AS (SELECT g.league, g.game_id, g.kickoff, g.home AS team, g.away AS opponent, g.hs AS gf, g.aws AS ga, x.home_xg AS xf, x.away_xg AS xa, r.a AS own, r.b AS other, r.step AS step FROM games g JOIN rec r USING (league, game_id) LEFT JOIN expected x USING (game_id)
  UNION ALL SELECT g.league, g.game_id, g.kickoff, g.away, g.home, g.aws, g.hs, x.away_xg, x.home_xg, r.b, r.a, -r.step FROM games g JOIN rec r USING (league, game_id) LEFT JOIN expected x USING (game_id)),
latest AS (SELECT *, CASE WHEN gf > ga THEN 1e0 WHEN gf = ga THEN 0.5e0 ELSE 0e0 END AS result, row_number() OVER (PARTITION BY league, team ORDER BY kickoff DESC, game_id DESC) - 1 AS ago, count(*) OVER (PARTITION BY league, team) AS played FROM sides),
parts AS (SELECT *, exp(-0.18e0 * ago) AS w, 0.4e0 * result + 0.25e0 * {sq("gf - ga")} + 0.2e0 / (1e0 + power(10e0, (1500e0 - other) / 400e0)) AS three FROM latest WHERE ago < 15),
form AS (SELECT league, team, count(*) AS n, count(xf) AS xg_games, avg(gf) AS scored, avg(ga) AS conceded, sum(w * CASE WHEN xf IS NULL THEN three / 0.85e0 ELSE three + 0.15e0 * {sq("xf - xa")} END) / sum(w) AS raw FROM parts GROUP BY league, team)"""


def _rate_outcomes(name: str, source: str, home: str, away: str, where: str) -> str:
    """CTE name(league, home, away, hp, dp, ap): a score matrix of two rates, cell by cell."""
    tau = "CASE WHEN i = 0 AND j = 0 THEN 1e0 + 0.13e0 * x * y WHEN i = 0 AND j = 1 THEN 1e0 - 0.13e0 * x WHEN i = 1 AND j = 0 THEN 1e0 - 0.13e0 * y WHEN i = 1 AND j = 1 THEN 1.13e0 ELSE 1e0 END"
    return f"""{name} AS (SELECT league, home, away, sum(p) FILTER (i > j) / sum(p) AS hp, sum(p) FILTER (i = j) / sum(p) AS dp, sum(p) FILTER (i < j) / sum(p) AS ap
  FROM (SELECT league, home, away, i, j, exp(-x - y) * power(x, i) * power(y, j) / factorial(CAST(i AS INT)) / factorial(CAST(j AS INT)) * {tau} AS p FROM (SELECT league, home, away, {home} AS x, {away} AS y FROM {source} WHERE {where}), range(11) AS h(i), range(11) AS a(j)) GROUP BY league, home, away)"""


def oracle_sql() -> dict[str, str]:
    d = DUCK
    form = _form_ctes(d)
    score = "100e0 / (1e0 + exp(-(raw - 0.5e0) / 0.12e0))"
    scaled = f"""spread AS (SELECT league, count(*) AS teams, quantile_cont(raw, 0.5) AS mid, quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25) AS gap FROM form GROUP BY league),
scores AS (SELECT f.league, f.team, f.n, 100e0 / (1e0 + exp(-CASE WHEN teams < 4 OR gap <= 1e-9 THEN (raw - 0.5e0) / 0.12e0 ELSE (raw - mid) * 2e0 * ln(3e0) / gap END)) AS score FROM form f JOIN spread USING (league))"""
    logit = lambda p: f"ln({p} / (1e0 - {p}))"
    mean = "(m.hg + m.ag) / 2e0"
    shrunk = lambda c, n: f"({c} / ({mean}) * {n} + 6e0) / ({n} + 6e0)"
    rate = lambda base, x, y: f"least(6e0, greatest(0.05e0, ({base}) * {x} * {y}))"
    two = f"""{form}, m AS (SELECT league, avg(hs) AS hg, avg(aws) AS ag FROM games GROUP BY league), rated AS (SELECT league, team, own + step AS rating, played FROM latest WHERE ago = 0),
met AS (SELECT league, team AS home, opponent AS away, count(*) AS meetings, avg(result) AS share FROM latest GROUP BY league, team, opponent),
pairs AS (SELECT DISTINCT league, home, away FROM games),
x AS (SELECT p.league, p.home, p.away, {rate(f"{mean} + 0.125e0", shrunk("fh.scored", "fh.n"), shrunk("fa.conceded", "fa.n"))} AS rate_home, {rate(f"{mean} - 0.125e0", shrunk("fa.scored", "fa.n"), shrunk("fh.conceded", "fh.n"))} AS rate_away,
    greatest(0.1e0, (m.hg + m.ag + (rh.rating + 65e0 - ra.rating) / 175e0) / 2e0) AS bridge_home, greatest(0.1e0, (m.hg + m.ag - (rh.rating + 65e0 - ra.rating) / 175e0) / 2e0) AS bridge_away,
    least(fh.n, fa.n) AS sample, least(rh.played, ra.played) AS rated, fh.raw AS raw_h, fa.raw AS raw_a, rh.rating AS rh, ra.rating AS ra, fh.n AS nh, fa.n AS na, fh.xg_games = fh.n AND fa.xg_games = fa.n AS xg, t.meetings, t.share
  FROM pairs p JOIN m USING (league) JOIN form fh ON fh.league = p.league AND fh.team = p.home JOIN form fa ON fa.league = p.league AND fa.team = p.away
  JOIN rated rh ON rh.league = p.league AND rh.team = p.home JOIN rated ra ON ra.league = p.league AND ra.team = p.away LEFT JOIN met t ON t.league = p.league AND t.home = p.home AND t.away = p.away),
{_rate_outcomes("by_rates", "x", "rate_home", "rate_away", "sample >= 5")}, {_rate_outcomes("by_bridge", "x", "bridge_home", "bridge_away", "rated >= 5")},
votes AS (SELECT * FROM by_rates UNION ALL SELECT * FROM by_bridge),
outs AS (SELECT league, home, away, key, avg({logit("p")}) AS z, stddev_pop({logit("p")}) AS sd, count(*) AS voters FROM (SELECT league, home, away, unnest(['h', 'd', 'a']) AS key, unnest([hp, dp, ap]) AS p FROM votes) GROUP BY league, home, away, key),
won AS (SELECT league, home, away, max(voters) AS voters, avg(sd) AS sd, sum(exp(z)) FILTER (key = 'h') / sum(exp(z)) AS hp, sum(exp(z)) FILTER (key = 'd') / sum(exp(z)) AS dp, sum(exp(z)) FILTER (key = 'a') / sum(exp(z)) AS ap FROM outs GROUP BY league, home, away),
y AS (SELECT x.*, coalesce(hp, 1e0 / 3e0) AS hp, coalesce(dp, 1e0 / 3e0) AS dp, coalesce(ap, 1e0 / 3e0) AS ap, coalesce(voters, 0) AS voters, CASE WHEN voters IS NULL THEN 0e0 WHEN voters = 1 THEN 1e0 ELSE 1e0 - least(1e0, sd / 2.2e0) END AS agreement,
    ((nh >= 5)::INT + (na >= 5)::INT + 1 + (meetings IS NOT NULL)::INT + xg::INT) / 5e0 AS complete FROM x LEFT JOIN won USING (league, home, away)),
z AS (SELECT *, CAST(floor(100e0 * (0.45e0 * complete + 0.55e0 * sample / (sample + 6e0)) + 0.5e0) AS BIGINT) AS dq, CASE WHEN ap > hp AND ap > dp THEN -1e0 ELSE 1e0 END AS toward, hp + 0.5e0 * dp AS prior FROM y)"""
    venues = """venues AS (SELECT league, team, v.venue, CASE WHEN count(*) FILTER (at_home = v.is_home) >= 3 THEN avg(CASE result WHEN 1 THEN 3e0 WHEN 0.5 THEN 1e0 ELSE 0e0 END) FILTER (at_home = v.is_home) END AS points
  FROM (SELECT l.*, g.home = l.team AS at_home FROM latest l JOIN games g USING (league, game_id) WHERE ago < 15), (VALUES ('home', true), ('away', false)) AS v(venue, is_home) GROUP BY league, team, v.venue, v.is_home)"""
    weigh = lambda parts: "(" + " + ".join(f"coalesce({w} * {p}, 0)" for p, w in parts.items()) + ") / (" + " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w} END" for p, w in parts.items()) + ")"
    share = lambda x, than, by="": f"(SELECT 100e0 * (count(*) FILTER (o.{x} {than} u.{x}) + 0.5e0 * count(*) FILTER (o.{x} = u.{x})) / nullif(count(o.{x}), 0) FROM u o WHERE o.league = u.league {by} AND u.{x} IS NOT NULL HAVING count(o.{x}) >= 4)"
    scale = lambda raw: f"100e0 / (1e0 + exp(-CASE WHEN teams < 4 OR gap <= 1e-9 THEN ({raw} - 0.5e0) / 0.12e0 ELSE ({raw} - mid) * 2e0 * ln(3e0) / gap END))"
    return {
        "sports_team_strength": f"""WITH RECURSIVE {form}, {venues}, {relations.absences(d)}, lost AS (SELECT team, sum(CASE status WHEN 'out' THEN 1 WHEN 'suspended' THEN 1 WHEN 'doubtful' THEN 0.6 WHEN 'questionable' THEN 0.35 WHEN 'probable' THEN 0.15 ELSE 0 END) AS burden FROM absences GROUP BY team),
m AS (SELECT league, (avg(hs) + avg(aws)) / 2e0 AS mean FROM games GROUP BY league), trend AS (SELECT league, team, CASE WHEN count(*) >= 4 THEN least(100e0, greatest(0e0, 50e0 + 50e0 * (avg(result) FILTER (ago < 3) - avg(result) FILTER (ago >= 3)))) END AS momentum FROM parts GROUP BY league, team),
x AS (SELECT f.league, f.team, v.venue, 100e0 / (1e0 + exp(-2e0 * (f.scored / mean - 1e0))) AS attack, 100e0 / (1e0 + exp(-2e0 * (1e0 - f.conceded / mean))) AS defence, {score} AS form, greatest(0e0, 100e0 - 12e0 * coalesce(burden, 0)) AS health, v.points / 0.03e0 AS home_away, momentum
  FROM form f JOIN m USING (league) JOIN venues v ON v.league = f.league AND v.team = f.team JOIN trend t ON t.league = f.league AND t.team = f.team LEFT JOIN lost l ON l.team = f.team)
SELECT league, team, venue, round(attack, 5) AS attack, round(defence, 5) AS defence, round(form, 5) AS form, round(health, 5) AS health, round(home_away, 5) AS home_away, round(momentum, 5) AS momentum,
  round({weigh({"attack": 0.22, "defence": 0.22, "form": 0.18, "health": 0.12, "home_away": 0.1, "momentum": 0.1})}, 5) AS strength FROM x""",
        "sports_strength_percentile": f"""WITH RECURSIVE {form}, {venues}, {scaled}, brief AS (SELECT league, team, sum(w * CASE WHEN xf IS NULL THEN three / 0.85e0 ELSE three + 0.15e0 / (1e0 + exp(-2e0 * (xf - xa) / 3e0)) END) / sum(w) AS raw5 FROM parts WHERE ago < 5 GROUP BY league, team),
u AS (SELECT f.league, f.team, v.venue, f.n, round(f.scored, 9) AS scored, round(f.conceded, 9) AS conceded, round(v.points, 9) AS points, {scale("f.raw")} AS score, {scale("b.raw5")} AS score5 FROM form f JOIN spread USING (league) JOIN brief b ON b.league = f.league AND b.team = f.team JOIN venues v ON v.league = f.league AND v.team = f.team),
x AS (SELECT league, team, venue, {share("scored", "<", "AND o.venue = u.venue")} AS attack, {share("conceded", ">", "AND o.venue = u.venue")} AS defence, CASE WHEN n >= 5 THEN score END AS form, {share("points", "<", "AND o.venue = u.venue")} AS home_away,
    CASE WHEN n >= 8 THEN least(100e0, greatest(0e0, 50e0 + (score5 - score) / 2e0)) END AS momentum FROM u)
SELECT league, team, venue, round(attack, 5) AS attack, round(defence, 5) AS defence, round(form, 5) AS form, round(home_away, 5) AS home_away, round(momentum, 5) AS momentum,
  round({weigh({"attack": 0.22, "defence": 0.22, "form": 0.2, "home_away": 0.14, "momentum": 0.1})}, 5) AS strength FROM x""",
        "sports_learned_features": f"""WITH RECURSIVE {elo_replay(d, "20e0", "60e0")},
both_sides AS (SELECT league, game_id, kickoff, home AS team, true AS at_home, CASE WHEN hs > aws THEN 3 WHEN hs = aws THEN 1 ELSE 0 END AS points, hs - aws AS margin FROM games
  UNION ALL SELECT league, game_id, kickoff, away, false, CASE WHEN aws > hs THEN 3 WHEN hs = aws THEN 1 ELSE 0 END, aws - hs FROM games),
u AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY kickoff, game_id) AS k, row_number() OVER (PARTITION BY league, team, at_home ORDER BY kickoff, game_id) AS j, lag(kickoff) OVER (PARTITION BY league, team ORDER BY kickoff, game_id) AS last FROM both_sides),
means AS (SELECT u.league, u.team, u.game_id, sum(power(0.92e0, u.k - 1 - o.k) * o.points) / sum(power(0.92e0, u.k - 1 - o.k)) AS p, sum(power(0.92e0, u.k - 1 - o.k) * o.margin) / sum(power(0.92e0, u.k - 1 - o.k)) AS g,
    max(o.j) FILTER (o.at_home) AS nh, max(o.j) FILTER (NOT o.at_home) AS na, sum(power(0.92e0, -o.j) * o.points) FILTER (o.at_home) / sum(power(0.92e0, -o.j)) FILTER (o.at_home) AS ph, sum(power(0.92e0, -o.j) * o.points) FILTER (NOT o.at_home) / sum(power(0.92e0, -o.j)) FILTER (NOT o.at_home) AS pa
  FROM u JOIN u o ON o.league = u.league AND o.team = u.team AND o.k < u.k GROUP BY u.league, u.team, u.game_id),
s AS (SELECT u.league, u.game_id, u.team, u.k, u.kickoff, least(14e0, greatest(0e0, coalesce((u.kickoff - u.last) / 86400000e0, 14e0))) AS rest, coalesce(p, 1.35e0) AS p, coalesce(ph, 1.5e0) AS ph, coalesce(pa, 1.2e0) AS pa, coalesce(g, 0e0) AS g FROM u LEFT JOIN means m USING (league, team, game_id))
SELECT r.league, r.game_id, h.kickoff, CASE WHEN x.hs > x.aws THEN 0 WHEN x.hs = x.aws THEN 1 ELSE 2 END AS outcome, round(least(1.5e0, greatest(-1.5e0, (r.a - r.b) / 400e0)), 5) AS elo_diff, round(least(1e0, greatest(-1e0, (h.p - a.p) / 3e0)), 5) AS points_diff,
  round(least(1e0, greatest(-1e0, (h.ph - a.pa) / 3e0)), 5) AS venue_diff, round(least(1e0, greatest(-1e0, (h.g - a.g) / 3e0)), 5) AS goals_diff, round((h.rest - a.rest) / 14e0, 5) AS rest_diff
FROM rec r JOIN games x USING (league, game_id) JOIN s h ON h.league = r.league AND h.game_id = r.game_id AND h.team = r.home JOIN s a ON a.league = r.league AND a.game_id = r.game_id AND a.team = r.away WHERE r.k > 0 AND h.k > 5 AND a.k > 5""",
        "sports_decayed_features": f"""WITH {relations.games(d)}, s AS (SELECT league, home AS team, game_id, kickoff, hs AS gf, aws AS ga FROM games UNION ALL SELECT league, away, game_id, kickoff, aws, hs FROM games),
k AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY kickoff, game_id) AS k FROM s)
SELECT a.league, a.team, a.game_id, round(sum(power(0.92e0, a.k - 1 - b.k) * b.gf) / sum(power(0.92e0, a.k - 1 - b.k)), 5) AS scored, round(sum(power(0.92e0, a.k - 1 - b.k) * b.ga) / sum(power(0.92e0, a.k - 1 - b.k)), 5) AS conceded
FROM k a JOIN k b ON b.league = a.league AND b.team = a.team AND b.k < a.k WHERE a.k > 5 GROUP BY a.league, a.team, a.game_id""",
        "sports_elo_davidson": f"""WITH {relations.games(d)}, plain AS ({_batch_ratings(d)}), q AS (SELECT p.league, p.home, p.away, h.rating + 60e0 - a.rating AS diff FROM (SELECT DISTINCT league, home, away FROM games) p JOIN plain h ON h.league = p.league AND h.team = p.home JOIN plain a ON a.league = p.league AND a.team = p.away),
e AS (SELECT *, 1e0 / (1e0 + power(10e0, -diff / 400e0)) AS e FROM q), x AS (SELECT *, 0.85e0 * sqrt(e * (1e0 - e)) AS dr FROM e)
SELECT league, home, away, round(e / (1e0 + dr), 5) AS home_win, round(dr / (1e0 + dr), 5) AS draw, round((1e0 - e) / (1e0 + dr), 5) AS away_win, round(diff / 175e0, 5) AS goal_diff FROM x""",
        "sports_factors": f"""WITH RECURSIVE {form}, plain AS ({_batch_ratings(d)}), now AS (SELECT league, max(kickoff) AS now FROM games GROUP BY league),
t AS (SELECT f.league, f.team, {score} AS score, p.rating, l.kickoff AS last FROM form f JOIN plain p ON p.league = f.league AND p.team = f.team JOIN latest l ON l.league = f.league AND l.team = f.team AND l.ago = 0),
met AS (SELECT league, team, opponent, count(*) AS n, count(*) FILTER (gf > ga) AS wins FROM latest GROUP BY league, team, opponent),
q AS (SELECT p.league, p.home, p.away, h.score - a.score AS gap, h.rating - a.rating AS diff, (now - h.last) / 86400000e0 AS rh, (now - a.last) / 86400000e0 AS ra, coalesce(m.n, 0) AS n, coalesce(m.wins, 0) AS wins
  FROM (SELECT DISTINCT league, home, away FROM games) p JOIN t h ON h.league = p.league AND h.team = p.home JOIN t a ON a.league = p.league AND a.team = p.away JOIN now w ON w.league = p.league LEFT JOIN met m ON m.league = p.league AND m.team = p.home AND m.opponent = p.away)
SELECT league, home, away, round(gap / 400e0, 5) AS form, round(0.5e0 / (1e0 + power(10e0, -diff / 400e0)) - 0.25e0, 5) AS elo, round(0.5e0 / (1e0 + power(10e0, -(diff + 60e0) / 400e0)) - 0.5e0 / (1e0 + power(10e0, -diff / 400e0)), 5) AS venue,
  round(least(0.03e0, greatest(-0.03e0, (wins + 3e0) / (n + 6e0) - 0.5e0)), 5) AS h2h, round(least(0.02e0, greatest(-0.02e0, 0.004e0 * (least(14e0, rh) - least(14e0, ra)))), 5) AS rest FROM q""",
        "sports_compare_teams": f"""WITH RECURSIVE {form}, t AS (SELECT f.league, f.team, scored, conceded, {score} AS score, l.own + l.step AS rating FROM form f JOIN latest l ON l.league = f.league AND l.team = f.team AND l.ago = 0),
met AS (SELECT league, team, opponent, count(*) AS n, count(*) FILTER (gf > ga) AS won, arg_max(game_id, [kickoff, game_id]) AS last FROM latest GROUP BY league, team, opponent)
SELECT a.league, a.team AS team_a, b.team AS team_b, round(a.scored - b.scored, 5) AS attack_gap, round(b.conceded - a.conceded, 5) AS defence_gap, round(a.score - b.score, 5) AS form_gap, round(a.rating - b.rating, 5) AS rating_gap,
  round(1e0 / (1e0 + power(10e0, (b.rating - a.rating) / 400e0)), 5) AS neutral_chance, coalesce(m.n, 0) AS meetings, coalesce(m.won, 0) AS won, m.last AS last_meeting FROM t a JOIN t b ON b.league = a.league AND b.team > a.team LEFT JOIN met m ON m.league = a.league AND m.team = a.team AND m.opponent = b.team""",
        "sports_form_score": f"WITH RECURSIVE {form} SELECT league, team, n, xg_games, round(raw, 6) AS raw, round({score}, 6) AS score FROM form",
        "sports_form_league_scaled": f"WITH RECURSIVE {form}, {scaled} SELECT league, team, n < 5 AS insufficient, round(score, 5) AS score FROM scores",
        "sports_two_models": f"""WITH RECURSIVE {two}
SELECT league, home, away, round(rate_home, 5) AS rate_home, round(rate_away, 5) AS rate_away, round(bridge_home, 5) AS bridge_home, round(bridge_away, 5) AS bridge_away, round(hp, 5) AS home_p, round(dp, 5) AS draw_p, round(ap, 5) AS away_p, voters, round(agreement, 5) AS agreement, dq AS data_quality,
  round(least(0.99e0, greatest(0.01e0, 0.95e0 * (0.35e0 + 0.65e0 * {P.smoothstep("dq / 100e0", 0.4, 0.95)}) * (0.3e0 + 0.7e0 * agreement) * (sample / (sample + 12e0)) * (0.4e0 + 0.6e0 * power(complete, 1.5e0)) * (0.65e0 + 0.35e0 * voters / (voters + 5e0)))), 5) AS confidence,
  round(toward * 0.25e0 * ({score.replace("raw", "raw_h")} - {score.replace("raw", "raw_a")}) / 100e0, 5) AS form_factor, round(toward * 0.5e0 * (1e0 / (1e0 + power(10e0, -(rh + 65e0 - ra) / 400e0)) - 0.5e0), 5) AS rating_factor, round(toward * 0.06e0, 5) AS venue_factor,
  round(toward * ((share * meetings + prior * 8e0) / (meetings + 8e0) - prior), 5) AS meetings_factor FROM z""",
        "sports_counterfactuals": f"""WITH RECURSIVE {form}, {scaled}, plain AS ({_batch_ratings(d)}),
s AS (SELECT league, team, rating, score FROM plain JOIN scores USING (league, team)), q AS (SELECT p.league, p.home, p.away, h.rating - a.rating AS gap, (h.score - a.score) / 100e0 AS f FROM (SELECT DISTINCT league, home, away FROM games) p JOIN s h ON h.league = p.league AND h.team = p.home JOIN s a ON a.league = p.league AND a.team = p.away),
e AS (SELECT *, 1e0 / (1e0 + power(10e0, -gap / 400e0)) AS e0, 1e0 / (1e0 + power(10e0, -(gap + 60e0) / 400e0)) AS e1, exp(1.1e0 * f + 0.3e0) AS fh, exp(-1.1e0 * f) AS fa, exp(-0.19e0) AS fd FROM q)
SELECT league, home, away, round(e0 / (1e0 + 0.85e0 * sqrt(e0 * (1e0 - e0))) - 0.5e0 / 1.425e0, 5) AS rating_gap, round(e1 / (1e0 + 0.85e0 * sqrt(e1 * (1e0 - e1))) - e0 / (1e0 + 0.85e0 * sqrt(e0 * (1e0 - e0))), 5) AS rating_venue,
  round(fh / (fh + fd + fa) - exp(0.3e0) / (exp(0.3e0) + fd + 1e0), 5) AS form_gap, round(exp(0.3e0) / (exp(0.3e0) + fd + 1e0) - 1e0 / (2e0 + fd), 5) AS form_venue FROM e""",
    }


def _batch_ratings(d: Spark) -> str:
    """A query of its own: ratings after all games by the constant step."""
    return f"""WITH RECURSIVE {elo_replay(d, CONSTANT, "60e0")}
SELECT league, unnest(range(0, 25)) AS team, unnest(r) AS rating FROM (SELECT league, arg_max(r, k) AS r FROM rec GROUP BY league)"""
