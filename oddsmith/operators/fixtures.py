"""Form against opponents as rated at each game, and a fixture's prediction by two models: scoring rates, and ratings turned into rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.operators.matches import ENSEMBLE_RATING, FORM_VENUE, chance, form_outcomes, pooled, rating_outcomes

#: Games of a window, decay of a game per game since, weights of form's parts, its centre and spread.
WINDOW_GAMES, FORM_DECAY = 15, 0.18
FORM_WEIGHTS = {"result": 0.40, "goals": 0.25, "opponent": 0.20, "expected": 0.15}
FORM_CENTRE, FORM_SPREAD = 0.5, 0.12
#: Least games of a side, games of the confidence law, of a history's half weight, of a head-to-head's prior.
LEAST_GAMES, SAMPLE_TARGET, HISTORY_HALF, MEETINGS_PRIOR = 5, 12, 8, 8
#: Correlation of low scores, most goals of a score matrix, home advantage in goals and in rating, rating of one goal.
RHO, MOST_GOALS, HOME_GOALS, HOME_RATING, RATING_PER_GOAL = -0.13, 10, 0.25, 65.0, 175.0
RATE_PRIOR, LEAST_RATE, MOST_RATE, LEAST_BRIDGED = 6, 0.05, 6.0, 0.1
START_RATING = 1500.0


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _squashed(x: Column) -> Column:
    """Goal differences on (0, 1), an even game at one half."""
    return 0.5 * (1 + F.tanh(x / 3))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def team_views(games: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(league, team, opponent, game_id, kickoff, is_home, gf, ga, xgf, xga, result, ago): each game from both sides, ago 0 the latest.

    expected(game_id, home_xg, away_xg) may lack games, which then have no expected goals.
    """
    if expected is None:
        games = games.withColumns({"home_xg": F.lit(None).cast("double"), "away_xg": F.lit(None).cast("double")})
    else:
        games = games.join(expected.select("game_id", "home_xg", "away_xg"), "game_id", "left")
    side = lambda me, you, at_home: F.struct(
        F.col(me).alias("team"), F.col(you).alias("opponent"), F.lit(at_home).alias("is_home"), F.col("hs" if at_home else "aws").alias("gf"), F.col("aws" if at_home else "hs").alias("ga"),
        F.col(f"{me}_xg").alias("xgf"), F.col(f"{you}_xg").alias("xga"),
    )
    rows = games.select("league", "game_id", "kickoff", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select("league", "game_id", "kickoff", "s.*")
    result = F.when(F.col("gf") > F.col("ga"), 1.0).when(F.col("gf") == F.col("ga"), 0.5).otherwise(0.0)
    latest = Window.partitionBy("league", "team").orderBy(F.col("kickoff").desc(), F.col("game_id").desc())
    return rows.withColumn("result", result).withColumn("ago", F.row_number().over(latest) - 1)


def form(views: DataFrame, history: DataFrame) -> DataFrame:
    """(league, team, raw, n, xg_games): recency-weighted form of a team's window.

    A game counts its result, its goal difference, its opponent's chance against an average side by the rating before
    that game (history, an as-of join on the game), and its expected goals; where those are missing the other three
    parts share their weight in proportion. An unrated opponent counts one half.
    """
    rated = history.select("league", "game_id", F.col("team").alias("opponent"), F.col("before").alias("rating"))
    rows = views.where(F.col("ago") < WINDOW_GAMES).join(rated, ["league", "game_id", "opponent"], "left")
    w = FORM_WEIGHTS
    three = w["result"] * F.col("result") + w["goals"] * _squashed(F.col("gf") - F.col("ga")) + w["opponent"] * F.coalesce(chance(F.col("rating") - START_RATING), F.lit(0.5))
    known = F.col("xgf").isNotNull() & F.col("xga").isNotNull()
    one = F.when(known, three + w["expected"] * _squashed(F.col("xgf") - F.col("xga"))).otherwise(three / (1 - w["expected"]))
    weight = F.exp(-FORM_DECAY * F.col("ago"))
    sums = rows.groupBy("league", "team").agg((F.sum(weight * one) / F.sum(weight)).alias("raw"), F.count(F.lit(1)).alias("n"), F.count(F.when(known, 1)).alias("xg_games"))
    return sums


def form_score(raw: Column) -> Column:
    """0 to 100, against a fixed centre."""
    return 100 * _logistic((raw - FORM_CENTRE) / FORM_SPREAD)


def league_form(found: DataFrame) -> DataFrame:
    """form's rows with score, 0 to 100 against the median and quartiles of the team's league; a small or level league uses the fixed centre."""
    league = found.groupBy("league").agg(F.percentile("raw", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("teams"))
    gap = F.col("q")[2] - F.col("q")[0]
    fixed = (F.col("teams") < 4) | (gap <= 1e-9)
    z = F.when(fixed, (F.col("raw") - FORM_CENTRE) / FORM_SPREAD).otherwise((F.col("raw") - F.col("q")[1]) / F.nullif(gap / (2 * math.log(3)), F.lit(0.0)))
    return found.join(league, "league").select(*found.columns, (100 * _logistic(z)).alias("score"))


def outcomes_of_rates(rows: DataFrame, home: str, away: str, rho: float = RHO) -> DataFrame:
    """rows with home_p, draw_p, away_p of two scoring rates, low scores corrected; an expression, no row is expanded."""
    pmf = lambda rate, k: F.exp(-F.col(rate)) * F.pow(F.col(rate), F.lit(k)) / math.factorial(k)
    goals = range(MOST_GOALS + 1)
    h, a = [f"_h{k}" for k in goals], [f"_a{k}" for k in goals]
    wide = rows.withColumns({c: pmf(home, k) for k, c in zip(goals, h, strict=True)} | {c: pmf(away, k) for k, c in zip(goals, a, strict=True)})
    ahead = lambda x, y: sum((F.col(x[k]) * sum((F.col(c) for c in y[:k]), F.lit(0.0)) for k in goals), F.lit(0.0))
    corner = lambda i, j: F.col(h[i]) * F.col(a[j]) * rho
    win = ahead(h, a) + corner(1, 0) * F.col(away)
    loss = ahead(a, h) + corner(0, 1) * F.col(home)
    level = sum((F.col(h[k]) * F.col(a[k]) for k in goals), F.lit(0.0)) - corner(0, 0) * F.col(home) * F.col(away) - corner(1, 1)
    wide = wide.withColumns({"_w": win, "_d": level, "_l": loss})
    total = F.col("_w") + F.col("_d") + F.col("_l")
    return wide.select(*rows.columns, (F.col("_w") / total).alias("home_p"), (F.col("_d") / total).alias("draw_p"), (F.col("_l") / total).alias("away_p"))


def _sides(fixtures: DataFrame, teams: DataFrame, kept: list[str]) -> DataFrame:
    for side in ("home", "away"):
        own = teams.select("league", F.col("team").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in kept))
        fixtures = fixtures.join(own, ["league", side], "left")
    return fixtures


def two_model_predictions(fixtures: DataFrame, games: DataFrame, views: DataFrame, history: DataFrame) -> DataFrame:
    """A row per fixture(league, home, away): pooled outcomes of two models, their rates, confidence, data quality, signed factors.

    Model rates: each side's goals for and against in its window over the league's mean, shrunk to it, give the two
    scoring rates. Model ratings: the rating gap gives the margin and the league the total, so the rates are
    (total +- margin) / 2. Both go through one score matrix. A model abstains if a side has too few games; if both do, the
    outcomes are even and the agreement is 0. Factors are signed towards the leading outcome.
    """
    league = games.groupBy("league").agg(F.avg("hs").alias("home_goals"), F.avg("aws").alias("away_goals"))
    recent = views.where(F.col("ago") < WINDOW_GAMES).groupBy("league", "team").agg(F.avg("gf").alias("scored"), F.avg("ga").alias("conceded"))
    last = history.join(views.select("league", "game_id", "team", "ago"), ["league", "game_id", "team"])
    rated = last.groupBy("league", "team").agg(F.min_by("after", "ago").alias("rating"), F.count(F.lit(1)).alias("played"))
    teams = recent.join(form(views, history), ["league", "team"], "left").join(rated, ["league", "team"], "left").withColumn("form", form_score(F.col("raw")))
    rows = _sides(fixtures.join(league, "league", "left"), teams, ["scored", "conceded", "n", "xg_games", "form", "rating", "played"])

    mean = (F.col("home_goals") + F.col("away_goals")) / 2
    ratio = lambda c, n: (F.col(c) / mean * F.col(n) + RATE_PRIOR) / (F.col(n) + RATE_PRIOR)
    rate = lambda base, x, y: _clamp(base * x * y, LEAST_RATE, MOST_RATE)
    margin = (F.col("home_rating") + HOME_RATING - F.col("away_rating")) / RATING_PER_GOAL
    total = F.col("home_goals") + F.col("away_goals")
    rows = rows.withColumns({
        "rate_home": rate(mean + HOME_GOALS / 2, ratio("home_scored", "home_n"), ratio("away_conceded", "away_n")),
        "rate_away": rate(mean - HOME_GOALS / 2, ratio("away_scored", "away_n"), ratio("home_conceded", "home_n")),
        "bridge_home": F.greatest(F.lit(LEAST_BRIDGED), (total + margin) / 2), "bridge_away": F.greatest(F.lit(LEAST_BRIDGED), (total - margin) / 2),
        "sample": F.coalesce(F.least(F.coalesce("home_n", F.lit(0)), F.coalesce("away_n", F.lit(0))), F.lit(0)),
        "rated": F.least(F.coalesce("home_played", F.lit(0)), F.coalesce("away_played", F.lit(0))),
    })
    key = ["league", "home", "away"]
    voted = [
        outcomes_of_rates(rows.where(F.col(enough) >= LEAST_GAMES).select(*key, home, away), home, away).select(*key, F.lit(model).alias("model"), "home_p", "draw_p", "away_p")
        for model, enough, home, away in (("rates", "sample", "rate_home", "rate_away"), ("ratings", "rated", "bridge_home", "bridge_away"))
    ]
    pool = pooled(voted[0].unionByName(voted[1]), {"rates": 1.0, "ratings": 1.0})

    met = views.groupBy("league", F.col("team").alias("home"), F.col("opponent").alias("away")).agg(F.count(F.lit(1)).alias("meetings"), F.avg("result").alias("met_share"))
    rows = rows.join(pool, key, "left").join(met, key, "left")
    for c in ("home_p", "draw_p", "away_p"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(1 / 3)))
    rows = rows.withColumns({"voters": F.coalesce("voters", F.lit(0)), "agreement": F.coalesce("agreement", F.lit(0.0)), "effective": F.coalesce("effective", F.lit(0.0))})
    has_xg = (F.col("home_xg_games") == F.col("home_n")) & (F.col("away_xg_games") == F.col("away_n")) & (F.col("sample") > 0)
    flags = [F.col("home_n") >= LEAST_GAMES, F.col("away_n") >= LEAST_GAMES, F.col("home_rating").isNotNull() & F.col("away_rating").isNotNull(), F.col("meetings").isNotNull(), has_xg]
    complete = sum((F.when(f, 1.0).otherwise(0.0) for f in flags), F.lit(0.0)) / len(flags)
    rows = rows.withColumn("complete", complete)
    quality = F.floor(100 * (0.45 * F.col("complete") + 0.55 * F.col("sample") / (F.col("sample") + 6)) + 0.5).cast("long")
    rows = rows.withColumn("data_quality", quality)
    t = _clamp((F.col("data_quality") / 100 - 0.4) / 0.55, 0.0, 1.0)
    confidence = (
        0.95 * (0.35 + 0.65 * t * t * (3 - 2 * t)) * (0.30 + 0.70 * F.col("agreement")) * (F.col("sample") / (F.col("sample") + SAMPLE_TARGET))
        * (0.40 + 0.60 * F.pow("complete", F.lit(1.5))) * (0.65 + 0.35 * F.col("effective") / (F.col("effective") + 5))
    )
    to = F.when((F.col("away_p") > F.col("home_p")) & (F.col("away_p") > F.col("draw_p")), -1).otherwise(1)
    prior = F.col("home_p") + 0.5 * F.col("draw_p")
    shrunk = (F.col("met_share") * F.col("meetings") + prior * MEETINGS_PRIOR) / (F.col("meetings") + MEETINGS_PRIOR)
    return rows.select(
        *key, "rate_home", "rate_away", "bridge_home", "bridge_away", "home_p", "draw_p", "away_p", "voters", "agreement", "data_quality", _clamp(confidence, 0.01, 0.99).alias("confidence"),
        (to * (F.col("home_form") - F.col("away_form")) / 100 * 0.25).alias("form_factor"), (to * (chance(F.col("home_rating") + HOME_RATING - F.col("away_rating")) - 0.5) * 0.5).alias("rating_factor"),
        (to * F.lit(0.06)).alias("venue_factor"), (to * (shrunk - prior)).alias("meetings_factor"),
    )


def counterfactual_factors(fixtures: DataFrame, elo: DataFrame, scores: DataFrame) -> DataFrame:
    """(league, home, away, rating_gap, rating_venue, form_gap, form_venue): what each input adds to the home side's chance.

    Even ratings on neutral ground, then the gap, then the venue; an even form at home against the form gap, and against none.
    """
    rows = _sides(fixtures, elo.join(scores, ["league", "team"]), ["rating", "score"]).dropna()
    gap, full = (rating_outcomes(F.col("home_rating") + at - F.col("away_rating"))[0] for at in (0.0, ENSEMBLE_RATING))
    even = rating_outcomes(F.lit(0.0))[0]
    apart = (F.col("home_score") - F.col("away_score")) / 100
    at_home = form_outcomes(F.lit(0.0), FORM_VENUE)[0]
    return rows.select(
        "league", "home", "away", (gap - even).alias("rating_gap"), (full - gap).alias("rating_venue"),
        (form_outcomes(apart, FORM_VENUE)[0] - at_home).alias("form_gap"), (at_home - form_outcomes(F.lit(0.0), 0.0)[0]).alias("form_venue"),
    )


#: Weights of a team's strength, anchored on means and as percentiles of its league; a missing player's weight.
STRENGTH_WEIGHTS = {"attack": 0.22, "defence": 0.22, "form": 0.18, "depth": 0.06, "health": 0.12, "home_away": 0.10, "momentum": 0.10}
PERCENTILE_WEIGHTS = {"attack": 0.22, "defence": 0.22, "form": 0.20, "depth": 0.06, "health": 0.06, "home_away": 0.14, "momentum": 0.10}
ABSENCE = {"out": 1.0, "suspended": 1.0, "doubtful": 0.6, "questionable": 0.35, "probable": 0.15}
#: Least games at a venue, least games of a trend (anchored, percentile), least teams of a percentile, points of health a weight costs.
LEAST_VENUE, LEAST_TREND, LEAST_LONG_TREND, LEAST_TEAMS, HEALTH_COST = 3, 4, 8, 4, 12


def _weighted(weights: dict[str, float], parts: list[str]) -> Column:
    """Weights shared out over the parts that are known."""
    top = sum((F.coalesce(weights[p] * F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return top / sum((F.when(F.col(p).isNotNull(), weights[p]).otherwise(0.0) for p in parts), F.lit(0.0))


def _at_venues(views: DataFrame) -> DataFrame:
    """(league, team, venue, venue_points): points a game at home and away, null below the least games there."""
    points = F.when(F.col("result") == 1.0, 3.0).when(F.col("result") == 0.5, 1.0).otherwise(0.0)
    own = [F.when(F.count(F.when(F.col("is_home") == at, 1)) >= LEAST_VENUE, F.avg(F.when(F.col("is_home") == at, points))) for at in (True, False)]
    both = views.where(F.col("ago") < WINDOW_GAMES).groupBy("league", "team").agg(own[0].alias("h"), own[1].alias("a"))
    venues = F.array(F.struct(F.lit("home").alias("venue"), F.col("h").alias("venue_points")), F.struct(F.lit("away").alias("venue"), F.col("a").alias("venue_points")))
    return both.select("league", "team", F.explode(venues).alias("v")).select("league", "team", "v.*")


def team_strength(games: DataFrame, views: DataFrame, history: DataFrame, absences: DataFrame) -> DataFrame:
    """(league, team, venue, attack, defence, form, health, home_away, momentum, strength), 0 to 100, 50 being the league's mean.

    absences(team, status) lists players that may miss games; a team without any is in full health. Depth has no source.
    """
    mean = games.groupBy("league").agg(((F.avg("hs") + F.avg("aws")) / 2).alias("mean"))
    recent = views.where(F.col("ago") < WINDOW_GAMES).groupBy("league", "team").agg(
        F.avg("gf").alias("scored"), F.avg("ga").alias("conceded"), F.count(F.lit(1)).alias("games"), F.avg(F.when(F.col("ago") < 3, F.col("result"))).alias("now"), F.avg(F.when(F.col("ago") >= 3, F.col("result"))).alias("then")
    )
    weight = F.create_map(*(F.lit(x) for kv in ABSENCE.items() for x in kv))
    missing = absences.groupBy("team").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("status")), F.lit(0.0))).alias("burden"))
    rows = recent.join(mean, "league").join(form(views, history).select("league", "team", "raw"), ["league", "team"]).join(missing, "team", "left").join(_at_venues(views), ["league", "team"])
    rows = rows.withColumns({
        "attack": 100 * _logistic(2 * (F.col("scored") / F.col("mean") - 1)), "defence": 100 * _logistic(2 * (1 - F.col("conceded") / F.col("mean"))), "form": form_score(F.col("raw")),
        "health": F.greatest(F.lit(0.0), 100 - HEALTH_COST * F.coalesce("burden", F.lit(0.0))), "home_away": 100 * F.col("venue_points") / 3,
        "momentum": F.when(F.col("games") >= LEAST_TREND, _clamp(50 + 50 * (F.col("now") - F.col("then")), 0.0, 100.0)),
    })
    parts = ["attack", "defence", "form", "health", "home_away", "momentum"]
    return rows.select("league", "team", "venue", *parts, _weighted(STRENGTH_WEIGHTS, parts).alias("strength"))


def _percentile(value: str, by: list[str]) -> Column:
    """Share of the group below, ties by half, times 100; null in a group of too few."""
    group = Window.partitionBy(*by)
    below = F.rank().over(group.orderBy(value)) - 1
    alike = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    n = F.count(value).over(group)
    nulls = F.count(F.lit(1)).over(group) - n
    return F.when(F.col(value).isNotNull() & (n >= LEAST_TEAMS), 100 * (below - nulls + alike / 2) / n)


def strength_percentiles(views: DataFrame, history: DataFrame) -> DataFrame:
    """(league, team, venue, attack, defence, form, home_away, momentum, strength): each part as a percentile of the league.

    Momentum is the form of the last five games against that of the window, both on the league's scale of windows.
    """
    recent = views.where(F.col("ago") < WINDOW_GAMES).groupBy("league", "team").agg(F.round(F.avg("gf"), 9).alias("scored"), F.round(-F.avg("ga"), 9).alias("kept"))
    long = league_form(form(views, history))
    short = form(views.where("ago < 5"), history).select("league", "team", F.col("raw").alias("short"))
    league = long.groupBy("league").agg(F.percentile("raw", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("teams"))
    rows = recent.join(long, ["league", "team"]).join(short, ["league", "team"]).join(league, "league")
    gap = F.col("q")[2] - F.col("q")[0]
    fixed = (F.col("teams") < 4) | (gap <= 1e-9)
    z = F.when(fixed, (F.col("short") - FORM_CENTRE) / FORM_SPREAD).otherwise((F.col("short") - F.col("q")[1]) / F.nullif(gap / (2 * math.log(3)), F.lit(0.0)))
    rows = rows.withColumns({
        "attack": _percentile("scored", ["league"]), "defence": _percentile("kept", ["league"]), "form": F.when(F.col("n") >= LEAST_GAMES, F.col("score")),
        "momentum": F.when(F.col("n") >= LEAST_LONG_TREND, _clamp(50 + (100 * _logistic(z) - F.col("score")) / 2, 0.0, 100.0)),
    })
    rows = rows.join(_at_venues(views).withColumn("venue_points", F.round("venue_points", 9)), ["league", "team"])
    rows = rows.withColumn("home_away", _percentile("venue_points", ["league", "venue"]))
    parts = ["attack", "defence", "form", "home_away", "momentum"]
    return rows.select("league", "team", "venue", *parts, _weighted(PERCENTILE_WEIGHTS, parts).alias("strength"))


def compared_teams(views: DataFrame, history: DataFrame) -> DataFrame:
    """(league, team_a, team_b, attack_gap, defence_gap, form_gap, rating_gap, neutral_chance, meetings, won, last_meeting): every two teams of a league."""
    recent = views.where(F.col("ago") < WINDOW_GAMES).groupBy("league", "team").agg(F.avg("gf").alias("scored"), F.avg("ga").alias("conceded"))
    last = history.join(views.where("ago = 0").select("league", "game_id", "team"), ["league", "game_id", "team"]).select("league", "team", F.col("after").alias("rating"))
    teams = recent.join(form(views, history).select("league", "team", form_score(F.col("raw")).alias("form")), ["league", "team"]).join(last, ["league", "team"])
    one, two = (teams.select("league", *(F.col(c).alias(f"{c}_{x}") for c in ("team", "scored", "conceded", "form", "rating"))) for x in "ab")
    met = views.where("team < opponent").groupBy("league", F.col("team").alias("team_a"), F.col("opponent").alias("team_b")).agg(
        F.count(F.lit(1)).alias("meetings"), F.count(F.when(F.col("result") == 1.0, 1)).alias("won"), F.max_by("game_id", F.struct("kickoff", "game_id")).alias("last_meeting")
    )
    pairs = one.join(two, "league").where("team_a < team_b").join(met, ["league", "team_a", "team_b"], "left")
    gap = F.col("rating_a") - F.col("rating_b")
    return pairs.select(
        "league", "team_a", "team_b", (F.col("scored_a") - F.col("scored_b")).alias("attack_gap"), (F.col("conceded_b") - F.col("conceded_a")).alias("defence_gap"), (F.col("form_a") - F.col("form_b")).alias("form_gap"),
        gap.alias("rating_gap"), chance(gap).alias("neutral_chance"), F.coalesce("meetings", F.lit(0)).alias("meetings"), F.coalesce("won", F.lit(0)).alias("won"), "last_meeting",
    )


def rating_chances(fixtures: DataFrame, elo: DataFrame) -> DataFrame:
    """(league, home, away, home_win, draw, away_win, goal_diff): outcomes and expected margin by the ratings of the two sides."""
    rows = _sides(fixtures, elo, ["rating"]).dropna()
    diff = F.col("home_rating") + ENSEMBLE_RATING - F.col("away_rating")
    win, draw, loss = rating_outcomes(diff)
    return rows.select("league", "home", "away", win.alias("home_win"), draw.alias("draw"), loss.alias("away_win"), (diff / RATING_PER_GOAL).alias("goal_diff"))


#: What form, rating, meetings and rest may add to a home side's chance, and the days of rest that count.
FORM_SHARE, RATING_SHARE, MEETINGS_SHARE, REST_SHARE, REST_MOST, REST_DAYS = 0.25, 0.5, 0.03, 0.004, 0.02, 14
FACTOR_PRIOR = 6


def match_factors(games: DataFrame, views: DataFrame, history: DataFrame, elo: DataFrame) -> DataFrame:
    """(league, home, away, form, elo, venue, h2h, rest) of every pairing as of the league's last game: what each adds to the home side's chance."""
    last = views.where("ago = 0").select("league", "team", F.col("kickoff").alias("last"))
    teams = elo.join(form(views, history).select("league", "team", form_score(F.col("raw")).alias("form")), ["league", "team"]).join(last, ["league", "team"])
    now = games.groupBy("league").agg(F.max("kickoff").alias("now"))
    met = views.groupBy("league", F.col("team").alias("home"), F.col("opponent").alias("away")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("result") == 1.0, 1)).alias("wins"))
    rows = _sides(games.select("league", "home", "away").distinct(), teams, ["rating", "form", "last"]).join(now, "league").join(met, ["league", "home", "away"], "left")
    rest = lambda side: F.least(F.lit(float(REST_DAYS)), (F.col("now") - F.col(f"{side}_last")) / 86_400_000)
    chance_at = lambda home: chance(F.col("home_rating") + home - F.col("away_rating"))
    shrunk = (F.coalesce("wins", F.lit(0)) + 0.5 * FACTOR_PRIOR) / (F.coalesce("n", F.lit(0)) + FACTOR_PRIOR)
    return rows.select(
        "league", "home", "away", (FORM_SHARE * (F.col("home_form") - F.col("away_form")) / 100).alias("form"), (RATING_SHARE * (chance_at(0.0) - 0.5)).alias("elo"),
        (RATING_SHARE * (chance_at(ENSEMBLE_RATING) - chance_at(0.0))).alias("venue"), _clamp(shrunk - 0.5, -MEETINGS_SHARE, MEETINGS_SHARE).alias("h2h"),
        _clamp(REST_SHARE * (rest("home") - rest("away")), -REST_MOST, REST_MOST).alias("rest"),
    )
