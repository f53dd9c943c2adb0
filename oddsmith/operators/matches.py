"""Match predictions: rated models of one fixture, pooled in log-odds; a model without its inputs abstains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every model votes with weight one, times its adaptive factor where a record exists.
WEIGHTS = {"rates": 1.0, "elo": 1.0, "form": 1.0, "learned": 1.0}
#: Least games of a side; the log-odds spread of models that is no agreement at all.
LEAST_GAMES, NO_AGREEMENT = 5, 2.2
OUTCOMES = ("home_p", "draw_p", "away_p")
#: Fixed values of the ensemble's rating and form models: home advantage, draws of an even game, slope, venue and draw terms.
ENSEMBLE_RATING, DRAW_SHARE, FORM_SLOPE, FORM_VENUE, FORM_DRAW = 60.0, 0.85, 1.1, 0.3, -0.19


def form_outcomes(gap: Column, venue: float) -> list[Column]:
    """Home, draw and away by a softmax of the form gap, -1 to 1."""
    z = [FORM_SLOPE * gap + venue, F.lit(FORM_DRAW), -FORM_SLOPE * gap]
    total = sum((F.exp(x) for x in z), F.lit(0.0))
    return [F.exp(x) / total for x in z]


def rating_outcomes(diff: Column) -> list[Column]:
    """Home, draw and away of a rating difference, draws likeliest between equals."""
    win = chance(diff)
    draw = DRAW_SHARE * F.sqrt(win * (1 - win))
    return [win / (1 + draw), draw / (1 + draw), (1 - win) / (1 + draw)]


def chance(diff: Column) -> Column:
    """Of winning, by a rating difference."""
    return 1 / (1 + F.pow(F.lit(10.0), -diff / 400))


def outcome_rows(fixtures: DataFrame, elo: DataFrame, rates: DataFrame, form: DataFrame, max_goals: int = 10) -> DataFrame:
    """(league, home, away, model, home_p, draw_p, away_p) per fixture and model that has what it needs."""
    side = lambda df, team, *cols: df.select("league", F.col("team").alias(team), *(F.col(c).alias(f"{team}_{c}") for c in cols))
    e = fixtures.join(side(elo, "home", "rating", "games"), ["league", "home"]).join(side(elo, "away", "rating", "games"), ["league", "away"])
    e = e.where((F.col("home_games") >= LEAST_GAMES) & (F.col("away_games") >= LEAST_GAMES))
    p = rating_outcomes(F.col("home_rating") + ENSEMBLE_RATING - F.col("away_rating"))
    by_elo = e.select("league", "home", "away", F.lit("elo").alias("model"), *(x.alias(c) for x, c in zip(p, OUTCOMES, strict=True)))

    r = fixtures.join(side(rates, "home", "attack", "defence", "mean_goals", "home_ratio"), ["league", "home"]).join(side(rates, "away", "attack", "defence"), ["league", "away"])
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.05)), F.lit(6.0))
    lam = r.select("league", "home", "away", clamp(F.col("home_mean_goals") * F.col("home_home_ratio") * F.col("home_attack") * F.col("away_defence")).alias("lh"), clamp(F.col("home_mean_goals") * F.col("away_attack") * F.col("home_defence")).alias("la"))
    goals = F.sequence(F.lit(0), F.lit(max_goals))
    cells = lam.withColumn("h", F.explode(goals)).withColumn("a", F.explode(goals))
    pmf = lambda rate, k: F.exp(-F.col(rate)) * F.pow(F.col(rate), F.col(k)) / F.factorial(k)
    rho = -0.11
    tau = (
        F.when((F.col("h") == 0) & (F.col("a") == 0), 1 - F.col("lh") * F.col("la") * rho).when((F.col("h") == 0) & (F.col("a") == 1), 1 + F.col("lh") * rho)
        .when((F.col("h") == 1) & (F.col("a") == 0), 1 + F.col("la") * rho).when((F.col("h") == 1) & (F.col("a") == 1), F.lit(1 - rho)).otherwise(1.0)
    )
    p = cells.withColumn("p", pmf("lh", "h") * pmf("la", "a") * F.greatest(tau, F.lit(0.0)))
    share = lambda c: (F.sum(F.when(c, F.col("p")).otherwise(0.0)) / F.sum("p"))
    by_rates = p.groupBy("league", "home", "away").agg(share(F.col("h") > F.col("a")).alias("home_p"), share(F.col("h") == F.col("a")).alias("draw_p"), share(F.col("h") < F.col("a")).alias("away_p")).select("league", "home", "away", F.lit("rates").alias("model"), "home_p", "draw_p", "away_p")

    f = fixtures.join(side(form, "home", "score", "n"), ["league", "home"]).join(side(form, "away", "score", "n"), ["league", "away"]).where((F.col("home_n") >= LEAST_GAMES) & (F.col("away_n") >= LEAST_GAMES))
    p = form_outcomes((F.col("home_score") - F.col("away_score")) / 100, FORM_VENUE)
    by_form = f.select("league", "home", "away", F.lit("form").alias("model"), *(x.alias(c) for x, c in zip(p, OUTCOMES, strict=True)))
    return by_elo.unionByName(by_rates).unionByName(by_form)


def pooled(outcomes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(league, home, away, home_p, draw_p, away_p, voters, agreement, effective): weighted log-odds pool, softmax over the three.

    agreement is one less the weighted spread of the models' log-odds, averaged over the outcomes; one model agrees with itself.
    """
    known = F.create_map(*(F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv))
    w = F.coalesce(F.try_element_at(known, F.col("model")), F.lit(0.0))
    clamped = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    logit = lambda c: F.log(clamped(c) / (1 - clamped(c)))
    by = ["league", "home", "away"]
    scored = outcomes.withColumn("w", w).where("w > 0").withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*by)))
    scored = scored.withColumns({f"{c}_mean": F.sum(F.col("share") * logit(c)).over(Window.partitionBy(*by)) for c in OUTCOMES})
    spread = lambda c: F.sqrt(F.sum(F.col("share") * F.pow(logit(c) - F.col(f"{c}_mean"), F.lit(2.0))))
    sums = scored.groupBy(*by).agg(
        *(F.first(f"{c}_mean").alias(c) for c in OUTCOMES), (sum((spread(c) for c in OUTCOMES), F.lit(0.0)) / 3).alias("apart"),
        F.count(F.lit(1)).alias("voters"), (1 / F.sum(F.col("share") * F.col("share"))).alias("effective"),
    )
    top = F.greatest(*OUTCOMES)
    total = sum((F.exp(F.col(c) - top) for c in OUTCOMES), F.lit(0.0))
    agreement = F.when(F.col("voters") < 2, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("apart") / NO_AGREEMENT))
    return sums.select(*by, *((F.exp(F.col(c) - top) / total).alias(c) for c in OUTCOMES), "voters", agreement.alias("agreement"), "effective")
