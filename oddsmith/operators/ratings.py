"""Ratings that are folds over a league's games in time order: Elo twice, Dixon-Coles strengths, learned features."""

from __future__ import annotations

from pyspark.sql import DataFrame

START = 1500.0


def expected(diff: float) -> float:
    return 1 / (1 + 10 ** (-diff / 400))


def in_time(rows: DataFrame, start, step, ends, columns: tuple[str, ...], schema: str, by: tuple[str, ...] = ("kickoff", "game_id")) -> DataFrame:
    """A fold over each league's rows in order: a pass over sorted batches that holds a batch and the league's state, never its rows.

    start() gives a state, step(state, row) the result's rows of one row, and ends(league, state) those of a whole league.
    """

    def each(batches):
        import pandas as pd

        league, state = None, None
        for pdf in batches:
            out = []
            for g in pdf.itertuples(index=False):
                own = None if g.league != g.league else g.league
                if state is None or own != league:
                    if state is not None:
                        out += ends(league, state)
                    league, state = own, start()
                out += step(state, g)
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame(list(ends(league, state)), columns=columns)

    return rows.repartition("league").sortWithinPartitions("league", *by).mapInPandas(each, schema)


def _nothing(*_):
    return ()


def batch_elo(games: DataFrame, k: float = 20.0, advantage: float = 60.0) -> DataFrame:
    """(league, team, rating, games): one constant step, scaled by the root of the margin. Ties in time go by game id."""

    def step(state, g):
        a, b = state.setdefault(g.home, [START, 0]), state.setdefault(g.away, [START, 0])
        won = 1.0 if g.hs > g.aws else 0.5 if g.hs == g.aws else 0.0
        move = k * max(1, abs(g.hs - g.aws)) ** 0.5 * (won - expected(a[0] + advantage - b[0]))
        a[0], b[0] = a[0] + move, b[0] - move
        a[1], b[1] = a[1] + 1, b[1] + 1
        return ()

    def ends(league, state):
        return [(league, t, r, n) for t, (r, n) in sorted(state.items())]

    return in_time(games.select("league", "kickoff", "game_id", "home", "away", "hs", "aws"), dict, step, ends, ("league", "team", "rating", "games"), "league int, team int, rating double, games bigint")


def elo_history(games: DataFrame, advantage: float = 65.0) -> DataFrame:
    """(league, game_id, team, before, after): steps shrink with experience and grow with the log of the margin; zero-sum."""

    def step(state, g):
        import math

        sides = state.setdefault(g.home, [START, 0]), state.setdefault(g.away, [START, 0])
        (a, _), (b, _) = sides
        won = 1.0 if g.hs > g.aws else 0.5 if g.hs == g.aws else 0.0
        k = sum(20 + 20 * math.exp(-n / 25) for _, n in sides) / 2
        move = k * math.log1p(max(1, abs(g.hs - g.aws))) / math.log(2) * (won - expected(a + advantage - b))
        for side, new in zip(sides, (a + move, b - move), strict=True):
            side[:] = new, side[1] + 1
        return (g.league, g.game_id, g.home, a, a + move), (g.league, g.game_id, g.away, b, b - move)

    rows = games.select("league", "kickoff", "game_id", "home", "away", "hs", "aws")
    return in_time(rows, dict, step, _nothing, ("league", "game_id", "team", "before", "after"), "league int, game_id bigint, team int, before double, after double")


def attack_defence(games: DataFrame, decay: float = 0.0065, prior: float = 6.0, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(league, team, attack, defence, effective, mean_goals, home_ratio): time-weighted rates by alternating sweeps, mean one, then shrunk.

    Every sweep needs of the games only each pairing's sums of weights and of weighted goals, so Spark adds those up and a
    league's sweeps run over its pairings.
    """
    from pyspark.sql import functions as F

    def each(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["home", "away"])
        teams = sorted(set(pdf["home"]) | set(pdf["away"]))
        at = {t: i for i, t in enumerate(teams)}
        h, a = pdf["home"].map(at).to_numpy(), pdf["away"].map(at).to_numpy()
        w, wx, wy = (pdf[c].to_numpy(float) for c in ("w", "wx", "wy"))
        mu, home = (wx + wy).sum() / (2 * w.sum()), wx.sum() / max(wy.sum(), 1e-9)
        attack, defence, n = np.ones(len(teams)), np.ones(len(teams)), len(teams)
        by = lambda i, v: np.bincount(i, v, n)
        for _ in range(steps):
            before = np.concatenate([attack, defence, [home]])
            attack = (by(h, wx) + by(a, wy)) / np.maximum(by(h, w * mu * home * defence[a]) + by(a, w * mu * defence[h]), 1e-9)
            defence = (by(a, wx) + by(h, wy)) / np.maximum(by(a, w * mu * home * attack[h]) + by(h, w * mu * attack[a]), 1e-9)
            home = wx.sum() / max((w * mu * attack[h] * defence[a]).sum(), 1e-9)
            for v in (attack, defence):
                mu *= v.mean()
                v /= max(v.mean(), 1e-9)
            if np.abs(np.concatenate([attack, defence, [home]]) - before).max() < tolerance:
                break
        games_seen = by(h, w) + by(a, w)
        shrunk = lambda v: (v * games_seen + prior) / (games_seen + prior)
        return pd.DataFrame({"league": pdf["league"].iloc[0], "team": teams, "attack": shrunk(attack), "defence": shrunk(defence), "effective": games_seen, "mean_goals": mu, "home_ratio": home})

    # games of one pairing at one time weigh the same: adding up whole goals first leaves a sum of few products
    at = games.groupBy("league", "home", "away", "kickoff").agg(F.count(F.lit(1)).alias("n"), F.sum("hs").alias("x"), F.sum("aws").alias("y"))
    latest = games.groupBy(F.col("league").alias("of")).agg(F.max("kickoff").alias("latest"))
    w = F.exp(-decay * (F.col("latest") - F.col("kickoff")) / DAY_MS)
    weighted = at.join(F.broadcast(latest), F.col("league").eqNullSafe(F.col("of"))).withColumn("w1", w)
    sums = weighted.groupBy("league", "home", "away").agg(*(F.sum(F.col("w1") * F.col(c)).alias(to) for c, to in (("n", "w"), ("x", "wx"), ("y", "wy"))))
    return sums.groupBy("league").applyInPandas(each, "league int, team int, attack double, defence double, effective double, mean_goals double, home_ratio double")


FEATURES = ("elo_diff", "points_diff", "venue_diff", "goals_diff", "rest_diff")
#: What a decayed mean is before any game (points, points at home, points away, goal difference), and the longest rest in days.
UNKNOWN, LONGEST_REST = (1.35, 1.5, 1.2, 0.0), 14.0
#: The step and the home advantage of the rating that is a feature.
FEATURE_STEP, FEATURE_ADVANTAGE = 20.0, 60.0
DAY_MS = 86_400_000


class Side:
    """What is known of a team before its next game: a rating, decayed (sum, weight) of four measures, games, last kickoff."""

    def __init__(self) -> None:
        self.rating, self.games, self.last = START, 0, None
        self.means = [[0.0, 0.0] for _ in UNKNOWN]

    def mean(self, which: int) -> float:
        total, weight = self.means[which]
        return total / weight if weight else UNKNOWN[which]

    def rest(self, at: float) -> float:
        return LONGEST_REST if self.last is None else max(0.0, min(LONGEST_REST, (at - self.last) / DAY_MS))

    def played(self, at_home: bool, points: int, margin: int, step: float, kickoff: float, fade: float) -> None:
        self.rating += step
        for which, value in ((0, points), (1 if at_home else 2, points), (3, margin)):
            own = self.means[which]
            own[:] = own[0] * fade + value, own[1] * fade + 1
        self.games, self.last = self.games + 1, kickoff


def fixture_values(state: dict[int, Side], home: int, away: int, at: float, least: int = 5) -> tuple[float, ...] | None:
    """FEATURES of a fixture at a time, in milliseconds, from what replay knows; None if a team has played fewer than `least` games."""
    a, b = state.get(home), state.get(away)
    if a is None or b is None or min(a.games, b.games) < least:
        return None
    within = lambda x, most: max(-most, min(most, x))
    return (
        within((a.rating - b.rating) / 400, 1.5), within((a.mean(0) - b.mean(0)) / 3, 1.0), within((a.mean(1) - b.mean(2)) / 3, 1.0), within((a.mean(3) - b.mean(3)) / 3, 1.0),
        (a.rest(at) - b.rest(at)) / LONGEST_REST,
    )


def replay_step(state: dict[int, Side], g, least: int = 5, fade: float = 0.92) -> tuple | None:
    """The sample (league, game_id, kickoff, outcome, *FEATURES) of a league's next game, if its teams are known well enough; the game is then known."""
    values = fixture_values(state, g.home, g.away, g.kickoff, least)
    outcome = 0 if g.hs > g.aws else 1 if g.hs == g.aws else 2
    a, b = (state.setdefault(t, Side()) for t in (g.home, g.away))
    step = FEATURE_STEP * ((1.0, 0.5, 0.0)[outcome] - expected(a.rating + FEATURE_ADVANTAGE - b.rating))
    a.played(True, (3, 1, 0)[outcome], g.hs - g.aws, step, g.kickoff, fade)
    b.played(False, (0, 1, 3)[outcome], g.aws - g.hs, -step, g.kickoff, fade)
    return None if values is None else (g.league, g.game_id, g.kickoff, outcome, *values)


def learned_features(games: DataFrame, least: int = 5, fade: float = 0.92) -> DataFrame:
    """(league, game_id, kickoff, outcome, FEATURES): what was known before each game; a game changes nothing before it is over."""

    def step(state, g):
        found = replay_step(state, g, least, fade)
        return () if found is None else (found,)

    rows = games.select("league", "kickoff", "game_id", "home", "away", "hs", "aws")
    return in_time(rows, dict, step, _nothing, ("league", "game_id", "kickoff", "outcome", *FEATURES), "league int, game_id bigint, kickoff bigint, outcome int, " + ", ".join(f"{f} double" for f in FEATURES))


def decayed_rates(views: DataFrame, least: int = 5, fade: float = 0.92) -> DataFrame:
    """(league, team, game_id, scored, conceded): faded means of goals over all of a team's games before each, from its game `least` + 1 on.

    Two sums and a weight a side are carried from game to game, so a team's history costs one pass over it.
    """

    def each(pdf):
        import numpy as np

        pdf = pdf.sort_values(["kickoff", "game_id"])
        sums, weight, out = np.zeros(2), 0.0, []
        for goals in pdf[["gf", "ga"]].to_numpy(float):
            out.append(sums / weight if weight else sums)
            sums, weight = sums * fade + goals, weight * fade + 1
        pdf[["scored", "conceded"]] = np.array(out).reshape(-1, 2)
        return pdf[["league", "team", "game_id", "scored", "conceded"]].iloc[least:]

    return views.groupBy("league", "team").applyInPandas(each, "league int, team int, game_id bigint, scored double, conceded double")
