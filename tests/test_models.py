import random
import tracemalloc
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import fixtures, learning, ratings, registry
from tests.test_streams import GAME, season

KEYS, OUTCOMES = ("id",), ("up", "down")


def test_registry_contract(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    models = registry.Registry(KEYS, OUTCOMES)
    with pytest.raises(ValueError, match="no model"):
        models.outputs(asked)
    models.register(registry.Model("sure", "1", OUTCOMES, lambda s: s.where("id < 3").selectExpr("id", "0.75 AS up", "0.25 AS down"), "unknown id"))
    models.register(registry.Model("broken", "2", OUTCOMES, lambda s: s.selectExpr("id", "id * 0.5 AS up", "0.5 AS down")))
    with pytest.raises(ValueError, match="already"):
        models.register(registry.Model("sure", "2", OUTCOMES, lambda s: s))
    with pytest.raises(ValueError, match="gives"):
        models.register(registry.Model("other", "1", ("yes", "no"), lambda s: s))
    rows = {(r.model, r.id): (r.up, r.abstained, r.reason) for r in models.outputs(asked).collect()}
    assert rows[("sure", 1)] == (0.75, False, None) and rows[("sure", 3)] == (None, True, "unknown id")
    assert rows[("broken", 1)] == (0.5, False, None) and rows[("broken", 2)][1:] == (True, "probabilities are none that sum to one")
    models.register(registry.Model("half", "1", OUTCOMES, lambda s: s.selectExpr("id", "1.0 AS up")))
    with pytest.raises(ValueError, match="lacks"):
        models.outputs(asked)


def sample_frame(spark, n=310):
    rng = np.random.default_rng(4)
    rows = [(i % 2, i, 1000 * i, int(rng.integers(0, 3)), *map(float, rng.normal(size=2))) for i in range(n)]
    return spark.createDataFrame(rows, "league int, game_id long, kickoff long, outcome int, a double, b double"), rows


def test_walk_forward_folds_and_totals(spark):
    samples, rows = sample_frame(spark)
    shares = lambda x, y: lambda asked: np.tile(np.bincount(y, minlength=3) / len(y), (len(asked), 1))
    folds = learning.walk_forward(samples, ("a", "b"), shares, first=60, step=20)
    got = {(r.league, r.fold): r for r in folds.collect()}
    for league in (0, 1):
        y = [r[3] for r in rows if r[0] == league]
        cuts = range(60, len(y), 20)
        assert sorted(f for g, f in got if g == league) == list(range(len(cuts)))
        for fold, cut in enumerate(cuts):
            r, base, judged = got[league, fold], np.bincount(y[:cut], minlength=3) / cut, y[cut : cut + 20]
            assert (r.trained, r.n) == (cut, len(judged)) and r.brier == pytest.approx(np.mean([((base - np.eye(3)[k]) ** 2).sum() for k in judged])) == pytest.approx(r.base_brier)
    kept = learning.walk_forward(samples, ("a", "b"), first=60, step=20, most=2)
    assert sorted((r.league, r.fold) for r in kept.collect()) == [(g, f) for g in (0, 1) for f in (3, 4)]
    totals = {r.league: r for r in learning.walk_forward_totals(folds).collect()}
    own = [got[0, f] for f in range(5)]
    assert totals[0].n == sum(r.n for r in own) and totals[0].brier == pytest.approx(sum(r.brier * r.n for r in own) / totals[0].n) and totals[0].skill == pytest.approx(0)
    assert learning.walk_forward(samples.where("game_id < 100"), ("a", "b"), first=60).count() == 0


def test_trainer_must_give_probabilities(spark):
    samples, _ = sample_frame(spark, 200)
    with pytest.raises(Exception, match="sum to one"):
        learning.walk_forward(samples, ("a", "b"), lambda x, y: lambda asked: np.ones((len(asked), 3)), first=60).collect()


def test_two_models_abstain_and_pool(spark):
    games = spark.createDataFrame(season(60) + [(0, 900, 10**12, 77, 78, 1, 1)], GAME)
    views, history = fixtures.team_views(games), ratings.elo_history(games)
    rows = {(r.league, r.home, r.away): r for r in fixtures.two_model_predictions(games.select("league", "home", "away").distinct(), games, views, history).collect()}
    new = rows[0, 77, 78]
    assert new.voters == 0 and new.agreement == 0 and new.home_p == pytest.approx(1 / 3)
    for r in rows.values():
        assert r.home_p + r.draw_p + r.away_p == pytest.approx(1) and 0.01 <= r.confidence <= 0.95
        if r.voters:
            assert np.sign(r.venue_factor) == (-1 if r.away_p > max(r.home_p, r.draw_p) else 1)


def test_form_shares_missing_expected_goals(spark):
    games = spark.createDataFrame([(0, i, i * 86_400_000, 1, 2, 2, 0) for i in range(6)], GAME)
    level = games.select("game_id", F.lit(1.0).alias("home_xg"), F.lit(1.0).alias("away_xg"))
    history = ratings.elo_history(games)
    form = lambda xg: {r.team: r.raw for r in fixtures.form(fixtures.team_views(games, xg), history).collect()}
    none, some = form(None), form(level)
    assert none[1] > some[1] > 0.5 > some[2] > none[2]  # an even expectation pulls towards the middle, a missing one does not


def test_no_league_is_held_whole(spark):
    random.seed(1)
    rows = [(i % 2, i, 86_400_000 * i, *random.sample(range(6), 2), random.randint(0, 4), random.randint(0, 3)) for i in range(300)]
    games = spark.createDataFrame(rows, "league int, game_id long, kickoff long, home int, away int, hs long, aws long")
    for found in (ratings.batch_elo(games), ratings.elo_history(games), ratings.learned_features(games), learning.learned_outcomes(games.select("league", "home", "away").distinct(), games), learning.walk_forward(ratings.learned_features(games), ratings.FEATURES)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMap" not in plan
    size, want = "spark.sql.execution.arrow.maxRecordsPerBatch", sorted(map(tuple, ratings.elo_history(games).collect()))
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert sorted(map(tuple, ratings.elo_history(games).collect())) == want
    finally:
        spark.conf.set(size, before)


def test_samples_of_a_league_wait_outside_memory(spark, monkeypatch):
    used = {}
    monkeypatch.setattr(ratings, "in_time", lambda rows, start, step, *_: used.update(start=start, step=step))
    games = spark.createDataFrame([], "league int, game_id long, kickoff long, home int, away int, hs long, aws long")
    learning.learned_outcomes(games.select("league", "home", "away"), games)
    game = namedtuple("game", "league asked kickoff game_id home away hs aws")
    rng, known, sizes, samples, sides = random.Random(3), used["start"](), [], [], {}
    tracemalloc.start()
    for i in range(50_000):
        row = game(1, False, 3_600_000 * i, i, *rng.sample(range(25), 2), rng.randrange(5), rng.randrange(4))
        used["step"](known, row)
        if i in (10_000, 49_999):
            sizes.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert sizes[1] - sizes[0] < 500_000  # 40,000 samples of 41 bytes are 1,640,000
    rng = random.Random(3)
    for i in range(50_000):
        sample = ratings.replay_step(sides, game(1, False, 3_600_000 * i, i, *rng.sample(range(25), 2), rng.randrange(5), rng.randrange(4)))
        samples += [] if sample is None else [sample[3:]]
    (got,) = used["step"](known, game(1, True, 0, 0, 0, 1, 0, 0))
    x, y = np.array([s[1:] for s in samples], float), np.array([s[0] for s in samples], np.int8)
    w = learning.train_logistic(x, y, 3, 0.5, 300, 0.02)
    assert np.array_equal(known.w, w) and got[4:7] == tuple(learning.predict(w, np.array([ratings.fixture_values(sides, 0, 1, 3_600_000 * 49_999)]))[0])
