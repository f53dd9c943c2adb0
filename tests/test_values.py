"""Hand-computed values and invariants of the engine's functions and operators."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import SPARK
from oddsmith.operators import clusters, folds, learning, neighbours, news, quantiles, ratings, store, titles, volatility
from oddsmith.plans import catalog, custom, markets, relations
from oddsmith.plans import text as texts
from oddsmith.sources import adapters


def one(spark, sql):
    return spark.sql(f"SELECT {sql} AS x").first()["x"]


def test_rsi_of_a_known_series():
    closes = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41]
    got = folds.rsi(np.array(closes), 14)
    assert np.allclose(got[14:18], [70.464135, 66.249619, 66.480942, 69.346853], atol=1e-6)
    assert np.allclose(folds.rsi(np.array([10, 11, 10.5, 11.5, 12]), 3)[3:], [80, 84.6153846])
    assert folds.rsi(np.full(20, 5.0), 14)[14] == 50 and folds.rsi(np.arange(20.0), 14)[14] == 100


def test_short_series_warm_up():
    for n in (0, 1, 2, 5):
        x = np.arange(float(n))
        assert np.isnan(folds.ema(x, 12)).all() and np.isnan(folds.atr(x, x, x)).all() and all(np.isnan(v).all() for v in folds.adx(x, x, x))
        assert all(len(v) == n for v in folds.macd(x))


def test_indicators_are_finite_on_hard_series():
    rng = random.Random(31)
    for scale, start in ((0.05, 100.0), (0.4, 100.0), (0.0, 100.0), (0.05, 0.15), (0.05, 118_000.0)):
        c = np.array([start] + [0.0] * 299)
        for i in range(1, 300):
            c[i] = c[i - 1] * math.exp(rng.uniform(-scale, scale))
        h, low = c * (1 + scale / 2), c * (1 - scale / 2)
        for v in (*folds.macd(c), folds.rsi(c), folds.atr(h, low, c), *folds.adx(h, low, c), folds.ewma_vol(folds.log_returns(c))):
            assert np.isfinite(v[60:]).all()


def test_probability_functions(spark):
    assert one(spark, P.clamp_probability("CAST(NULL AS DOUBLE)")) == 0.5 and one(spark, P.clamp_probability("2e0")) == 1 - 1e-9
    assert one(spark, P.sigmoid("-800e0")) == 0.0 and one(spark, P.sigmoid("800e0")) == 1.0 and abs(one(spark, P.sigmoid(P.logit("0.3e0"))) - 0.3) < 1e-12
    assert one(spark, P.js_round("-0.5e0")) == 0 and one(spark, P.js_round("2.5e0")) == 3
    assert (one(spark, P.american("2.5e0")), one(spark, P.american("1.5e0")), one(spark, P.american("1e0"))) == (150, -200, None)
    assert one(spark, P.erf("0e0")) == 0 and abs(one(spark, P.normal_cdf("1.96e0")) - 0.975) < 1e-4 and abs(one(spark, P.normal_quantile("0.975e0")) - 1.959964) < 1e-6
    assert abs(one(spark, P.normal_quantile("0.001e0")) + 3.090232) < 1e-6 and abs(one(spark, P.normal_quantile("0.999e0")) - 3.090232) < 1e-6
    assert abs(one(spark, P.kelly_fraction("0.6e0", "2e0")) - 0.2) < 1e-12 and one(spark, P.kelly_fraction("0.4e0", "2e0")) == 0


def test_score_matrix_sums_to_one(spark):
    catalog.register(spark, "/root/testdata/sf0.001")
    rows = spark.sql(f"WITH {relations.matrix(SPARK)} SELECT pair, sum(p) AS total, min(p) AS least FROM cells GROUP BY pair").collect()
    assert len(rows) > 100 and all(abs(r.total - 1) < 1e-9 and r.least >= 0 for r in rows)


def _games(n=300, teams=8, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample(range(teams), 2)
        rows.append((1, i, 86_400_000 * (i // 4), a, b, rng.randrange(5), rng.randrange(4)))
    return rows


GAME = "league int, game_id long, kickoff long, home int, away int, hs int, aws int"


def test_ratings(spark):
    rows = _games()
    df = spark.createDataFrame(rows, GAME)
    assert abs(sum(r.rating for r in ratings.batch_elo(df).collect()) - 1500 * 8) < 1e-6
    history = ratings.elo_history(df).collect()
    assert abs(sum(r.after - r.before for r in history)) < 1e-6 and len(history) == 600
    order = spark.createDataFrame([(1, i, i * 86_400_000, a, b, 3 if a < b else 0, 0 if a < b else 3) for i, (a, b) in enumerate([(a, b) for _ in range(4) for a in range(4) for b in range(4) if a != b])], GAME)
    rated = {r.team: r.rating for r in ratings.batch_elo(order).collect()}
    assert sorted(rated, key=rated.get, reverse=True) == [0, 1, 2, 3]
    fit = {r.team: r for r in ratings.attack_defence(order).collect()}
    assert fit[0].attack > fit[3].attack and fit[0].defence < fit[3].defence


def test_features_do_not_see_the_future(spark):
    rows = _games()
    changed = [r if r[1] < 200 else (*r[:5], 4, 0) for r in rows]
    early = lambda x: sorted(tuple(r) for r in ratings.learned_features(spark.createDataFrame(x, GAME)).where("game_id <= 200").drop("outcome").collect())
    assert early(rows) == early(changed) and len(early(rows)) > 50


def test_logistic_and_isotonic():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 0] > 1).astype(int)
    w = learning.train_logistic(x, y)
    assert (learning.predict(w, x).argmax(1) == y).mean() > 0.75 and np.allclose(learning.train_logistic(x, y), w)
    p = rng.random(40)
    v = (rng.random(40) < p).astype(float)
    pools = learning.pool_adjacent_violators(p, v)
    o = v[np.argsort(p)]
    minimax = [max(min(o[i : k + 1].mean() for k in range(j, 40)) for i in range(j + 1)) for j in range(40)]
    got = [y for _, y, n in pools for _ in range(int(n))]
    assert np.allclose(got, minimax)


def test_store_and_throttle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), (None, 1, 5)], "k string, v long, at long")
    for _ in range(2):
        store.append_new(rows, str(tmp_path / "s"), ["k"], "at")
    assert sorted((str(r.k), r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("None", 1), ("a", 2), ("b", 1)]
    beats = spark.createDataFrame([("x", t * 600_000) for t in range(10)], "k string, at long")
    assert sorted(r["at"] for r in store.throttled(beats, "k", "at").collect()) == [0, 1_800_000, 3_600_000, 5_400_000]


def test_title_tokens_and_hash(spark):
    spark.sql("SELECT 'Will the Bulls win 2026 games? class 5' AS title").createOrReplaceTempView("one_title")
    assert spark.sql(f"SELECT {markets.title_tokens(SPARK, 'title')} AS t FROM one_title").first().t == ["bull", "class", "game", "win"]
    assert one(spark, texts.fnv1a(SPARK, "'ab'")) == 1294271946


def test_adapters(spark):
    raw = lambda *x: spark.createDataFrame([(v,) for v in x], "payload string")
    quoted = adapters.dollar_markets(raw('{"ticker":"T","title":"x","last_price_dollars":"0.10","yes_bid_dollars":"0.08","yes_ask_dollars":"0.12"}', '{"ticker":"U","yes_bid_dollars":"bad"}')).collect()
    assert [(r.ticker, r.yes, r.no, r.spread) for r in quoted] == [("T", 0.1, 0.9, 0.04)]
    coded = adapters.encoded_markets(raw('{"id":"1","question":"q","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"0.775\\",\\"0.225\\"]","bestBid":0.77,"bestAsk":0.78}', '{"id":"2","outcomes":"[\\"Yes\\"]","outcomePrices":"[\\"0.5\\",\\"0.5\\"]"}')).collect()
    assert [(r.outcome, r.p, round(r.bid, 2), round(r.ask, 2)) for r in coded] == [("Yes", 0.775, 0.77, 0.78), ("No", 0.225, 0.22, 0.23)]
    book = spark.createDataFrame([("m", [["0.60", "5"], ["x", "1"]], [["0.30", "7"]])], "market string, yes array<array<string>>, no array<array<string>>")
    assert sorted((r.side, r.price, r["size"]) for r in adapters.reflected_book(book).collect()) == [("ask", 0.7, 7.0), ("bid", 0.6, 5.0)]
    xml = "<rss><item><title><![CDATA[A <b>b</b>]]></title><link>http://x/1</link><pubDate>Mon</pubDate><description>d &amp; e</description></item><item><title>no link</title></item></rss>"
    assert [(r.title, r.url, r.date) for r in adapters.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).collect()] == [("A b", "http://x/1", "Mon")]
    odds = '{"id":"g","home_team":"H","away_team":"A","commence_time":"t0","bookmakers":[{"key":"b","last_update":null,"markets":[{"key":"h2h","outcomes":[{"name":"H","price":2.1}]},{"key":"spreads","outcomes":[]}]}]}'
    assert [(r.outcome, r.odds, r.updated) for r in adapters.odds_rows(raw(odds)).collect()] == [("H", 2.1, "t0")]
    bars = spark.createDataFrame([("s", ["120", "1", "3", "2", "2.5", "9"]), ("s", ["60", "1", "3", "2", "2.5", "9"]), ("s", ["bad"])], "symbol string, candle array<string>")
    assert [r.open_time for r in adapters.array_candles(bars, 60, 1).collect()] == [120_000]
    two = adapters.with_fallback([("a", spark.createDataFrame([(1, "x")], "k int, v string")), ("b", spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string"))], ["k"])
    assert sorted((r.k, r.v, r.provider) for r in two.collect()) == [(1, "x", "a"), (2, "z", "b")]


def test_demo_season_and_candles(spark):
    from collections import Counter

    from oddsmith.sources import demo

    rows = demo.season(spark, 8).collect()
    assert len(rows) == 56 and set(Counter((r.home, r.away) for r in rows).values()) == {1} and all(r.home != r.away for r in rows)
    assert all(len({t for r in rows if r["round"] == k for t in (r.home, r.away)}) == 8 for k in range(14))
    bars = demo.candles(spark, 2, 50)
    assert bars.where("h < greatest(o, c) or l > least(o, c)").count() == 0 and bars.collect() == demo.candles(spark, 2, 50).collect()


@pytest.mark.parametrize("name", ["stream_candles", "stream_deduplicated", "stream_throttled", "candle_predict", "sports_match_ensemble"])
def test_registered_custom_plans_run(spark, name):
    from oddsmith.plans import catalog

    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


SF = "/root/testdata/sf0.001"


def test_odds_queries_see_every_order_and_game(spark):
    found = catalog.queries()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for name in ("prob_normalize", "prob_odds_conversions", "prob_devig_multiplicative", "prob_devig_power", "prob_analyse_edge", "prob_kelly"):
        assert found[name](spark, SF).count() == 3 * orders.count(), name
    games = custom.games(spark, SF).collect()
    rows = found["odds_book_comparison"](spark, SF).collect()
    assert sorted((r.gid, r.key) for r in rows) == sorted((g.game_id, k) for g in games for k in ("home", "draw", "away"))
    sides = sorted((g.kickoff, g.game_id, g.league, *s) for g in games for s in ((g.home, g.hs, g.aws), (g.away, g.aws, g.hs)))
    past, want = {}, {}
    for _, game, league, team, gf, ga in sides:
        own = past.setdefault((league, team), [])
        if len(own) >= 5:
            weights = [0.92**i for i in range(min(200, len(own)))]
            last = own[::-1][:200]
            want[league, team, game] = [sum(w * x[i] for w, x in zip(weights, last, strict=True)) / sum(weights) for i in (0, 1)]
        own.append((gf, ga))
    got = {(r.league, r.team, r.game_id): [r.scored, r.conceded] for r in found["sports_decayed_features"](spark, SF).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_missing_capabilities_of_all_customers(spark):
    sf = SF.replace("0.001", "0.01")
    customers = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    held = {(r.o_custkey, r.o_orderpriority) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    want = {(c, p) for c in customers for p in {p for _, p in held}} - held
    got = [tuple(r) for r in catalog.queries()["data_quality_missing"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and max(c for c, _ in got) > 200


def test_stories_reach_over_48_hours(spark):
    hour = 3_600_000
    rows = [(1, 0, "fed cuts rates"), (2, 4 * hour - 1, "storm hits coast"), (3, 4 * hour + 1, "storm hits coast"), (4, 40 * hour, "fed cuts rates"), (5, 69 * hour, "fed cuts rates"), (6, 118 * hour, "fed cuts rates"), (7, 119 * hour, ""), (8, 500 * hour, "fed cuts rates")]
    rows = [(i, at, title.split()) for i, at, title in rows]
    got = clusters.story_clusters(spark.createDataFrame(rows, "id long, published long, tokens array<string>"))
    # the mean of 1 and 4 is hour 20, 49 before 5
    assert {r.id: r.cluster for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}


def test_stories_by_brute_force(spark):
    rows = custom._sql(spark, SF, f"WITH {relations.articles(SPARK)} SELECT id, published, {texts.tokens(SPARK, 'title')} AS tokens FROM articles").collect()
    df = Counter(w for r in rows for w in set(r.tokens))
    found, want = [], {}
    for r in sorted(rows, key=lambda r: (r.published, r.id)):
        v = {w: n * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for w, n in Counter(r.tokens).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        alike = [(sum(x / size * c[2][w] for w, x in v.items()) / (math.sqrt(sum(x * x for x in c[2].values())) or 1), -i) for i, c in enumerate(found) if abs(r.published - c[1] / c[3]) <= 48 * 3_600_000]
        best = max(alike, default=(0, 0))
        if best[0] < 0.45:
            found.append([r.id, 0, Counter(), 0])
            best = (1, -(len(found) - 1))
        c = found[-best[1]]
        for w, x in v.items():
            c[2][w] += x / size
        c[1], c[3], want[r.id] = c[1] + r.published, c[3] + 1, c[0]
    assert {r.id: r.cluster for r in catalog.queries()["text_story_clusters"](spark, SF).collect()} == want


def test_tfidf_reads_all_articles(spark):
    n = custom._sql(spark, SF, f"WITH {relations.articles(SPARK)}, t AS (SELECT id, {texts.tokens(SPARK, 'title')} AS tokens FROM articles) SELECT DISTINCT w FROM t LATERAL VIEW explode(tokens) x AS w").count()
    found = catalog.queries()
    assert found["text_idf"](spark, SF).count() == n > 50
    rows = found["text_tfidf_cosine"](spark, SF).collect()
    tokens = {r.id: set(r.tokens) for r in custom._sql(spark, SF, f"WITH {relations.articles(SPARK)} SELECT id, {texts.tokens(SPARK, 'title')} AS tokens FROM articles").collect()}
    want = {(a, b) for a in tokens if a % 50 == 0 for b in tokens if a != b and tokens[a] & tokens[b]}
    assert len(want) >= 10 and {(r.a, r.b) for r in rows} == want and all(0 < r.cosine <= 1 + 1e-6 for r in rows)


def test_isotonic_fit_over_stretches(spark):
    rng = random.Random(4)
    rows = [(d, round(rng.random(), 4), float(rng.random() < 0.4)) for d in ("a", "b") for _ in range(700)] + [("a", None, 1.0), ("b", 0.5, None)]
    data = spark.createDataFrame(rows, "domain string, p double, y double").repartition(7)
    got = learning.isotonic_fit(data).collect()
    for domain in ("a", "b"):
        sums = {}
        for d, p, y in rows:
            if d == domain and p is not None and y is not None:
                sums.setdefault(p, []).append(y)
        points = [(p, sum(v) / len(v), len(v)) for p, v in sorted(sums.items())]
        want = learning.pool_adjacent_violators([p for p, _, n in points for _ in range(n)], [y for _, y, n in points for _ in range(n)])
        own = sorted((r.x, r.y, r.weight) for r in got if r.domain == domain)
        assert np.allclose(own, want) and all(r.usable for r in got)


def test_learned_voter(spark):
    rng = random.Random(8)
    rows = [(1, i, i * 86_400_000, h, a, 3 if h < a else rng.randrange(2), rng.randrange(2)) for i in range(260) for h, a in [tuple(rng.sample(range(6), 2))]]
    rows += [(2, 1000 + i, i * 86_400_000, 1, 2, 1, 0) for i in range(20)]
    games = spark.createDataFrame(rows, "league int, game_id long, kickoff long, home int, away int, hs int, aws int")
    fixtures = spark.createDataFrame([(1, 0, 5), (1, 5, 0), (1, 0, 9), (2, 1, 2)], "league int, home int, away int")
    got = {(r.league, r.home, r.away): r for r in learning.learned_outcomes(fixtures, games).collect()}
    assert set(got) == {(1, 0, 5), (1, 5, 0)} and all(abs(r.home_p + r.draw_p + r.away_p - 1) < 1e-9 for r in got.values())
    assert got[1, 0, 5].home_p > 0.6 > got[1, 5, 0].home_p and 1 <= len(got[1, 0, 5].factors) <= 3
    assert abs(got[1, 0, 5].confidence - 0.5) < 0.02


def test_entities_derive_the_text_once_and_not_for_every_name(spark):
    said = [(1, "Bitcoin ETF and bitcoin; BTC, btc"), (2, None), (3, "the fed, the Fed"), (4, "apple pie"), (5, "İBİTCOİN bitcoiné Bitcoin")]
    articles = spark.createDataFrame([(i, t and t[::-1]) for i, t in said], "id long, backwards string").select("id", F.reverse("backwards").alias("title"))
    for found in (news.entity_rows(articles), news.entity_sentiment(articles)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert {(r.id, r.entity): r.n for r in news.entity_rows(articles).collect()} == {(1, "btc"): 3, (1, "crypto-etf"): 1, (3, "fed"): 1, (5, "btc"): 2}


def test_odds_are_matched_by_spelling_and_not_by_pairs_of_games_and_events(spark, monkeypatch):
    sizes, inner = [], titles.club_pairs
    monkeypatch.setattr(titles, "club_pairs", lambda left, right, on: (sizes.append((left.count(), right.count())), inner(left, right, on))[1])
    hour, row = 3_600_000, "long, kickoff long, home array<string>, away array<string>"
    games = [(i, 0, ["united", "kingdom"], ["iran"]) for i in range(50)] + [(50, 10 * hour, ["china"], ["peru"]), (51, 20 * hour, ["china"], ["peru"]), (52, -hour, ["iraq"], ["peru"]), (53, None, ["iraq"], ["peru"]), (54, 0, [], ["peru"])]
    events = [(i, hour, ["united", "kingdom", "north"], ["ira"]) for i in range(100, 150)] + [(7, 13 * hour, ["ch"], ["peru", "united"]), (8, 24 * hour, ["china"], ["peru"]), (9, -3 * hour, ["i"], ["peru"]), (10, 0, [], ["peru"])]
    found = titles.game_odds_matches(spark.createDataFrame(games, f"game {row}"), spark.createDataFrame(events, f"event {row}"))
    assert sorted(map(tuple, found.collect())) == [(50, 7), (52, 9)]
    assert sizes == [(6, 8)]


def test_nearest_neighbours_by_blocks_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, vectors[i % 60]) for i in range(400)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [1.0, 2.0]), (403, [2.0, 4.0]), (450, None)]
    known = {i: v for i, v in rows if v is not None and None not in v}

    def cosine(a, b):
        if a not in known or b not in known or len(known[a]) != len(known[b]):
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        x, y = known[a], known[b]
        return round(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))), 9)

    want = set()
    for q in (i for i, _ in rows if i % 50 == 0 or i == 402):
        all_of = sorted(((c is None, -(c or 0), v) for v, _ in rows if v != q for c in [cosine(q, v)]))
        want |= {(q, v, rk) for rk, (*_, v) in enumerate(all_of[:5], 1)}
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(7)
    monkeypatch.setattr(neighbours, "_QUERIES", 3)
    found = neighbours.nearest(df, df.where("id % 50 = 0 or id = 402"))
    assert {(r.q, r.v, r.rk) for r in found.collect()} == want


def test_forecast_of_a_series_that_fell_to_zero(spark):
    bars = [(asset, rn, 2.0, 3.0, 0.0 if asset > "a" and rn == 35 else 1.0, 0.0 if asset == "c" and rn == 35 else 2.5) for asset in "abc" for rn in range(1, 41)]
    own = spark.createDataFrame([(asset, rn, o, h, low, 2.0) for asset, rn, c, h, low, o in bars], "asset string, rn long, o double, h double, l double, c double")
    found = {r.asset: r for r in volatility.forecasts(own, own.withColumn("ewma_vol", F.lit(0.1))).collect()}
    assert math.isfinite(found["a"].expected_move) and math.isnan(found["c"].expected_move) and math.isnan(found["c"].vol_confidence)
    assert (found["b"].expected_move, found["b"].range_low) == (math.inf, -math.inf) and abs(found["b"].vol_confidence - 0.45 * 0.2 / (1 + math.log(2) / 6)) < 1e-12


def test_word_cosines_over_blocks(spark):
    from collections import defaultdict

    from oddsmith.operators import neighbours

    rows = [(i, f"w{(i * k) % 97}", 0.1 + k / 10) for i in range(1500) for k in (1, 3, 7)] + [(None, "w1", 1.0), (7000, "alone", 1.0)]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [r for r in rows if r[0] == 50]  # asked twice, counts twice
    by, expected = defaultdict(list), defaultdict(float)
    for b, w, x in rows:
        by[w].append((b, x))
    for a, w, x in asked:
        for b, y in by[w]:
            if b is not None and a != b:
                expected[a, b] += x * y
    frame = lambda r: spark.createDataFrame(r, "id long, w string, x double")
    found = {(r.a, r.b): r.cosine for r in neighbours.word_cosines(frame(rows), frame(asked)).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())


def test_link_groups_hold_and_send_no_links(spark, tmp_path):
    """A dense group, a long chain and repeated links: least ids, and neither cached links nor a broadcast side stay behind."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(a, b) for a in range(40) for b in range(a)] + [(i, i + 1) for i in range(100, 160)] + [(160, 100), (7, 7), (100, 101)]
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = {r.id: r.root for r in clusters.link_groups(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(40)} | {i: 100 for i in range(100, 161)}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_title_links_against_all_pairs(spark):
    rng, rows = random.Random(6), []
    for i in range(120):
        tokens = sorted(rng.sample([f"t{n}" for n in range(12)], rng.randint(0, 9)))
        rows.append((i, tokens))
    first = {}
    for i, tokens in rows:
        first.setdefault(tuple(tokens), i)
    sets = [(i, set(t)) for t, i in first.items() if t]
    want = {(a, b, len(x & y) / len(x | y)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) > 0.6}
    assert {tuple(r) for r in clusters.title_links(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.6).collect()} == want and len(want) > 50


@pytest.mark.parametrize("around", [5e-4, -2.0])  # a bracket that misses: all values are sorted
def test_linear_quantiles_equal_percentile(spark, monkeypatch, around):
    monkeypatch.setattr(quantiles, "_AROUND", around)
    rng = random.Random(8)
    rows = [(k, rng.choice([round(rng.gauss(0, 9), 2), 1.5, float("inf"), None])) for k in ("a", "b", None) for _ in range(3001)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    data = spark.createDataFrame(rows, "key string, x double").repartition(5)
    shares = {"q1": 0.25, "mid": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    want = data.groupBy("key").agg(*(F.percentile("x", F.lit(q)).alias(c) for c, q in shares.items())).collect()
    assert {tuple(r) for r in quantiles.linear_quantiles(data, shares).collect()} == {tuple(r) for r in want} and len(want) == 6


def test_quantiles_of_a_table_hold_no_group(spark):
    plan = catalog.queries()["agg_quantile_linear"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
