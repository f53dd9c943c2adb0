"""Payloads of single venues: what is kept, dropped and null."""

import json

from oddsmith.sources import venues


def test_candles_and_derivatives(spark):
    raw = spark.createDataFrame([("S", ["60", "1", "3", "0.5", "2", "x", "9", "4"]), ("S", ["120", "1", "3", "bad", "2", "x", "9", "4"]), ("S", ["180", "2", "2", "2", "2", "x", "1", "4"])], "symbol string, candle array<string>")
    assert [(r.open_time, r.close_time, r.v, r.taker_buy) for r in venues.count_candles(raw, 60, 1).collect()] == [(180_000, 239_999, 1.0, None)]
    assert venues.count_candles(raw, 60).count() == 2
    raw = spark.createDataFrame([("S", ["1", "1", "3", "0.5", "2", "7", "9", "0", "12", "3.5"]), ("S", ["2", "1", "3", "0.5", "2", "7", "9", "0", "12", "?"])], "symbol string, candle array<string>")
    assert sorted((r.open_time, r.trades, r.taker_buy) for r in venues.taker_candles(raw).select("open_time", "trades", "taker_buy").na.fill(-1.0).collect()) == [(1, 12, 3.5), (2, 12, -1.0)]
    funding = spark.createDataFrame([("A", "0.0001", 5), ("B", "x", 6)], "symbol string, rate string, at long")
    interest = spark.createDataFrame([("A", "10"), ("C", "3")], "symbol string, amount string")
    prices = spark.createDataFrame([("A", 2.0), ("B", 3.0)], "symbol string, price double")
    got = {r.symbol: (r.funding_rate, r.open_interest, r.open_interest_value) for r in venues.derivatives(funding, interest, prices).collect()}
    assert got == {"A": (0.0001, 10.0, 20.0), "B": (None, None, None)}


def event(ident, name, home, away, date="2026-08-01T12:00Z", **more):
    sides = [{"homeAway": "home", "score": home, "team": {"id": "1", "displayName": "One"}}, {"homeAway": "away", "score": away, "team": {"id": "2"}}]
    return json.dumps({"id": ident, "date": date, "season": {"year": 2026}, "competitions": [{"status": {"type": {"name": name}}, "competitors": sides}]} | more)


def test_scoreboards(spark):
    rows = [("L", event("a", "STATUS_SCHEDULED", "0", "0")), ("L", event("b", "STATUS_FULL_TIME", "3", {"value": 1.0})), ("L", event("c", "STATUS_FULL_TIME", "3", "1", "never")), ("L", event("d", "STATUS_FULL_TIME", "3", "1", competitions=[])), ("L", "{")]
    games = venues.scoreboard_games(spark.createDataFrame(rows, "league string, payload string"))
    got = {r.game_id: (r.status, r.home_score, r.away_score, r.home, r.away_name, r.season) for r in games.collect()}
    assert got == {"L:a": ("scheduled", None, None, "L:1", "2", "2026"), "L:b": ("finished", 3, 1, "L:1", "2", "2026")}
    assert sorted((r.team, r.is_home, r.result, r.shots) for r in venues.box_scores(games).collect()) == [("L:1", True, "W", None), ("L:2", False, "L", None)]


def test_fixture_service(spark):
    match = lambda i, status, home, away, day: json.dumps({"id": i, "utcDate": f"2026-08-{day:02d}T12:00:00Z", "status": status, "homeTeam": {"id": 1}, "awayTeam": {"id": 2}, "score": {"fullTime": {"home": home, "away": away}}, "season": {"startDate": "2026-08-01"}})
    rows = [match(1, "FINISHED", 1, 1, 1), match(2, "AWARDED", 0, 2, 9), match(3, "PAUSED", 1, 0, 5), match(4, "NEW", None, None, 7), match(5, "FINISHED", None, 1, 11)]
    games = venues.service_games(spark.createDataFrame([("L", r) for r in rows], "league string, payload string"))
    assert {r.game_id: r.status for r in games.collect()} == {"1": "finished", "2": "finished", "3": "live", "4": "scheduled", "5": "finished"}
    assert {r.season for r in games.collect()} == {"2026/27"}
    assert sorted((r.team, r.game_id, r.result) for r in venues.recent_box_scores(games, 1).collect()) == [("1", "2", "L"), ("2", "2", "W")]


def test_trades_books_and_feeds(spark):
    trades = [{"ticker": "T", "yes_price_dollars": "0.4", "count_fp": "3", "created_time": "2026-08-01T00:00:00Z", "taker_side": s} for s in ("yes", "No", None)] + [{"ticker": "T", "yes_price_dollars": "4", "count_fp": "3", "created_time": "2026-08-01T00:00:00Z"}]
    got = venues.dollar_trades(spark.createDataFrame([(json.dumps(t),) for t in trades], "payload string")).collect()
    assert sorted(r.side for r in got) == ["buy", "sell", "unknown"] and {r.price for r in got} == {0.4}
    book = json.dumps({"bids": [{"price": "0.1", "size": "5"}, {"price": "0.3", "size": "2"}], "asks": [{"price": "0.9", "size": "1"}, {"price": "0.5", "size": "x"}, {"price": "0.6", "size": "4"}]})
    levels = venues.clob_levels(spark.createDataFrame([("m", book)], "market string, payload string")).collect()
    assert sorted((r.side, r.level, r.price) for r in levels) == [("ask", 1, 0.6), ("ask", 2, 0.9), ("bid", 1, 0.3), ("bid", 2, 0.1)]
    trade = json.dumps({"market": "m", "price": "0.2", "size": "1", "side": "BUY", "timestamp": 7})
    assert [(r.side, r.at) for r in venues.clob_trades(spark.createDataFrame([(trade,)], "payload string")).collect()] == [("buy", 7000)]
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "feed string, title string")
    feeds = spark.createDataFrame([("a", "crypto", "OFFICIAL")], "feed string, category string, reliability string")
    assert sorted((r.feed, r.category, r.reliability) for r in venues.with_feeds(items, feeds).collect()) == [("a", "crypto", "OFFICIAL"), ("b", None, "UNVERIFIED")]
