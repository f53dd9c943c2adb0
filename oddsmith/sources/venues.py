"""Adapters of single venues' payloads. As in adapters.py payloads are columns, and what does not parse is dropped or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.sources.adapters import game_status

#: A fixture service's statuses and the engine's; a new one is scheduled, as nothing may be settled against it.
MATCH_STATUS = {
    "SCHEDULED": "scheduled", "TIMED": "scheduled", "IN_PLAY": "live", "PAUSED": "live", "FINISHED": "finished", "AWARDED": "finished",
    "POSTPONED": "postponed", "SUSPENDED": "postponed", "CANCELLED": "cancelled",
}


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} as double)")


def _instant(c: str) -> Column:
    """Milliseconds of an ISO time, with or without seconds; null where it is none."""
    return F.expr(f"""unix_millis(coalesce(try_to_timestamp({c}), try_to_timestamp({c}, "yyyy-MM-dd'T'HH:mmX")))""")


def _newest(rows: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """The `limit` newest rows of each key."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__back", back).where(F.col("__back") <= limit).drop("__back")


def count_candles(raw: DataFrame, interval_s: int, limit: int = 720) -> DataFrame:
    """raw(symbol, candle array<string>) of [time in seconds, open, high, low, close, vwap, volume, count]: the newest `limit` a symbol.

    A row with a price or a volume that is no number is dropped; taker volume and trades are not told.
    """
    at = lambda i: _number(f"get(candle, {i})")
    rows = raw.select("symbol", (at(0) * 1000).cast("long").alias("open_time"), at(1).alias("o"), at(2).alias("h"), at(3).alias("l"), at(4).alias("c"), at(6).alias("v")).dropna()
    rows = rows.withColumn("close_time", F.col("open_time") + interval_s * 1000 - 1).withColumn("trades", F.lit(None).cast("long")).withColumn("taker_buy", F.lit(None).cast("double"))
    return _newest(rows, ["symbol"], "open_time", limit)


def taker_candles(raw: DataFrame, limit: int = 1000) -> DataFrame:
    """raw(symbol, candle array<string>) of [open time, open, high, low, close, volume, close time, quote volume, trades, taker volume]: at most 1000 a symbol."""
    at = lambda i: _number(f"get(candle, {i})")
    rows = raw.select(
        "symbol", at(0).cast("long").alias("open_time"), at(1).alias("o"), at(2).alias("h"), at(3).alias("l"), at(4).alias("c"), at(5).alias("v"),
        at(6).cast("long").alias("close_time"), at(8).cast("long").alias("trades"), at(9).alias("taker_buy"),
    )
    return _newest(rows.dropna(subset=["open_time", "o", "h", "l", "c", "v"]), ["symbol"], "open_time", min(max(limit, 1), 1000))


def derivatives(funding: DataFrame, interest: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, funding_rate, open_interest, open_interest_value, at) of funding(symbol, rate string, at), interest(symbol, amount string), prices(symbol, price).

    Without a funding row a symbol is not there; a missing interest or price leaves the value null.
    """
    rows = funding.select("symbol", _number("rate").alias("funding_rate"), "at").join(interest.select("symbol", _number("amount").alias("open_interest")), "symbol", "left")
    rows = rows.join(prices.select("symbol", "price"), "symbol", "left")
    return rows.select("symbol", "funding_rate", "open_interest", (F.col("open_interest") * F.col("price")).alias("open_interest_value"), "at")


_TEAM = "struct<id:string,displayName:string>"
_SIDE = f"struct<homeAway:string,id:string,score:string,team:{_TEAM}>"
_EVENT = f"id string, date string, season struct<year:int>, competitions array<struct<status:struct<type:struct<name:string,state:string,completed:boolean>>,venue:struct<fullName:string>,competitors:array<{_SIDE}>>>"


def _events(raw: DataFrame) -> DataFrame:
    """raw(league, payload JSON) with the first competition's sides and status; a score may be a string or an object with a value."""
    e = raw.select("league", F.from_json("payload", _EVENT).alias("e")).select("league", "e.id", "e.date", F.col("e.season.year").alias("year"), F.get("e.competitions", F.lit(0)).alias("c"))
    side = lambda name: F.get(F.filter("c.competitors", lambda x: x["homeAway"] == name), F.lit(0))
    e = e.withColumn("home", side("home")).withColumn("away", side("away")).where("c is not null and home is not null and away is not null")
    e = e.withColumn("kickoff", _instant("date")).where("kickoff is not null")
    return e.withColumn("status", game_status(F.col("c.status.type.name"), F.col("c.status.type.state"), F.col("c.status.type.completed")))


def _score(side: str) -> Column:
    return F.coalesce(_number(f"{side}.score"), _number(f"get_json_object({side}.score, '$.value')"))


def scoreboard_games(raw: DataFrame) -> DataFrame:
    """raw(league, payload JSON): games of scoreboard events. Ids carry the league; scores count only in live and finished games."""
    e = _events(raw)
    played = F.col("status").isin("live", "finished")
    name = lambda c: F.concat_ws(":", "league", c)
    return e.select(
        name("id").alias("game_id"), "league", F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("season"), "kickoff", "status",
        name("home.team.id").alias("home"), name("away.team.id").alias("away"), F.coalesce("home.team.displayName", "home.team.id").alias("home_name"), F.coalesce("away.team.displayName", "away.team.id").alias("away_name"),
        F.when(played, _score("home")).cast("int").alias("home_score"), F.when(played, _score("away")).cast("int").alias("away_score"), F.col("c.venue.fullName").alias("venue"),
    )


def box_scores(games: DataFrame) -> DataFrame:
    """Both teams' sides of finished games with scores; what such feeds do not tell - shots, possession, expected goals - is null."""
    done = games.where("status = 'finished' and home_score is not null and away_score is not null")
    sides = None
    for own, other, home in (("home", "away", True), ("away", "home", False)):
        scored, conceded = F.col(f"{own}_score"), F.col(f"{other}_score")
        one = done.select(
            "game_id", F.col(own).alias("team"), F.lit(home).alias("is_home"), scored.alias("scored"), conceded.alias("conceded"), F.when(scored > conceded, "W").when(scored == conceded, "D").otherwise("L").alias("result"),
            *(F.lit(None).cast("double").alias(c) for c in ("shots", "shots_on_target", "possession", "xg_for", "xg_against")), "kickoff",
        )
        sides = one if sides is None else sides.unionByName(one)
    return sides


def service_games(raw: DataFrame) -> DataFrame:
    """raw(league, payload JSON) of a fixture service's matches; a season is YYYY/YY+1 of its start, a match without teams is dropped."""
    schema = "id long, utcDate string, status string, matchday int, homeTeam struct<id:long,name:string>, awayTeam struct<id:long,name:string>, score struct<fullTime:struct<home:int,away:int>>, season struct<startDate:string>"
    m = raw.select("league", F.from_json("payload", schema).alias("m")).select("league", "m.*").withColumn("kickoff", _instant("utcDate"))
    known = F.create_map(*(F.lit(x) for kv in MATCH_STATUS.items() for x in kv))
    year = F.expr("try_cast(substr(season.startDate, 1, 4) as int)")
    status = F.coalesce(F.try_element_at(known, F.col("status")), F.lit("scheduled"))
    return m.where("kickoff is not null and homeTeam.id is not null and awayTeam.id is not null").select(
        F.col("id").cast("string").alias("game_id"), "league", F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit("/"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).alias("season"), "kickoff", status.alias("status"),
        F.col("homeTeam.id").cast("string").alias("home"), F.col("awayTeam.id").cast("string").alias("away"), F.col("score.fullTime.home").alias("home_score"), F.col("score.fullTime.away").alias("away_score"), "matchday",
    )


def recent_box_scores(games: DataFrame, limit: int) -> DataFrame:
    """The `limit` latest finished games of each team, as box_scores."""
    return _newest(box_scores(games), ["team"], "kickoff", limit)


def dollar_trades(raw: DataFrame) -> DataFrame:
    """raw(payload JSON): trades in yes prices; a taker of yes buys, of no sells, of neither is unknown."""
    t = raw.select(F.from_json("payload", "ticker string, yes_price_dollars string, count_fp string, created_time string, taker_side string").alias("t")).select("t.*")
    taker = F.lower("taker_side")
    rows = t.select("ticker", _number("yes_price_dollars").alias("price"), _number("count_fp").alias("size"), F.when(taker == "yes", "buy").when(taker == "no", "sell").otherwise("unknown").alias("side"), _instant("created_time").alias("at"))
    return rows.where("price between 0 and 1 and size is not null and at is not null")


def clob_levels(raw: DataFrame) -> DataFrame:
    """raw(market, payload JSON with bids and asks of price and size strings, in any order): levels numbered from the best; unparsable ones are dropped."""
    level = "array<struct<price:string,size:string>>"
    b = raw.select("market", F.from_json("payload", f"bids {level}, asks {level}").alias("b"))
    sides = None
    for side, best in (("bids", F.desc), ("asks", F.asc)):
        own = b.select("market", F.lit(side[:-1]).alias("side"), F.explode(f"b.{side}").alias("x")).select("market", "side", _number("x.price").alias("price"), _number("x.size").alias("size")).dropna()
        own = own.withColumn("level", F.row_number().over(Window.partitionBy("market", "side").orderBy(best("price"))))
        sides = own if sides is None else sides.unionByName(own)
    return sides


def clob_trades(raw: DataFrame) -> DataFrame:
    """raw(payload JSON): trades whose time is in seconds; without a price or a size they are dropped."""
    t = raw.select(F.from_json("payload", "market string, price string, size string, side string, timestamp long").alias("t")).select("t.*")
    rows = t.select("market", _number("price").alias("price"), _number("size").alias("size"), F.when(F.lower("side").isin("buy", "sell"), F.lower("side")).otherwise("unknown").alias("side"), (F.col("timestamp") * 1000).alias("at"))
    return rows.where("price is not null and size is not null")


def with_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """items(feed, ...) with category and reliability of feeds(feed, category, reliability); an unknown feed is unverified."""
    known = F.broadcast(feeds.select("feed", "category", F.col("reliability").alias("__r")))  # a table of some dozens of feeds
    return items.join(known, "feed", "left").withColumn("reliability", F.coalesce("__r", F.lit("UNVERIFIED"))).drop("__r")
