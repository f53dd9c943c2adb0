"""Adapters from venues' payloads to the engine's relations. Payloads are columns, so files, tables and streams are read alike;
what does not parse is dropped or null, never an error, and `failures` tells it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status names of a scoreboard feed and the engine's five statuses.
GAME_STATUS = {
    "STATUS_SCHEDULED": "scheduled", "STATUS_IN_PROGRESS": "live", "STATUS_HALFTIME": "live", "STATUS_FIRST_HALF": "live", "STATUS_SECOND_HALF": "live", "STATUS_END_PERIOD": "live", "STATUS_OVERTIME": "live",
    "STATUS_FULL_TIME": "finished", "STATUS_FINAL": "finished", "STATUS_FINAL_AET": "finished", "STATUS_FINAL_PEN": "finished",
    "STATUS_POSTPONED": "postponed", "STATUS_DELAYED": "postponed", "STATUS_SUSPENDED": "postponed", "STATUS_ABANDONED": "postponed", "STATUS_CANCELED": "cancelled", "STATUS_FORFEIT": "cancelled",
}


def array_candles(raw: DataFrame, interval_s: int, limit: int = 300) -> DataFrame:
    """raw(symbol, candle array<string>) of [time, low, high, open, close, volume] in any order: the newest `limit` per symbol."""
    at = lambda i: F.expr(f"try_cast(get(candle, {i}) as double)")
    rows = raw.select("symbol", (at(0) * 1000).cast("long").alias("open_time"), at(3).alias("o"), at(2).alias("h"), at(1).alias("l"), at(4).alias("c"), at(5).alias("v")).dropna()
    rows = rows.withColumn("close_time", F.col("open_time") + interval_s * 1000 - 1)
    rows = rows.withColumn("__n", F.expr("row_number() over (partition by symbol order by open_time desc)"))
    return rows.where(F.col("__n") <= limit).drop("__n")


def book_levels(raw: DataFrame, depth: int = 50) -> DataFrame:
    """raw(book_id, bids, asks arrays of [price, size] strings) to the best `depth` levels per side, best first."""
    sides = None
    for side, order in (("bids", "desc"), ("asks", "asc")):
        own = raw.select("book_id", F.lit(side[:-1]).alias("side"), F.explode(side).alias("x")).selectExpr("book_id", "side", "try_cast(get(x, 0) as double) price", "try_cast(get(x, 1) as double) qty").dropna()
        own = own.withColumn("level", F.expr(f"row_number() over (partition by book_id, side order by price {order})"))
        sides = own if sides is None else sides.unionByName(own)
    return sides.where(F.col("level") <= depth)


def dollar_markets(raw: DataFrame) -> DataFrame:
    """raw(payload JSON): yes/no markets quoted in dollar strings; p = last trade if any, else mid; without either the market is dropped."""
    m = raw.select(F.from_json("payload", "ticker string, title string, last_price_dollars string, yes_bid_dollars string, yes_ask_dollars string, status string, floor_strike double, cap_strike double").alias("m")).select("m.*")
    n = lambda c: F.expr(f"try_cast({c} as double)")
    last, bid, ask = n("last_price_dollars"), n("yes_bid_dollars"), n("yes_ask_dollars")
    p = F.when(last > 0, last).when((bid + ask) > 0, (bid + ask) / 2)
    return m.select("ticker", "title", p.alias("yes"), (1 - p).alias("no"), bid.alias("bid"), ask.alias("ask"), F.round(ask - bid, 4).alias("spread"), "floor_strike", "cap_strike", "status").where("yes is not null and yes between 0 and 1")


def reflected_book(raw: DataFrame) -> DataFrame:
    """raw(market, yes, no arrays of [price, size]): a no bid at p is a yes ask at 1 - p."""
    side = lambda c, s, price: raw.select("market", F.lit(s).alias("side"), F.explode(c).alias("x")).selectExpr("market", "side", "try_cast(get(x, 0) as double) q", "try_cast(get(x, 1) as double) size").dropna().select("market", "side", F.round(price, 4).alias("price"), "size")
    return side("yes", "bid", F.col("q")).unionByName(side("no", "ask", 1 - F.col("q")))


def encoded_markets(raw: DataFrame) -> DataFrame:
    """raw(payload JSON) whose outcome names and prices are JSON arrays inside strings; one bad price or unequal lengths drop the market."""
    m = raw.select(F.from_json("payload", "id string, question string, outcomes string, outcomePrices string, bestBid double, bestAsk double").alias("m")).select("m.*")
    m = m.withColumn("names", F.from_json("outcomes", "array<string>")).withColumn("prices", F.expr("transform(from_json(outcomePrices, 'array<string>'), x -> try_cast(x as double))"))
    m = m.where("size(names) = size(prices) and size(names) > 0 and forall(prices, x -> x is not null and x between 0 and 1)")
    rows = m.select("id", "question", F.size("names").alias("n"), "bestBid", "bestAsk", F.posexplode(F.arrays_zip("names", "prices")).alias("pos", "o"))
    first, two = F.col("pos") == 0, F.col("n") == 2
    return rows.select("id", "question", "pos", F.col("o.names").alias("outcome"), F.col("o.prices").alias("p"), F.when(first, F.col("bestBid")).when(two, 1 - F.col("bestAsk")).alias("bid"), F.when(first, F.col("bestAsk")).when(two, 1 - F.col("bestBid")).alias("ask"))


def feed_items(raw: DataFrame) -> DataFrame:
    """raw(feed, xml) of RSS items or Atom entries: title, link and date must be there; markup is removed, summaries hold 1200 characters."""
    blocks = raw.select("feed", F.explode(F.expr(r"regexp_extract_all(xml, '(?s)<(?:item|entry)[ >].*?</(?:item|entry)>', 0)")).alias("x"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{t}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", 1), "<[^>]*>", " "), r"\s+", " "))
    first = lambda *tags: F.coalesce(*(F.nullif(tag(t), F.lit("")) for t in tags))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("x", '<link[^>]*href="([^"]+)"', 1), F.lit("")))
    return blocks.select("feed", first("title").alias("title"), link.alias("url"), first("pubDate", "published", "updated").alias("date"), F.substring(first("description", "summary"), 1, 1200).alias("summary")).where("title is not null and url is not null and date is not null")


def odds_rows(raw: DataFrame) -> DataFrame:
    """raw(payload JSON): bookmakers and their head-to-head and totals markets, flattened; an update's time falls back along the levels."""
    schema = "id string, home_team string, away_team string, commence_time string, bookmakers array<struct<key:string,last_update:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
    g = raw.select(F.from_json("payload", schema).alias("g")).select("g.*")
    b = g.select("id", "home_team", "away_team", "commence_time", F.explode_outer("bookmakers").alias("b"))
    m = b.select("id", "home_team", "away_team", "commence_time", F.col("b.key").alias("bookmaker"), F.col("b.last_update").alias("u"), F.explode_outer("b.markets").alias("m"))
    rows = m.select("id", "home_team", "away_team", "bookmaker", F.col("m.key").alias("market"), F.coalesce("m.last_update", "u", "commence_time").alias("updated"), F.explode_outer("m.outcomes").alias("o"))
    return rows.where("market in ('h2h', 'totals')").select("id", "home_team", "away_team", "bookmaker", "market", "updated", F.col("o.name").alias("outcome"), F.col("o.price").alias("odds"), F.col("o.point").alias("point"))


def game_status(name: Column, state: Column, completed: Column) -> Column:
    """The engine's status of a feed's; by state where the name is new, scheduled where nothing is known."""
    known = F.create_map(*(F.lit(x) for kv in GAME_STATUS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, name), F.when(completed, "finished").when(state == "in", "live").when(state == "post", "finished").otherwise("scheduled"))


def with_fallback(sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Rows of the first source, in the order given, that has a key; provider tells which."""
    out = None
    for rank, (name, rows) in enumerate(sources):
        own = rows.withColumn("provider", F.lit(name)).withColumn("__p", F.lit(rank))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    first = F.expr(f"min(__p) over (partition by {', '.join(keys)})")
    return out.withColumn("__f", first).where("__p = __f").drop("__p", "__f")
