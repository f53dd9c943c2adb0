"""What titles say: price thresholds, categories, and whether two team names are one club."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the assets whose thresholds are read, as whole words.
ASSETS = {
    "BTC": "btc|xbt|bitcoin",
    "ETH": "eth|ethereum|ether",
    "SOL": "sol|solana",
    "XRP": "xrp|ripple",
    "BNB": "bnb",
    "DOGE": "doge|dogecoin",
}
#: Words of either direction, and how a strike is written.
ABOVE = "exceed(?:s|ed)?|above|over|surpass(?:es|ed)?|reach(?:es|ed)?|hit(?:s)?|close[sd]? above"
BELOW = "below|under|beneath|(?:drop|fall|dip)s? (?:below|under)|close[sd]? below|less than"
NUMBER = r"(?i)(?:[$])?\s?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?)\s*(?:[km])?"
DEADLINE = r"(?i)\b(?:by|on|before)\s+([^?.!,;]+)"
SCALES = {"k": 1e3, "m": 1e6}
#: Fixed value: digits from which an undecorated number is a strike and no date.
BARE_DIGITS = 5
#: Keywords of market categories in order; the first category with a match counts.
CATEGORIES = {
    "crypto": "bitcoin|btc|ethereum|eth|solana|sol|xrp|dogecoin|crypto|stablecoin|defi",
    "sports": "nba|nfl|mlb|nhl|ufc|f1|tennis|golf|premier league|champions league|la liga|serie a|bundesliga|world cup|super bowl|olympics|counter-strike|esports|grand slam|wnba",
    "politics": "election|president|presidential|senate|congress|governor|mayor|primary|parliament|prime minister|nominee|nomination|impeach|cabinet|supreme court|legislation|ceasefire|nato",
    "economics": "fed|fomc|rate cut|rate hike|interest rate|inflation|cpi|gdp|recession|unemployment|jobs report|tariff|treasury|s&p 500|nasdaq",
    "companies": "ipo|acquisition|merger|acquire|ceo|market cap|earnings|bankruptcy",
    "entertainment": "oscar|oscars|grammy|emmy|box office|album|movie|film|song|billboard|netflix|rotten tomatoes",
    "weather": "hurricane|temperature|heatwave|snow|rainfall|storm|tornado|earthquake|wildfire",
    "science": "spacex|nasa|rocket launch|vaccine|fda|ai model|openai|gpt|nobel",
}
#: Fixed value: how daily fixtures are worded; they are sports.
FIXTURE = r"win on [0-9]{4}-[0-9]{2}-[0-9]{2}"
#: Words that name no club, the share of the shorter name's words that must match, hours between kick-offs.
NOISE = ("fc", "cf", "afc", "sc", "ac", "club", "de", "the")
LEAST_SHARE, KICKOFF_HOURS = 0.6, 3


def _says(text: Column, words: str) -> Column:
    return text.rlike(rf"(?i)\b(?:{words})\b")


def category(title: Column) -> Column:
    """The category of a title, other without a keyword; null stays null."""
    found = F.when(title.isNull(), F.lit(None).cast("string"))
    for name, words in CATEGORIES.items():
        found = found.when(_says(title, words if name != "sports" else f"{words}|{FIXTURE}"), name)
    return found.otherwise("other")


def _strikes(title: Column) -> Column:
    """Distinct strikes: with a dollar sign, a k or m, grouped digits, or five digits and more."""
    found = F.regexp_extract_all(title, F.lit(NUMBER), F.lit(0))

    def parsed(x: Column) -> Column:
        digits = F.regexp_replace(x, "[^0-9.]", "")
        suffix = F.lower(F.substring(F.trim(x), -1, 1))
        scale = F.when(suffix == "k", SCALES["k"]).when(suffix == "m", SCALES["m"])
        sure = x.contains("$") | scale.isNotNull() | x.contains(",") | digits.rlike(f"^[0-9]{{{BARE_DIGITS},}}$")
        return F.when(sure, digits.cast("double") * F.coalesce(scale, F.lit(1.0)))

    return F.array_distinct(F.filter(F.transform(found, parsed), lambda v: v > 0))


def _deadline(text: Column) -> Column:
    """The words after the last by, on or before; null without any."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def thresholds(markets: DataFrame) -> DataFrame:
    """(id, symbol, direction, strike, deadline) of markets(id, title, description) that ask for one price of one known asset.

    Titles that name no asset or two, both directions or none, or another number of strikes than one are left out. Only the
    deadline may come from the description.
    """
    named = F.filter(F.array(*(F.when(_says(F.col("title"), words), F.lit(symbol)) for symbol, words in ASSETS.items())), lambda x: x.isNotNull())
    above, below = _says(F.col("title"), ABOVE), _says(F.col("title"), BELOW)
    rows = markets.select("id", "title", "description", named.alias("named"), above.alias("above"), below.alias("below"), _strikes(F.col("title")).alias("strikes"))
    rows = rows.where((F.size("named") == 1) & (F.col("above") != F.col("below")) & (F.size("strikes") == 1))
    return rows.select(
        "id", F.element_at("named", 1).alias("symbol"), F.when(F.col("above"), "above").otherwise("below").alias("direction"), F.element_at("strikes", 1).alias("strike"),
        F.coalesce(_deadline(F.col("title")), _deadline(F.col("description"))).alias("deadline"),
    )


def club_words(name: Column, plain: Column | None = None) -> Column:
    """The words of a club's name in lower case, without accents and words that name no club; plain is the name without accents."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name if plain is None else plain), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: ~w.isin(*NOISE) & (w != ""))


def same_club(a: Column, b: Column) -> Column:
    """Whether at least LEAST_SHARE of the shorter name's words begin, or are begun by, a word of the other."""
    alike = lambda x, y: x.startswith(y) | y.startswith(x)
    share = lambda s, t: F.size(F.filter(s, lambda x: F.exists(t, lambda y: alike(x, y)))) / F.size(s)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(F.when(both, F.when(F.size(a) <= F.size(b), share(a, b)).otherwise(share(b, a)) >= LEAST_SHARE), F.lit(False))


def _indexed(rows: DataFrame, words: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows by each whole word, and by each word's beginnings, itself included."""
    spread = rows.select(*keep, F.explode(F.array_distinct(words)).alias("word"))
    begun = spread.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("word"))
    return spread, begun.distinct()


def club_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(l, r): rows of left(l, words, *on) and right(r, words, *on), equal in `on`, that name one club.

    A word matches another that it begins with or that begins with it, so candidates meet where one's whole word is a
    beginning of the other's: an index of beginnings on both sides, joined by equality. The share is then verified.
    """
    (lw, lb), (rw, rb) = _indexed(left, "words", ["l", *on]), _indexed(right, "words", ["r", *on])
    met = lw.join(rb, [*on, "word"]).select("l", "r").union(lb.join(rw, [*on, "word"]).select("l", "r")).distinct()
    sides = met.join(left.select("l", F.col("words").alias("lw")).distinct(), "l").join(right.select("r", F.col("words").alias("rw")).distinct(), "r")
    return sides.where(same_club(F.col("lw"), F.col("rw"))).select("l", "r")


def game_odds_matches(games: DataFrame, events: DataFrame) -> DataFrame:
    """(game, event) of games(game, kickoff, home, away) and events(event, kickoff, home, away) with words for names.

    Both names must match and the kick-offs lie within KICKOFF_HOURS; games with more than one such event have none. Which
    spellings name one club is found once for each pair of spellings. Events are then counted by game's names and kick-off,
    in the buckets of that width around their own, and a game takes the sum over its window: no pair of a game and an
    event is formed, however many share a kick-off.
    """
    width = KICKOFF_HOURS * 3_600_000
    bucket = F.floor(F.col("kickoff") / width)
    spelled = lambda rows, key: rows.select(F.explode(F.array("home", "away")).alias(key)).distinct().withColumn("words", F.col(key))
    alike = club_pairs(spelled(games, "l"), spelled(events, "r"), [])
    told = events.groupBy("home", "away", "kickoff").agg(F.count(F.lit(1)).alias("n"), F.min("event").alias("event"))
    for side in ("home", "away"):
        told = told.join(alike.select(F.col("l").alias(f"own_{side}"), F.col("r").alias(side)), side)
    told = told.groupBy(F.col("own_home").alias("home"), F.col("own_away").alias("away"), "kickoff").agg(F.sum("n").alias("n"), F.min("event").alias("event"))
    near = told.select("*", F.explode(F.array(*(bucket + i for i in (-1, 0, 1)))).alias("bucket"), F.lit(False).alias("asks"))
    rows = games.select("game", "home", "away", "kickoff", bucket.alias("bucket"), F.lit(True).alias("asks")).unionByName(near, allowMissingColumns=True)
    around = Window.partitionBy("home", "away", "bucket").orderBy("kickoff").rangeBetween(-width, width)
    met = rows.select("game", "asks", F.sum("n").over(around).alias("n"), F.min("event").over(around).alias("event")).where("asks and n > 0")
    return met.groupBy("game").agg(F.sum("n").alias("n"), F.min("event").alias("event")).where("n = 1").select("game", "event")
