"""Registered plans of rules on titles, names and alerts; their oracles say the same keyword by keyword, pair by pair, event by event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.dialect import DUCK, SPARK, Spark
from oddsmith.operators import store, titles
from oddsmith.plans import relations
from oddsmith.plans.fixtures import _sql

#: Names of clubs as books write them: what stands before and after a nation's name, and how much of it is left.
WRITTEN = (("", " FC", 25), ("The ", " Club", 5), ("AC ", "", 4), ("", " United", 25), ("Real ", " of the North", 3), ("", "", 1))


def market_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"WITH {relations.titles(SPARK)} SELECT id, title FROM titles").select("id", titles.category(F.col("title")).alias("category"))


def threshold_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.thresholds(_sql(spark, sf_dir, f"WITH {relations.titles(SPARK)} SELECT id, title, description FROM titles"))


def _written(d: Spark, name: str, key: str) -> str:
    pick = " ".join(f"WHEN {i} THEN concat('{before}', substr({name}, 1, {n}), '{after}')" for i, (before, after, n) in enumerate(WRITTEN))
    return f"CASE {key} % {len(WRITTEN)} {pick} END"


def _clubs(d: Spark) -> str:
    return f"clubs AS (SELECT c_custkey AS k, {_written(d, 'n_name', 'c_custkey')} AS name FROM customer JOIN nation ON n_nationkey = c_nationkey), books AS (SELECT s_suppkey AS k, {_written(d, 'initcap(n_name)' if d.name != 'duckdb' else 'n_name', 's_suppkey + 2')} AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def odds_team_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of clubs, by customers, against spellings in books, by suppliers; each spelling once."""
    clubs, books = (_sql(spark, sf_dir, f"WITH {_clubs(SPARK)} SELECT name, min(k) AS k FROM {t} GROUP BY name") for t in ("clubs", "books"))
    left = clubs.select(F.col("k").alias("l"), titles.club_words(F.col("name")).alias("words"))
    right = books.select(F.col("k").alias("r"), titles.club_words(F.col("name")).alias("words"))
    return titles.club_pairs(left, right, []).select(F.col("l").alias("left_k"), F.col("r").alias("right_k"))


def _odds_events(d: Spark) -> str:
    return f"""{relations.games(d)}, named AS (SELECT g.game_id, g.kickoff, h.n_name AS home, a.n_name AS away FROM games g JOIN nation h ON h.n_nationkey = g.home JOIN nation a ON a.n_nationkey = g.away),
listed AS (SELECT game_id AS event, kickoff + (game_id % 9 - 4) * 3600000 AS kickoff, {_written(d, "home", "game_id")} AS home, {_written(d, "away", "(game_id + 1)")} AS away FROM named WHERE game_id % 3 > 0)"""


def odds_game_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _sql(spark, sf_dir, f"WITH {_odds_events(SPARK)} SELECT game_id AS game, kickoff, home, away FROM named")
    events = _sql(spark, sf_dir, f"WITH {_odds_events(SPARK)} SELECT event, kickoff, home, away FROM listed")
    words = {c: titles.club_words(F.col(c)) for c in ("home", "away")}
    return titles.game_odds_matches(games.withColumns(words), events.withColumns(words))


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert fires again no sooner than an hour after it last fired."""
    rows = _sql(spark, sf_dir, f"SELECT user_id AS alert, event_id, {SPARK.epoch_ms('ts')} AS at FROM events WHERE value > 50e0")
    return store.throttled(rows, "alert", "at", 3_600_000).select("alert", "event_id")


REGISTERED = (market_category, threshold_parse, odds_team_match, odds_game_match, alert_cooldown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    d = DUCK
    keywords = ", ".join(f"({i}, '{name}', '{w}')" for i, (name, words) in enumerate(titles.CATEGORIES.items()) for w in words.split("|"))
    assets = ", ".join(f"('{symbol}', '{w}')" for symbol, words in titles.ASSETS.items() for w in words.split("|"))
    ways = ", ".join(f"('{way}', '{w}')" for way, words in (("above", "exceed|exceeds|exceeded|above|over|surpass|surpasses|surpassed|reach|reaches|reached|hit|hits"), ("below", "below|under|beneath|less than")) for w in words.split("|"))
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains(['fc', 'cf', 'afc', 'sc', 'ac', 'club', 'de', 'the'], w))"
    share = lambda s, t: f"len(list_filter({s}, lambda x: len(list_filter({t}, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) / len({s})"
    same = lambda a, b: f"len({a}) > 0 AND len({b}) > 0 AND CASE WHEN len({a}) <= len({b}) THEN {share(a, b)} ELSE {share(b, a)} END >= 0.6"
    return {
        "market_category": f"""WITH {relations.titles(d)}, k(rank, category, word) AS (VALUES {keywords}),
hits AS (SELECT id, arg_min(category, rank) AS category FROM titles JOIN k ON regexp_matches(lower(title), concat('\\b', word, '\\b')) GROUP BY id)
SELECT t.id, coalesce(h.category, 'other') AS category FROM titles t LEFT JOIN hits h USING (id)""",
        "threshold_parse": f"""WITH {relations.titles(d)}, s(symbol, word) AS (VALUES {assets}), w(way, word) AS (VALUES {ways}),
sym AS (SELECT id, min(symbol) AS symbol FROM titles JOIN s ON regexp_matches(lower(title), concat('\\b', word, '\\b')) GROUP BY id HAVING count(DISTINCT symbol) = 1),
dir AS (SELECT id, min(way) AS direction FROM titles JOIN w ON regexp_matches(lower(title), concat('\\b', word, '\\b')) GROUP BY id HAVING count(DISTINCT way) = 1),
raw AS (SELECT id, unnest(regexp_extract_all(lower(title), '\\$?\\s?([0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?|[0-9]+(\\.[0-9]+)?)\\s*[km]?')) AS m FROM titles),
num AS (SELECT id, m, replace(regexp_extract(m, '[0-9,.]+'), ',', '') AS digits FROM raw),
strike AS (SELECT id, min(v) AS strike FROM (SELECT id, digits::DOUBLE * CASE WHEN m LIKE '%k' THEN 1000 WHEN m LIKE '%m' THEN 1000000 ELSE 1 END AS v FROM num WHERE m LIKE '%$%' OR m LIKE '%,%' OR m LIKE '%k' OR m LIKE '%m' OR regexp_full_match(digits, '[0-9]{{5,}}')) WHERE v > 0 GROUP BY id HAVING count(DISTINCT v) = 1),
due AS (SELECT id, list_filter(list_transform(regexp_extract_all(title, '(?i)\\b(?:by|on|before)\\s+([^?.!,;]+)', 1), lambda x: trim(x)), lambda x: x <> '') AS own, list_filter(list_transform(regexp_extract_all(coalesce(description, ''), '(?i)\\b(?:by|on|before)\\s+([^?.!,;]+)', 1), lambda x: trim(x)), lambda x: x <> '') AS told FROM titles)
SELECT sym.id, symbol, direction, strike, coalesce(own[-1], told[-1]) AS deadline FROM sym JOIN dir USING (id) JOIN strike USING (id) JOIN due USING (id)""",
        "odds_team_match": f"""WITH {_clubs(d)}, a AS (SELECT min(k) AS k, {words("name")} AS t FROM clubs GROUP BY name), b AS (SELECT min(k) AS k, {words("name")} AS t FROM books GROUP BY name)
SELECT a.k AS left_k, b.k AS right_k FROM a JOIN b ON {same("a.t", "b.t")}""",
        "odds_game_match": f"""WITH {_odds_events(d)}, g AS (SELECT game_id, kickoff, {words("home")} AS h, {words("away")} AS a FROM named), e AS (SELECT event, kickoff, {words("home")} AS h, {words("away")} AS a FROM listed)
SELECT g.game_id AS game, min(e.event) AS event FROM g JOIN e ON e.kickoff BETWEEN g.kickoff - 10800000 AND g.kickoff + 10800000 WHERE {same("g.h", "e.h")} AND {same("g.a", "e.a")} GROUP BY g.game_id HAVING count(*) = 1""",
        "alert_cooldown": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {d.epoch_ms("ts")} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value > 50e0),
pass AS (SELECT user_id, event_id, t AS last, k, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.t - p.last >= 3600000 THEN e.t ELSE p.last END, e.k, e.t - p.last >= 3600000 FROM pass p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT user_id AS alert, event_id FROM pass WHERE kept""",
    }
