"""Registered streams over the tables, cut into micro-batches in time order; their oracles are the batch forms, less what is still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.dialect import DUCK, SPARK, Spark
from oddsmith.operators import clusters
from oddsmith.plans import relations
from oddsmith.plans import text as texts
from oddsmith.plans.custom import _rounded, _scratch, _stored, _stream, games
from oddsmith.plans.fixtures import ADAPTIVE, _sql, elo_replay
from oddsmith.streaming import candles, ordered, settlement

BATCHES = 4


def stream_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of every league, game by game, as batches arrive; equal to the replay of all games at once."""
    rows = games(spark, sf_dir).select("league", "game_id", F.timestamp_millis("kickoff").alias("at"), "home", "away", "hs", "aws")
    path = _scratch(spark, "ratings")
    stream = ordered.replayed(rows, f"{path}-in", BATCHES, "league")
    return _rounded(candles.run_to_table(ordered.ordered_fold(stream, "league", ordered.LeagueRatings(), "0 seconds"), path), 4)


def stream_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story clusters as articles arrive, vectors by the stored document frequencies; equal to the clusters of all articles at once."""
    rows = _sql(spark, sf_dir, f"WITH {relations.articles(SPARK)} SELECT id, published, {texts.tokens(SPARK, 'title')} AS tokens FROM articles")
    vectors = clusters.vectors(rows).select(F.lit(0).alias("topic"), "id", "published", F.timestamp_millis(F.col("published") + 1).alias("at"), F.col("words.w").alias("w"), F.col("words.x").alias("x"))
    path = _scratch(spark, "stories")
    stream = ordered.replayed(vectors, f"{path}-in", BATCHES, "topic")
    fold = ordered.StoryClusters(clusters.STORY_HOURS * 3_600_000, clusters.LEAST_SIMILARITY)
    return candles.run_to_table(ordered.ordered_fold(stream, "topic", fold, "0 seconds"), path).select("id", "cluster")


def stream_sliding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candles.run_to_table(candles.sliding_stats(_stream(spark, sf_dir)), _scratch(spark, "sliding"))
    return out.select("event_type", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), F.round("volume", 4).alias("volume"), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candles.run_to_table(candles.sessions(_stream(spark, sf_dir)), _scratch(spark, "sessions"))
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def _predicted(d: Spark) -> str:
    """Three-way predictions of games: some before and some after kick-off, some of unknown games, some of other things."""
    return f"""{relations.games(d)}, raw AS (SELECT game_id AS id, CASE game_id % 13 WHEN 0 THEN concat('market:', CAST(game_id AS VARCHAR(20))) WHEN 1 THEN concat('game:', CAST(league AS VARCHAR(5)), ':x', CAST(game_id AS VARCHAR(20))) ELSE concat('game:', CAST(league AS VARCHAR(5)), ':', CAST(game_id AS VARCHAR(20))) END AS subject,
  kickoff + (game_id % 5 - 3) * 86400000 AS generated_at, 1e0 + game_id % 3 AS h, 1e0 + home % 2 AS d, 1e0 + away % 4 AS a FROM games),
predicted AS (SELECT id, subject, generated_at, h / (h + d + a) AS home_p, d / (h + d + a) AS draw_p, a / (h + d + a) AS away_p FROM raw)"""


def stream_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"WITH {_predicted(SPARK)} SELECT * FROM predicted").withColumn("at", F.timestamp_millis("generated_at"))
    path = _scratch(spark, "settlement")
    results = _stored(games(spark, sf_dir).select("game_id", "kickoff", "hs", "aws"), "results")
    settlement.settlement(ordered.replayed(rows, f"{path}-in", BATCHES, split=True), results, path)
    return _rounded(settlement.decisions(spark, path))


def _composed(d: Spark) -> str:
    """Compositions of three years: each customer's last order of the year with a direction and a confidence."""
    return f"""composed AS (SELECT o_custkey AS subject, {d.date_text("o_orderdate", "yyyy")} AS year, max_by(CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END, o_orderkey) AS direction, max(o_orderkey % 100) / 100e0 AS confidence FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2)"""


def stream_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from each year's composition to the next."""
    rows = _sql(spark, sf_dir, f"WITH {_composed(SPARK)} SELECT * FROM composed")
    path, years = _scratch(spark, "snapshots"), ("1995", "1996", "1997")
    for i, year in enumerate(years):
        rows.where(F.col("year") == year).select("subject", "direction", "confidence").coalesce(1).write.parquet(f"{path}-in/part={i}")
    stream = spark.readStream.schema("subject long, direction string, confidence double").option("maxFilesPerTrigger", 1).parquet(f"{path}-in/part=*")
    return settlement.snapshots(stream, path)


REGISTERED = (stream_ratings, stream_stories, stream_sliding_stats, stream_sessions, stream_settlement, stream_snapshot_changes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    d = DUCK
    closed = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
    return {
        "stream_ratings": f"""WITH RECURSIVE {elo_replay(d, ADAPTIVE, "65e0")}
SELECT league, game_id, home AS team, round(a, 4) AS "before", round(a + step, 4) AS "after" FROM rec WHERE k > 0 UNION ALL SELECT league, game_id, away, round(b, 4), round(b - step, 4) FROM rec WHERE k > 0""",
        "stream_candles": f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS t, value, ts FROM events)
SELECT event_type AS asset, strftime(t, '%Y-%m-%d %H:%M:%S') AS open_time, round(arg_min(value, ts), 6) AS o, round(max(value), 6) AS h, round(min(value), 6) AS l, round(arg_max(value, ts), 6) AS c, round(sum(value), 4) AS v, count(*) AS n FROM w WHERE t + INTERVAL 1 HOUR <= {closed} GROUP BY event_type, t""",
        "stream_sliding_stats": f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) + to_hours(CAST(k AS INT)) AS e, value FROM events, range(1, 25) AS r(k))
SELECT event_type, strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end, round(sum(value), 4) AS volume, round(max(value), 6) AS high, round(min(value), 6) AS low FROM w WHERE e <= {closed} GROUP BY event_type, e""",
        "stream_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 1 HOUR) // 1000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 1 HOUR <= {closed}""",
        "stream_throttled": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
pass AS (SELECT user_id, event_id, k, t AS last, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - p.last >= 1800 THEN e.t ELSE p.last END, e.t - p.last >= 1800 FROM pass p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT user_id, event_id FROM pass WHERE kept""",
        "stream_settlement": f"""WITH {_predicted(d)}, x AS (SELECT p.*, g.kickoff, CASE WHEN p.subject LIKE 'game:%' THEN CASE WHEN g.hs > g.aws THEN 'home' WHEN g.hs = g.aws THEN 'draw' WHEN g.hs < g.aws THEN 'away' END END AS won FROM predicted p LEFT JOIN games g ON concat('game:', g.league, ':', g.game_id) = p.subject),
y AS (SELECT *, CASE WHEN subject NOT LIKE 'game:%' THEN 'foreign' WHEN won IS NULL THEN 'pending' WHEN generated_at > kickoff THEN 'skipped' ELSE 'settled' END AS status FROM x)
SELECT id, status, CASE WHEN status = 'settled' THEN won END AS outcome, CASE WHEN status = 'settled' THEN round(power(home_p - (won = 'home')::INT, 2) + power(draw_p - (won = 'draw')::INT, 2) + power(away_p - (won = 'away')::INT, 2), 6) END AS brier,
  CASE WHEN status = 'settled' THEN round(-ln(CASE won WHEN 'home' THEN home_p WHEN 'draw' THEN draw_p ELSE away_p END), 6) END AS log_loss FROM y""",
        "stream_snapshot_changes": f"""WITH {_composed(d)}, c AS (SELECT *, CAST(year AS BIGINT) - 1995 AS batch FROM composed), n(batch) AS (VALUES (1), (2)),
s AS (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.batch, b.batch + 1) AS batch, a.direction AS ad, a.confidence AS ac, b.direction AS bd, b.confidence AS bc FROM c a FULL OUTER JOIN c b ON b.subject = a.subject AND b.batch = a.batch - 1),
k AS (SELECT *, unnest(list_filter([CASE WHEN bd IS NULL THEN 'new' END, CASE WHEN ad IS NULL THEN 'removed' END, CASE WHEN ad <> bd THEN 'flip' END, CASE WHEN abs(ac - bc) > 0.1 THEN 'swing' END], lambda x: x IS NOT NULL)) AS kind FROM s WHERE batch IN (1, 2))
SELECT CAST(batch AS BIGINT) AS batch, subject, kind, CASE WHEN bd IS NOT NULL THEN bd || printf(' %.2f', bc) END AS old, CASE WHEN ad IS NOT NULL THEN ad || printf(' %.2f', ac) END AS new FROM k""",
    }
