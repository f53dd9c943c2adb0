import random

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import ratings
from oddsmith.plans import catalog, streams
from oddsmith.streaming import candles, ordered, settlement

SF = "/root/testdata/sf0.001"
GAME = "league int, game_id long, kickoff long, home int, away int, hs long, aws long"
DAY = 86_400_000


def season(n=60):
    random.seed(2)
    return [(i % 2, i, DAY * (1 + i // 3), i % 5, 5 + i % 4, random.randint(0, 4), random.randint(0, 3)) for i in range(n)]


def test_stories_equal_the_batch_clusters(spark):
    want = {(r.id, r.cluster) for r in catalog.queries()["text_story_clusters"](spark, SF).collect()}
    assert {(r.id, r.cluster) for r in catalog.queries()["stream_stories"](spark, SF).collect()} == want


def test_ratings_across_a_restart_and_with_late_games(spark, tmp_path):
    games = spark.createDataFrame(season(), GAME)
    rows = games.select("league", "game_id", F.timestamp_millis("kickoff").alias("at"), "home", "away", "hs", "aws")
    stream = ordered.replayed(rows, f"{tmp_path}/in", 1, "league")
    late = rows.where("game_id BETWEEN 20 AND 30")  # these come one batch after later games
    for i, part in enumerate((rows.where("game_id < 20 OR game_id BETWEEN 31 AND 40"), late, rows.where("game_id > 40"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/cut/part={i}")
    spark.read.parquet(f"{tmp_path}/in/part=1").coalesce(1).write.parquet(f"{tmp_path}/end/part=3")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/cut/part=*")
    fold = lambda s: ordered.ordered_fold(s, "league", ordered.LeagueRatings(), "10 days")
    first = candles.run_to_table(fold(source), f"{tmp_path}/out").count()
    spark.read.parquet(f"{tmp_path}/end/part=3").write.parquet(f"{tmp_path}/cut/part=3")
    again = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/cut/part=*")
    got = candles.run_to_table(fold(again), f"{tmp_path}/out")  # from the checkpoint of the first run
    want = {(r.league, r.game_id, r.team): round(r.after, 6) for r in ratings.elo_history(games).collect()}
    assert first < got.count() == len(want) and {(r.league, r.game_id, r.team): round(r.after, 6) for r in got.collect()} == want
    assert stream.isStreaming


def test_settlement_replays(spark, tmp_path):
    path = str(tmp_path / "settled")
    predicted = [(1, "game:0:1", 5, 0.5, 0.3, 0.2), (2, "game:0:2", 50, 0.5, 0.3, 0.2), (3, "game:0:9", 5, 0.2, 0.3, 0.5), (4, "market:x", 5, 0.2, 0.3, 0.5), (5, "game:0:", 5, 0.2, 0.3, 0.5)]
    batch = spark.createDataFrame(predicted, "id long, subject string, generated_at long, home_p double, draw_p double, away_p double")
    results = spark.createDataFrame([(1, 10, 2, 0), (2, 10, 0, 0), (9, 10, None, None)], "game_id long, kickoff long, hs long, aws long")
    for _ in range(2):  # a batch that is replayed replaces itself
        settlement.settle_batch(batch, 0, results, path)
    status = lambda: {r.id: (r.status, r.outcome) for r in settlement.decisions(spark, path).collect()}
    assert status() == {1: ("settled", "home"), 2: ("skipped", None), 3: ("pending", None), 4: ("foreign", None), 5: ("foreign", None)}
    played = results.where("game_id < 9").union(spark.createDataFrame([(9, 10, 1, 3)], results.schema))
    for _ in range(2):
        settlement.settle_batch(batch.limit(1), 1, played, path)
    assert status()[3] == ("settled", "away") and len(status()) == 5
    assert [(r.n, r.ids) for r in spark.read.parquet(path).groupBy().agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()] == [(6, 5)]


def test_snapshot_changes_replay(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "subject long, direction string, confidence double")
    path, one, two = str(tmp_path / "s"), frame([(1, "up", 0.5), (2, "up", 0.5), (3, "up", 0.5)]), frame([(1, "down", 0.9), (2, "up", 0.55), (4, "up", 0.1)])
    for number, batch in ((0, one), (1, two), (1, two)):
        settlement.snapshot_batch(batch, number, path)
    found = sorted((r.subject, r.kind) for r in spark.read.parquet(f"{path}/changes").collect())
    assert found == [(1, "flip"), (1, "swing"), (3, "removed"), (4, "new")]


@pytest.mark.parametrize("name", ["stream_sliding_stats", "stream_sessions"])
def test_open_windows_are_left_out(spark, name):
    rows = catalog.queries()[name](spark, SF)
    last = spark.read.parquet(f"{SF}/events.parquet").agg(F.max("ts")).first()[0]
    end = rows.agg(F.max("window_end" if "sliding" in name else F.timestamp_millis("end_ms").cast("string"))).first()[0]
    assert end < str(last)




def test_throttle_orders_a_user_across_frames(spark, tmp_path):
    random.seed(3)
    times = random.sample(range(100_000), 120)
    rows = [(i % 3, i, float(1_700_000_000 + t)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = set()
    for user in range(3):
        last = None
        for event, t in sorted(((e, t) for u, e, t in rows if u == user), key=lambda r: r[1]):
            if last is None or t - last >= 1800:
                want.add(event)
                last = t
    source = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(f"{tmp_path}/in")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = candles.run_to_table(candles.throttled(source), f"{tmp_path}/out").collect()
    finally:
        spark.conf.set(size, before)
    assert len(got) == len(want) and {r.event_id for r in got} == want


def test_a_replay_reads_its_rows_once_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BATCH_ROWS", 10)
    games = spark.createDataFrame(season(), GAME)
    rows = games.select("league", "game_id", F.timestamp_millis("kickoff").alias("at"), "home", "away", "hs", "aws")
    ordered.replayed(rows, f"{tmp_path}/in", 2, "league")
    sizes = [spark.read.parquet(f"{tmp_path}/in/part={i}").count() for i in range(6)]
    assert sum(sizes) == 60 and max(sizes) <= 15 and spark.read.parquet(f"{tmp_path}/in/part=6").count() == 2
    last = [spark.read.parquet(f"{tmp_path}/in/part={i}").agg(F.min("at"), F.max("at")).first() for i in range(6)]
    assert all(a[1] < b[0] for a, b in zip(last, last[1:]))


def test_stories_let_go_within_a_batch():
    from oddsmith.operators.clusters import Stories

    stories = Stories(1000, 0.45)
    for i in range(500):
        stories.place(i, 100 * i, {f"w{i}": 1.0, "common": 0.1})
    assert len(stories.open) < 20 and set(stories.norms) == set(stories.open) == set(stories.holders["common"])


def test_settlement_takes_few_batches_of_many_files(spark, tmp_path, monkeypatch):
    """However many rows, results meet four batches; rows are not lost between files, and results are derived once."""
    want = {tuple(r) for r in catalog.queries()["stream_settlement"](spark, SF).collect()}
    monkeypatch.setattr(ordered, "BATCH_ROWS", 100)
    monkeypatch.setattr(streams, "_scratch", lambda spark, label: str(tmp_path / label))
    got = catalog.queries()["stream_settlement"](spark, SF)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000
    assert len(list((tmp_path / "settlement").glob("batch=*"))) == streams.BATCHES
