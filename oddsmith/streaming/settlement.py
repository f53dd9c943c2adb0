"""Settlement and snapshot differences per micro-batch, committed once: a replayed batch replaces its own folder by the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.operators.store import existing

#: How a game's predictions name it, the swing of confidence that is told, the floor of a logarithm.
GAME_SUBJECT, SWING, LEAST_P = r"^game:(.+):([^:]+)$", 0.1, 1e-9


def game_of(subject: Column) -> tuple[Column, Column]:
    """(league, game) of a subject game:league:game; empty for any other subject."""
    return F.regexp_extract(subject, GAME_SUBJECT, 1), F.regexp_extract(subject, GAME_SUBJECT, 2)


def judged(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """(id, subject, generated_at, home_p, draw_p, away_p, status, outcome, brier, log_loss) of predictions against results(game_id, kickoff, hs, aws).

    Subjects that name no game are foreign; a game that is not known or has no score leaves its prediction pending; one
    made after the kick-off is skipped; the others are settled.
    """
    league, game = game_of(F.col("subject"))
    known = results.select(F.col("game_id").cast("string").alias("game"), "kickoff", "hs", "aws")
    rows = predictions.withColumns({"league": league, "game": game}).join(known, "game", "left")
    outcome = F.when(F.col("hs") > F.col("aws"), "home").when(F.col("hs") == F.col("aws"), "draw").when(F.col("hs") < F.col("aws"), "away")
    status = F.when(F.col("game") == "", "foreign").when(outcome.isNull(), "pending").when(F.col("generated_at") > F.col("kickoff"), "skipped").otherwise("settled")
    rows = rows.withColumns({"status": status, "outcome": F.when(status == "settled", outcome)})
    shares = {"home": "home_p", "draw": "draw_p", "away": "away_p"}
    brier = sum((F.pow(F.col(c) - F.when(F.col("outcome") == k, 1.0).otherwise(0.0), F.lit(2.0)) for k, c in shares.items()), F.lit(0.0))
    own = F.coalesce(*(F.when(F.col("outcome") == k, F.col(c)) for k, c in shares.items()))
    settled = F.col("status") == "settled"
    return rows.select(
        "id", "subject", "generated_at", *shares.values(), "status", "outcome", F.when(settled, brier).alias("brier"), F.when(settled, -F.log(F.greatest(own, F.lit(LEAST_P)))).alias("log_loss")
    )


def _before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    return existing(spark, path, spark.createDataFrame([], f"{schema}, batch long").schema).where(F.col("batch") < batch)


_JUDGED = "id long, subject string, generated_at long, home_p double, draw_p double, away_p double, status string, outcome string, brier double, log_loss double"


def settle_batch(batch: DataFrame, number: int, results: DataFrame, path: str) -> None:
    """Judges a batch's predictions and those still pending from earlier batches; what an earlier batch decided stays as it is.

    A batch stores all that are pending after it, so only the batch before is searched for those; of the others only ids are read.
    """
    decided = _before(batch.sparkSession, path, number, _JUDGED)
    last = decided.agg(F.max("batch")).first()[0]
    waiting = decided.where((F.col("batch") == F.lit(last)) & (F.col("status") == "pending")).select("id", "subject", "generated_at", "home_p", "draw_p", "away_p")
    fresh = batch.select("id", "subject", "generated_at", "home_p", "draw_p", "away_p").dropDuplicates(["id"])
    if last is not None:
        fresh = fresh.join(decided.select("id"), "id", "left_anti")
    judged(fresh.unionByName(waiting), results).write.mode("overwrite").parquet(f"{path}/batch={number}")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision on each prediction."""
    rows = spark.read.parquet(path)
    return rows.groupBy("id").agg(F.max_by(F.struct("status", "outcome", "brier", "log_loss"), "batch").alias("r")).select("id", "r.*")


def settlement(predictions: DataFrame, results: DataFrame, path: str) -> None:
    """Runs a stream of predictions against results, as far as there is input; each micro-batch is one commit."""
    writer = predictions.writeStream.foreachBatch(lambda batch, number: settle_batch(batch, number, results, path))
    writer.trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").start().awaitTermination()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, kind, old, new) between two snapshots(subject, direction, confidence): new, removed, flip and swing, of which a subject may have two."""
    b, a = before.select("subject", F.struct("direction", "confidence").alias("b")), after.select("subject", F.struct("direction", "confidence").alias("a"))
    both = b.join(a, "subject", "full")
    text = lambda c: F.concat_ws(" ", F.col(f"{c}.direction"), F.format_string("%.2f", F.col(f"{c}.confidence")))
    kinds = F.array(
        F.when(F.col("b").isNull(), "new"), F.when(F.col("a").isNull(), "removed"), F.when(F.col("a.direction") != F.col("b.direction"), "flip"),
        F.when(F.abs(F.col("a.confidence") - F.col("b.confidence")) > SWING, "swing"),
    )
    told = both.withColumn("kind", F.explode(F.array_compact(kinds)))
    return told.select("subject", "kind", F.when(F.col("b").isNotNull(), text("b")).alias("old"), F.when(F.col("a").isNotNull(), text("a")).alias("new"))


_SNAPSHOT = "subject long, direction string, confidence double"


def snapshot_batch(batch: DataFrame, number: int, path: str) -> None:
    """Stores a batch as the snapshot of its number and what changed since the one before; the first has nothing to differ from."""
    spark = batch.sparkSession
    stored = _before(spark, f"{path}/snapshots", number, _SNAPSHOT)
    last = stored.agg(F.max("batch")).first()[0]
    batch.select("subject", "direction", "confidence").write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")
    current = spark.read.schema(_SNAPSHOT).parquet(f"{path}/snapshots/batch={number}")
    if last is not None:
        changes(stored.where(F.col("batch") == last).drop("batch"), current).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")


def snapshots(stream: DataFrame, path: str) -> DataFrame:
    """(batch, subject, kind, old, new) of all micro-batches of a stream of compositions."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: snapshot_batch(batch, number, path))
    writer.trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").start().awaitTermination()
    empty = stream.sparkSession.createDataFrame([], "subject long, kind string, old string, new string, batch long")
    return existing(stream.sparkSession, f"{path}/changes", empty.schema).select("batch", "subject", "kind", "old", "new")
