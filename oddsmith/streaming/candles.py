"""Streaming forms: windowed candles with a watermark, deduplication, throttling per key, and exactly-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.operators.store import append_new


def tumbling_candles(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Candles per event type; a bar is closed, and late rows dropped, once the watermark has passed its end."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    bars = rows.groupBy(F.window("at", width), "event_type").agg(
        F.min_by("value", "at").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "at").alias("c"), F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    return bars.select(F.col("event_type").alias("asset"), F.col("window.start").alias("open_time"), "o", "h", "l", "c", "v", "n")


def sliding_stats(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", width, slide), "event_type").agg(F.sum("value").alias("volume"), F.max("value").alias("high"), F.min("value").alias("low")).select(F.col("window.end").alias("window_end"), "event_type", "volume", "high", "low")


def sessions(events: DataFrame, gap: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(keys)


def throttled(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Per user at most one row per gap_s after the last one let through; the state is that row's time.

    A user's rows of a micro-batch may come in several frames, in any order, so they are put in order before the first
    passes. Of the rows of one second only the first can pass: no more than that is held.
    """

    def each(key, frames, state):
        import pandas as pd

        last, pdf = state.get[0] if state.exists else None, None
        for frame in frames:
            pdf = (frame if pdf is None else pd.concat([pdf, frame])).sort_values(["ts", "event_id"])
            seconds = pdf["ts"].astype("int64") // 1_000_000_000
            if gap_s > 0:
                pdf, seconds = pdf[~seconds.duplicated()], seconds.drop_duplicates()
        if pdf is None:
            return
        kept = []
        for t in seconds:
            kept.append(last is None or t - last >= gap_s)
            last = int(t) if kept[-1] else last
        yield pdf[kept][["user_id", "event_id", "ts"]].rename(columns={"ts": "at"})
        if last is not None:
            state.update((last,))

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(each, "user_id bigint, event_id bigint, at timestamp", "last bigint", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what is available, then stop; keys make the sink idempotent per row, for replayed batches."""
    spark: SparkSession = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-progress")
    if keys:
        query = writer.foreachBatch(lambda batch, _: append_new(batch, path, keys)).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
