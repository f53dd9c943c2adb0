"""Deterministic demonstration data of any size, made by executors from row numbers and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def noise(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1), the same for the same keys and seed in any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def candles(spark: SparkSession, assets: int = 5, length: int = 300, seed: int = 7, width_ms: int = 3_600_000) -> DataFrame:
    """Geometric walks: (asset, open_time, o, h, l, c, v)."""
    n = spark.range(assets * length).select(F.concat(F.lit("asset"), (F.col("id") / length).cast("int")).alias("asset"), (F.col("id") % length).alias("i"))
    step = n.withColumn("step", (noise(seed, F.col("asset"), F.col("i")) - 0.5) * 0.04)
    by = Window.partitionBy("asset").orderBy("i")
    walk = step.withColumn("c", 100 * F.exp(F.sum("step").over(by))).withColumn("o", F.coalesce(F.lag("c").over(by), F.lit(100.0)))
    wick = 1 + noise(seed + 1, F.col("asset"), F.col("i")) * 0.01
    return walk.select("asset", (F.col("i") * width_ms).alias("open_time"), "o", (F.greatest("o", "c") * wick).alias("h"), (F.least("o", "c") / wick).alias("l"), "c", (1000 * noise(seed + 2, F.col("asset"), F.col("i"))).alias("v"))


def season(spark: SparkSession, teams: int = 8, seed: int = 7, day_ms: int = 86_400_000) -> DataFrame:
    """A double round robin by the circle method: (game_id, round, kickoff, home, away, hs, aws); every pair meets twice, once at each place."""
    if teams % 2:
        raise ValueError("an even number of teams")
    half, rounds = teams // 2, teams - 1
    n = spark.range(2 * rounds * half).select(F.col("id").alias("game_id"), (F.col("id") / half).cast("int").alias("round"), (F.col("id") % half).cast("int").alias("slot"))
    turn = F.col("round") % rounds
    place = lambda p: F.when(p == 0, F.lit(teams - 1)).otherwise((p - 1 + turn) % rounds)
    pair = n.withColumn("x", place(F.col("slot"))).withColumn("y", place(F.lit(teams - 1) - F.col("slot")))
    swap = (F.col("round") >= rounds) != (turn % 2 == 1)
    goals = lambda k: F.floor(noise(seed + k, F.col("game_id")) * 5).cast("int")
    return pair.select("game_id", "round", (F.col("round") * day_ms).cast("long").alias("kickoff"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("home"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("away"), goals(1).alias("hs"), goals(2).alias("aws"))
