"""What a resting order book tells: imbalance near the middle, depth, and walls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances of the middle that count for imbalance, depth and walls; least levels and multiple of a wall.
NEAR, DEEP, WALL_REACH, WALL_LEVELS, WALL_MULTIPLE = 0.005, 0.01, 0.05, 5, 5.0


def book_features(book: DataFrame) -> DataFrame:
    """(asset, book_imbalance, book_depth, bid_wall, bid_wall_distance, ask_wall, ask_wall_distance) of book(asset, side, price, qty).

    A wall is a level of at least WALL_MULTIPLE times the median of its side within WALL_REACH of the middle; the nearest
    counts, its size as a multiple. A book without a middle has zero imbalance and depth and no walls.
    """
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    mids = book.groupBy("asset").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"))
    mids = mids.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    rows = book.join(mids, "asset").withColumn("distance", F.abs(F.col("price") - F.col("mid")) / F.nullif("mid", F.lit(0.0)))
    held = lambda side, reach: F.sum(F.when((F.col("side") == side) & (F.col("distance") <= reach), F.col("qty")).otherwise(0.0))
    deep = F.col("distance") <= DEEP
    sums = rows.groupBy("asset").agg(
        held("bid", NEAR).alias("b0"), held("ask", NEAR).alias("a0"), held("bid", DEEP).alias("b1"), held("ask", DEEP).alias("a1"), F.max("mid").alias("mid"),
        F.max((F.col("best_ask") - F.col("best_bid")) / F.nullif("mid", F.lit(0.0)) * 10_000).alias("bps"), F.count(F.when(deep & (F.col("qty") > 0), 1)).alias("levels"), F.max(F.when(deep, F.col("qty"))).alias("largest"),
    )
    imbalance = F.coalesce((F.col("b0") - F.col("a0")) / F.nullif(F.col("b0") + F.col("a0"), F.lit(0.0)), F.lit(0.0))
    both = F.nullif(F.col("b1") + F.col("a1"), F.lit(0.0))
    depth = 0.35 * F.exp(-F.greatest(F.lit(0.0), "bps") / 10) + 0.3 * F.least(F.lit(1.0), F.col("levels") / 40) + 0.2 * (1 - F.abs(F.col("b1") - F.col("a1")) / both) + 0.15 * (1 - F.col("largest") / both)
    depth = F.when((F.col("b1") > 0) & (F.col("a1") > 0), depth).otherwise(0.0)
    within = rows.where((F.col("distance") <= WALL_REACH) & (F.col("qty") > 0))
    usual = within.groupBy("asset", "side").agg(F.percentile("qty", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= WALL_LEVELS) & (F.col("median") > 0))
    walls = within.join(usual, ["asset", "side"]).withColumn("multiple", F.col("qty") / F.col("median")).where(F.col("multiple") >= WALL_MULTIPLE)
    nearest = walls.groupBy("asset", "side").agg(F.min(F.struct("distance", "price", "multiple")).alias("w"))
    of = lambda side, field: F.max(F.when(F.col("side") == side, F.col(f"w.{field}")))
    nearest = nearest.groupBy("asset").agg(*(of(s, f).alias(n) for s in ("bid", "ask") for f, n in (("multiple", f"{s}_wall"), ("distance", f"{s}_wall_distance"))))
    return sums.join(nearest, "asset", "left").select("asset", imbalance.alias("book_imbalance"), depth.alias("book_depth"), "bid_wall", "bid_wall_distance", "ask_wall", "ask_wall_distance")
