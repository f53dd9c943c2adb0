"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it knows."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. Edges run from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any sortable type to (node, root), root the least node of its component.

    Self loops and nulls are dropped, repeated edges count once; an empty table gives an empty result. Rounds run
    until the edge set no longer changes; each is written to the shared folder. The per-node minimum is an ordinary
    aggregate with partial sums joined back, so that a hub is never gathered in one task.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = now
        e = materialize(_small_star(_large_star(e).distinct()).distinct(), "edges")
