"""Exact quantiles of groups of any length: a sketch says where to look, counts say what lies there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far around a share the sketch is trusted, and its accuracy; a place outside is found by sorting all values instead.
_AROUND, _ACCURACY = 5e-4, 10_000


def _found(rows: DataFrame, brackets: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(key, rows of a group below and within its bracket, by share) and (key, name, x, up to): the running count of each value within."""
    met = rows.join(F.broadcast(brackets), rows["key"].eqNullSafe(brackets["own"]))
    low = {c: F.col(f"lo_{c}").isNotNull() & (F.col("x") < F.col(f"lo_{c}")) for c in shares}
    within = {c: ~low[c] & (F.col(f"hi_{c}").isNull() | (F.col("x") <= F.col(f"hi_{c}"))) for c in shares}
    count = lambda which, c: F.count(F.when(which[c], 1))
    sizes = met.groupBy("key").agg(*(count(low, c).alias(f"below_{c}") for c in shares), *(count(within, c).alias(f"in_{c}") for c in shares))
    some = met.select("key", "x", F.array_compact(F.array(*(F.when(within[c], c) for c in shares))).alias("names")).where(F.size("names") > 0)
    values = some.groupBy("key", "x", "names").agg(F.count(F.lit(1)).alias("n")).select("key", F.explode("names").alias("name"), "x", "n")
    return sizes, values.select("key", "name", "x", F.sum("n").over(Window.partitionBy("key", "name").orderBy("x")).alias("upto"))


def linear_quantiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(key, *shares) of rows(key, x): x at place share * (n - 1) of a group's n known values in order, between two places in proportion.

    Few groups of any length: a group's values are counted below and within brackets, and only values within are sorted.
    Nulls are no values; a group without values has nulls.
    """
    around = F.array(*(F.lit(min(1.0, max(0.0, q + by))) for q in shares.values() for by in (-_AROUND, _AROUND)))
    told = rows.groupBy(F.col("key").alias("own")).agg(F.count("x").alias("size"), F.percentile_approx("x", around, _ACCURACY).alias("e"))
    ends = [F.element_at("e", 2 * i + j + 1).alias(f"{side}_{c}") for i, c in enumerate(shares) for j, side in enumerate(("lo", "hi"))]
    brackets = rows.sparkSession.createDataFrame(told.select("own", "size", *ends).collect(), told.select("own", "size", *ends).schema)
    known, at = rows.where("x is not null"), {c: (F.col("size") - 1) * F.lit(q) for c, q in shares.items()}
    sizes, values = _found(known, brackets, shares)
    sizes = sizes.join(brackets, sizes["key"].eqNullSafe(brackets["own"])).select("key", "size", *(f"{side}_{c}" for c in shares for side in ("below", "in")))
    sizes = rows.sparkSession.createDataFrame(sizes.collect(), sizes.schema)
    missed = [(F.floor(p) < F.col(f"below_{c}")) | (F.ceil(p) >= F.col(f"below_{c}") + F.col(f"in_{c}")) for c, p in at.items()]
    if not sizes.where(F.greatest(*missed)).isEmpty():
        wide = brackets.select("own", "size", *(F.lit(None).cast("double").alias(f"{side}_{c}") for c in shares for side in ("lo", "hi")))
        values = _found(known, wide, shares)[1]
        sizes = sizes.withColumns({f"below_{c}": F.lit(0) for c in shares})
    places = sizes.select(F.col("key").alias("own"), F.explode(F.array(*(F.struct(F.lit(c).alias("of"), p.alias("at"), F.col(f"below_{c}").alias("below")) for c, p in at.items()))).alias("p")).select("own", "p.*")
    met = values.join(F.broadcast(places), values["key"].eqNullSafe(places["own"]) & (values["name"] == places["of"]))
    place = lambda whole: F.min(F.when(F.col("below") + F.col("upto") > whole(F.col("at")), F.col("x")))
    ends = met.groupBy("own", "of").agg(F.first("at").alias("at"), place(F.floor).alias("low"), place(F.ceil).alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    found = ends.groupBy("own").agg(*(F.max(F.when(F.col("of") == c, value)).alias(c) for c in shares))
    return brackets.select(F.col("own").alias("key")).join(found, F.col("key").eqNullSafe(found["own"]), "left").select("key", *shares)
