"""Mixing sources to target weights by entropy balancing; DataFrame functions only on the path of the rows.

Of all rates between 0 and `most` that give every source its target of words, entropy balancing takes those nearest to 1
in relative entropy. They are exponentially tilted: a document of x times its source's mean size gets the rate
exp(lambda x), at most `most`, with one lambda a source, the maximum of the convex dual, which Newton steps find.
Rates depend on source and size alone, so rows are counted by both and all steps run over these counts. Each step
is one grouped sum, and its state has a row for each source; neither comes to the driver. Sums are of decimals, so that
their order, and with it the cluster, does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, materialize

#: Fixed values of the contract: weights of sources in order, repeating, and the most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Newton's steps end when every source is this near to its target, as a share of it or in words.
NEAR, NEAR_WORDS = 1e-7, 0.01
STEPS = 200
#: Times that a source's rounded copies are corrected, by copies of one size each.
CORRECTIONS = 3
#: Sources in one task when they are put in order.
SOURCES_A_TASK = 1_000_000

_EXACT = "decimal(38,9)"


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, place): size is the number of words [^\\x20\\x09-\\x0D]+ of the whole text, null: 0."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("place"))


def _numbered(rows: DataFrame, order: list, within: list[str], name: str) -> DataFrame:
    """rows with their rank from 1 within the columns `within`, which lead the order; a group may span many tasks."""
    parts = materialize(rows.withColumn("part", F.spark_partition_id()), "ordered")
    counts = parts.groupBy("part", *within).agg(F.count(F.lit(1)).alias("own"))
    ahead = F.coalesce(F.sum("own").over(Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.withColumn("ahead", ahead).drop("own"), "ahead")
    own = F.row_number().over(Window.partitionBy("part", *within).orderBy(*order))
    same = [parts[c].eqNullSafe(counts[c]) for c in ("part", *within)]
    found = parts.withColumn("own", own).join(broadcast_if_small(counts), same)
    return found.select(*(parts[c] for c in rows.columns), (F.col("own") + F.col("ahead")).alias(name))


def weighted_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs, least, weight, rank, one): a row per source in code point order, null last, weights repeating.

    docs and least are the number and the least size of its documents that have words.
    """
    rows = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    rows = materialize(rows.withColumn("one", F.lit(1)), "sources")
    order = F.col("source").asc_nulls_last()
    spread = rows.repartitionByRange(rows.count() // SOURCES_A_TASK + 1, "one", order)
    ranked = _numbered(spread, [order], ["one"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    return materialize(ranked.withColumn("weight", weight.cast("long")), "weighted")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources with target: the words of all sources, shared by weight up to `most` times a source's own.

    A source's target is the lesser of that limit and its weight times a level; the level rises as sources reach their
    limits, until it gives away all words. One row of sums comes to the driver for each rise.
    """
    total = int(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        at_limit = F.lit(float(most)) * F.col("source_size") <= F.col("weight") * F.lit(level)
        n, held, weight = sources.agg(
            F.count(F.when(at_limit, 1)), F.coalesce(F.sum(F.when(at_limit, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not weight:
            break
        level, capped = (total - most * int(held)) / int(weight), n
    return sources.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.col("weight") * F.lit(level)))


def _rate(most: int):
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilted))


def balanced(counts: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """wanted with mean, full and tilt: the lambda of each source, so that its tilted rates give its target.

    counts is (rank, size, n). Newton's steps on the logarithm of a source's words stay within a bracket that shrinks by
    each step's sign, and halve it when they would leave it: they end for any sizes. full marks sources whose target is their
    limit: all their documents get the greatest rate.
    """
    per = F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))
    full = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    short = F.when(full, F.lit(0.0)).otherwise(F.ln(F.col("target") / F.col("source_size")))
    unit = F.col("least") / F.col("mean")
    state = wanted.withColumns({"mean": F.when(F.col("docs") > 0, per).otherwise(1.0), "full": full}).withColumns(
        {"tilt": F.lit(0.0), "low": F.when(full, 0.0).otherwise(F.least(F.lit(0.0), short / unit)), "high": F.when(full, 0.0).otherwise(F.log(F.lit(float(most))) / unit), "done": full}
    )
    tasks = wanted.count() // SOURCES_A_TASK + 1
    state = materialize(state.coalesce(tasks), "tilts")
    for _ in range(STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            return state
        rows = counts.join(broadcast_if_small(state.where(~F.col("done"))), "rank").withColumn("rate", _rate(most))
        words = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy("rank").agg(F.sum(words.cast(_EXACT)).cast("double").alias("words"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        over = F.col("words") >= F.col("target")
        near = F.abs(F.col("words") - F.col("target")) <= F.greatest(F.lit(NEAR_WORDS), F.lit(NEAR) * F.col("target"))
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - F.ln(F.col("words") / F.col("target")) * F.col("words") / F.col("slope"))
        moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        # Where the bracket has closed to neighbouring numbers, nothing nearer exists.
        done = F.col("done") | near | (moved == F.col("tilt"))
        after = state.join(sums, "rank", "left").withColumns({"low": F.coalesce(low, F.col("low")), "high": F.coalesce(high, F.col("high"))})
        after = after.withColumn("stop", F.coalesce(done, F.lit(True))).withColumn("tilt", F.when(F.col("stop"), F.col("tilt")).otherwise(moved))
        after = after.select(*(c for c in state.columns if c != "done"), F.col("stop").alias("done"))
        state = materialize(after.coalesce(tasks), "tilts")
    return state


def copies_by_size(counts: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """(rank, size, n, rate, k): of n documents of a size, k copies together, their words near the source's target.

    From the largest size down, k rounds the running sum of rates: its error in words telescopes to half the largest size
    at most. Then each source adds or takes away copies of the size that leaves the least error, a few times.
    """
    state = tilts.select("rank", "target", "mean", "full", "tilt")
    rows = counts.join(broadcast_if_small(state), "rank").withColumn("rate", _rate(most))
    whole = Window.partitionBy("rank").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.floor(F.sum((F.col("n") * F.col("rate")).cast(_EXACT)).over(whole) + F.lit("0.5").cast(_EXACT)).cast("long")
    rows = rows.withColumn("reached", reached)
    before = F.coalesce(F.lag("reached").over(Window.partitionBy("rank").orderBy(F.col("size").desc())), F.lit(0))
    rows = materialize(rows.select("rank", "size", "n", "rate", (F.col("reached") - before).alias("k")), "copies")
    tasks = tilts.count() // SOURCES_A_TASK + 1
    for _ in range(CORRECTIONS):
        taken = rows.groupBy("rank").agg(F.sum(F.col("k") * F.col("size")).alias("taken"))
        left = taken.join(tilts.select("rank", "target"), "rank").select("rank", (F.col("target") - F.col("taken")).alias("left"))
        left = materialize(left.coalesce(tasks), "left")
        room = F.when(F.col("left") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
        count = F.least(room, F.floor(F.abs("left") / F.col("size") + 0.5).cast("long"))
        fits = rows.where("size > 0").join(broadcast_if_small(left), "rank").withColumn("count", count).where("count > 0")
        fits = fits.withColumn("error", F.abs(F.abs("left") - F.col("count") * F.col("size"))).where(F.col("error") < F.abs("left"))
        best = fits.groupBy("rank").agg(F.min_by(F.struct("size", F.signum("left").cast("long") * F.col("count")), F.struct("error", "size")).alias("best"))
        picked = materialize(best.select("rank", "best.size", F.col("best.col2").alias("change")).coalesce(tasks), "picked")
        if not picked.limit(1).count():
            break
        rows = rows.join(broadcast_if_small(picked), ["rank", "size"], "left")
        rows = materialize(rows.select("rank", "size", "n", "rate", (F.col("k") + F.coalesce("change", F.lit(0))).alias("k")), "copies")
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of docs; taken is copies times size.

    Sources are weighed in code point order, a null source last, and share the words of all by weight, up to `most` times
    their own. The k copies of a source's n documents of one size are k div n each and one more for the k mod n first by the
    hash of their ids (then id; rows of equal ids are alike), so reruns agree. Null, empty and blank texts have size 0 and
    add no words; long texts count whole; repeated rows are mixed each; an empty table gives none; other columns go.
    Which rows come first is found by ranges of the order, so a size that a third of all rows share spans many tasks.
    """
    sized = materialize(sizes(docs), "sized")
    sources = weighted_sources(sized, weights)
    wanted = materialize(targets(sources, most), "targets")
    known = wanted.select(F.col("source").alias("named"), "rank")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(broadcast_if_small(known), F.col("source").eqNullSafe(F.col("named"))).select("rank", "size", "n")
    counts = materialize(counts, "counts")
    copies = copies_by_size(counts, balanced(counts, wanted, most), most)
    about = wanted.select(F.col("source").alias("named"), "rank", "source_size", "target")
    found = copies.join(broadcast_if_small(about), "rank").select(
        "named", F.col("size").alias("sized"), "rate", "source_size", "target", F.expr("k div n").alias("base"), F.expr("k % n").alias("extra")
    )
    found = materialize(found, "classes")
    same = F.col("source").eqNullSafe(F.col("named")) & (F.col("size") == F.col("sized"))
    rows = materialize(sized.join(broadcast_if_small(found), same).drop("named", "sized"), "mixed")
    shared = rows.where("extra > 0").withColumn("key", F.xxhash64("doc_id"))
    order = ["key", "doc_id", "place"]
    ranked = _numbered(shared.repartitionByRange("source", "size", *order), order, ["source", "size"], "first")
    more = ranked.withColumn("copies", F.col("base") + (F.col("first") <= F.col("extra")).cast("long")).drop("key", "first")
    every = rows.where("extra = 0").withColumn("copies", F.col("base")).unionByName(more)
    return every.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
