"""The candle feature vector, the seven models on it, and the pooled prediction: expressions on the last bar of each asset.

Every feature is scale-free and null where its input is missing; a model leaves out terms that are null and abstains
without enough of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import probability as P
from oddsmith.operators import folds, volatility
from oddsmith.operators.orderflow import book_features

MODELS = ("technical", "momentum", "structure", "orderflow", "derivatives", "volatility_regime", "mean_reversion")
#: Windows of the aggressor and OBV features, least strength of a level, bars that trend and consolidation need.
AGGRESSOR_BARS, OBV_BARS, STRONG, TREND_BARS, RANGE_BARS = 30, 20, 0.3, 10, 20
#: Stability of a regime in the confidence, and the regime model's own confidence.
STABILITY = {"low": 0.9, "normal": 1.0, "elevated": 0.55, "extreme": 0.2}
REGIME_CONFIDENCE = {"low": 0.65, "normal": 0.6, "elevated": 0.3, "extreme": 0.08}
PRIOR_WEIGHT = 0.25


def _named(values: dict[str, float], key: str, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def series(bars: DataFrame) -> DataFrame:
    """One row per bar: windows over closes, ranges and volumes beside the recursive indicators.

    feature_vector reads it several times, so a caller stores it first.
    """
    by = Window.partitionBy("asset").orderBy("rn")
    last = lambda n: by.rowsBetween(-(n - 1), 0)
    full = lambda f, n: F.when(F.count(F.lit(1)).over(last(n)) == n, f.over(last(n)))
    past = lambda n: F.lag("c", n).over(by)
    change = lambda n: F.when((F.col("c") > 0) & (past(n) > 0), F.ln(F.col("c") / past(n)))
    rows = bars.withColumns({
        "bars": F.count(F.lit(1)).over(by), "r1": change(1), "r5": change(5), "r20": change(20), "sd20": full(F.stddev_pop("c"), 20),
        **{f"sma{n}": full(F.avg("c"), n) for n in (20, 50, 200)},
        "tr": F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - past(1)), F.abs(F.col("l") - past(1))),
        "flow": F.when(F.col("c") > past(1), F.col("v")).when(F.col("c") < past(1), -F.col("v")).otherwise(0.0),
        "buys": F.least(F.greatest(F.col("tb"), F.lit(0.0)), F.col("v")),
    })
    rows = rows.withColumns({
        "realised": full(F.stddev_pop("r1"), 20),
        "obv_slope": F.when(F.col("bars") > OBV_BARS, full(F.sum("flow"), OBV_BARS) / F.nullif(full(F.sum("v"), OBV_BARS), F.lit(0.0))),
        "path": full(F.sum("tr"), RANGE_BARS), "span": full(F.max("h"), RANGE_BARS) - full(F.min("l"), RANGE_BARS),
        "bandwidth": F.when(F.col("sma20") > 0, 4 * F.col("sd20") / F.col("sma20")),
        "known": F.when(F.col("tb").isNotNull(), F.col("v")),
    })
    rows = rows.withColumns({
        "aggressor": (2 * F.sum("buys").over(last(AGGRESSOR_BARS)) - F.sum("known").over(last(AGGRESSOR_BARS))) / F.nullif(F.sum("known").over(last(AGGRESSOR_BARS)), F.lit(0.0)),
        "coverage": F.count("known").over(last(AGGRESSOR_BARS)) / F.count(F.lit(1)).over(last(AGGRESSOR_BARS)),
    })
    return rows.join(folds.recursive_indicators(bars), ["asset", "rn"])


def consolidation(rows: DataFrame) -> DataFrame:
    """(asset, consolidation) of the last bar of series: half from how much longer the path of the last RANGE_BARS bars is than their range, half
    from how narrow the bands are within their own history. Fewer than RANGE_BARS + 2 bars: no row."""
    final = rows.groupBy("asset").agg(F.max("bars").alias("bars"), F.max_by("path", "rn").alias("path"), F.max_by("span", "rn").alias("span"), F.max_by("bandwidth", "rn").alias("now"))
    final = final.where(F.col("bars") >= RANGE_BARS + 2)
    ranks = rows.where("bandwidth is not null").join(final.select("asset", "now"), "asset").groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), (F.sum((F.col("bandwidth") < F.col("now")).cast("double")) + F.sum((F.col("bandwidth") == F.col("now")).cast("double")) / 2).alias("rank"),
    )
    path = F.when(F.col("span") <= 0, 1.0).otherwise(_clamp((F.col("path") / F.nullif("span", F.lit(0.0)) - 1) / 3))
    narrow = F.when(F.col("now").isNull() | (F.coalesce("n", F.lit(0)) < 3), path).otherwise(1 - F.col("rank") / F.col("n"))
    return final.join(ranks, "asset", "left").select("asset", _clamp(0.5 * path + 0.5 * narrow).alias("consolidation"))


def _side_by_side(first: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """first with the columns of sides, all of one row an asset at most: one union and one grouping in place of a join each."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides, first.withColumn("known", F.lit(True)))
    return rows.groupBy("asset").agg(*(F.max(c).alias(c) for c in rows.columns if c != "asset")).where("known").drop("known")


def feature_vector(rows: DataFrame, levels: DataFrame, trends: DataFrame, book: DataFrame, derivatives: DataFrame, horizon: int = 1) -> DataFrame:
    """One row per asset with the features of its last bar.

    rows are those of series, levels those of folds.support_levels, trends(asset, trend, strength), book(asset, side, price, qty), derivatives(asset,
    funding_rate, open_interest_value, quote_volume); assets may be missing from all but rows, and any value may be null.
    """
    recent = rows.withColumn("newest", F.row_number().over(Window.partitionBy("asset").orderBy(F.col("rn").desc()))).where(F.col("newest") <= volatility.LOOKBACK)
    newest = volatility.regimes(recent).where("newest = 1")
    rsi_past = rows.where("rsi14 is not null").withColumn("back", F.row_number().over(Window.partitionBy("asset").orderBy(F.col("rn").desc()))).where("back <= 100")
    rsi_rank = rsi_past.groupBy("asset").agg(F.collect_list("rsi14").alias("past"), F.max_by("rsi14", "rn").alias("now")).where(F.size("past") >= 3)
    rsi_rank = rsi_rank.select("asset", volatility.percentile_rank(F.col("past"), F.col("now")).alias("rsi_percentile"))
    near = levels.where(F.col("strength") >= STRONG).join(newest.select("asset", "c", "atr14"), "asset").where("atr14 > 0").withColumn("distance", F.abs(F.col("c") - F.col("level")) / F.col("atr14"))
    near = near.groupBy("asset", "is_support").agg(F.min(F.struct("distance", "level", "strength")).alias("n"))
    of = lambda support, field: F.max(F.when(F.col("is_support") == support, F.col(f"n.{field}")))
    near = near.groupBy("asset").agg(*(of(side == "support", f).alias(f"{side}_{f}") for side in ("support", "resistance") for f in ("distance", "strength", "level")))
    broken = folds.breakouts(rows, levels).select("asset", F.col("kind").alias("breakout"), F.col("strength").alias("breakout_strength"), F.col("is_support").alias("breakout_at_support"))
    trends = trends.select("asset", F.col("trend").alias("trend"), F.col("strength").alias("trend_strength"))
    derivatives = derivatives.select("asset", "funding_rate", F.col("open_interest_value").alias("open_interest"), F.when(F.col("quote_volume") > 0, F.col("open_interest_value") / F.col("quote_volume")).alias("oi_to_volume"))
    joined = _side_by_side(newest, [rsi_rank, near, broken, trends, consolidation(rows), book_features(book), derivatives, volatility.forecasts(rows, rows, horizon)])
    versus = lambda n: F.when(F.col(f"sma{n}") > 0, F.col("c") / F.col(f"sma{n}") - 1).alias(f"vs_sma{n}")
    return joined.select(
        "asset", "rn", F.col("bars").alias("candles"), F.col("c").alias("spot"), F.col("rsi14").alias("rsi"), "rsi_percentile", (F.col("macd_histogram") / F.nullif("atr14", F.lit(0.0))).alias("histogram_atr"),
        F.when(F.col("sd20") == 0, 0.5).otherwise((F.col("c") - F.col("sma20") + 2 * F.col("sd20")) / F.nullif(4 * F.col("sd20"), F.lit(0.0))).alias("percent_b"),
        versus(20), versus(50), versus(200), F.when(F.col("sd20") == 0, 0.0).otherwise((F.col("c") - F.col("sma20")) / F.nullif("sd20", F.lit(0.0))).alias("z"),
        F.when(F.col("ema12") != F.col("ema26"), F.col("ema12") > F.col("ema26")).alias("ema_up"), F.col("adx14").alias("adx"), (F.col("plus_di") - F.col("minus_di")).alias("di_spread"),
        "obv_slope", "atr_percentile", F.when(F.col("bars") >= TREND_BARS, F.col("trend")).alias("trend"), F.when(F.col("bars") >= TREND_BARS, F.col("trend_strength")).alias("trend_strength"),
        *(f"{side}_{f}" for side in ("support", "resistance") for f in ("distance", "strength", "level")), "consolidation", "breakout", "breakout_strength", "breakout_at_support",
        "book_imbalance", "book_depth", "bid_wall", "bid_wall_distance", "ask_wall", "ask_wall_distance", "aggressor", "coverage", "funding_rate", "open_interest", "oi_to_volume",
        "realised", F.col("ewma_vol").alias("ewma"), "expected_move", "range_low", "range_high", "vol_confidence", "vol_regime", F.col("r1").alias("ret1"), F.col("r5").alias("ret5"), F.col("r20").alias("ret20"),
    )


def completeness(features: DataFrame) -> DataFrame:
    """(asset, completeness): the share of the eighteen groups of features that are known."""
    groups = ["rsi", "histogram_atr", "percent_b", "vs_sma20", "vs_sma50", "vs_sma200", "ema_up", "adx", "obv_slope", "atr_percentile", "trend", None, "consolidation", "book_imbalance", "aggressor", "funding_rate", "expected_move", "ret5"]
    known = [F.coalesce("support_distance", "resistance_distance").isNotNull() if g is None else F.col(g).isNotNull() for g in groups]
    return features.select("asset", (sum((k.cast("int") for k in known), F.lit(0)) / len(known)).alias("completeness"))


def _logistic_model(name: str, terms: dict[str, Column], base: float | Column, least: int, abstains: Column | None = None) -> Column:
    """A model that sums squashed terms: null terms are left out, and fewer than `least` make it abstain.

    Contributions share out the tilt of the probability among the terms; without any tilt a quarter of each score.
    """
    defined = sum((t.isNotNull().cast("int") for t in terms.values()), F.lit(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms.values()), F.lit(0.0))
    votes = (defined >= least) & (~abstains if abstains is not None else F.lit(True))
    p = 1 / (1 + F.exp(-total))
    share = F.when(F.abs(total) < 1e-12, 0.25).otherwise((p - 0.5) / F.nullif(total, F.lit(0.0)))
    parts = F.filter(F.array(*(F.struct(F.lit(k).alias("term"), (share * t).alias("contribution")) for k, t in terms.items())), lambda x: x["contribution"].isNotNull())
    nothing = F.array().cast("array<struct<term:string,contribution:double>>")
    confidence = _clamp((F.lit(base) if isinstance(base, float) else base) * defined / len(terms))
    return F.struct(F.lit(name).alias("model"), F.when(votes, p).alias("p"), F.when(votes, confidence).otherwise(0.0).alias("confidence"), F.when(votes, parts).otherwise(nothing).alias("parts"))


def model_outputs(features: DataFrame) -> DataFrame:
    """(asset, model, p, confidence, parts, abstained): seven rows per asset; parts are (term, contribution) towards up."""
    c, squash = F.col, lambda x, scale: F.tanh(x / scale)
    sigma = F.coalesce(F.when(c("realised") > 0, c("realised")), F.lit(0.01))
    rsi_far = F.signum(c("rsi") - 50) * F.greatest(F.lit(0.0), F.abs(c("rsi") - 50) / 50 - 0.4) / 0.6
    b_far = F.signum(c("percent_b") - 0.5) * F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.abs(c("percent_b") - 0.5) - 0.35) / 0.15)
    trend_gate = F.coalesce(0.4 + 0.6 * _clamp((c("adx") - 15) / 25), F.lit(0.7))
    range_gate = F.coalesce(0.4 + 0.6 * c("consolidation"), F.lit(0.7))
    directed = c("trend").isin("HH-HL", "LH-LL")
    trend = F.when(c("trend") == "HH-HL", 0.8 * c("trend_strength")).when(c("trend") == "LH-LL", -0.8 * c("trend_strength")).when(c("trend").isNotNull(), 0.0)
    pull = lambda side: F.when(c(f"{side}_distance") < 2, 0.6 * c(f"{side}_strength") * (1 - c(f"{side}_distance") / 2)).otherwise(0.0)
    proximity = F.when(c("support_distance").isNotNull() | c("resistance_distance").isNotNull(), pull("support") - pull("resistance"))
    broke = F.when(c("breakout") == "breakout", 0.9 * c("breakout_strength")).when(c("breakout") == "breakdown", -0.9 * c("breakout_strength"))
    broke = broke.when(c("breakout") == "rejection", F.when(c("breakout_at_support"), 0.54).otherwise(-0.54) * c("breakout_strength")).when(c("breakout").isNotNull(), 0.0)
    wall = lambda side: F.when(c(f"{side}_wall_distance") < 0.02, 0.2 * F.least(F.lit(1.0), c(f"{side}_wall") / 10) * (1 - c(f"{side}_wall_distance") / 0.02)).otherwise(0.0)
    funding = -0.9 * squash(c("funding_rate"), 5e-4)
    models = [
        _logistic_model("technical", {"rsi": -0.9 * rsi_far, "macd": 0.8 * squash(c("histogram_atr"), 0.5), "percent_b": -0.5 * b_far, "average": 0.7 * squash(F.coalesce("vs_sma50", "vs_sma20"), 0.05)}, 0.7, 2),
        _logistic_model("momentum", {"return_5": 0.9 * trend_gate * F.tanh(c("ret5") / (2 * sigma * 5**0.5)), "return_20": 0.7 * trend_gate * F.tanh(c("ret20") / (2 * sigma * 20**0.5)), "obv": 0.5 * squash(c("obv_slope"), 0.5)}, 0.7, 1),
        _logistic_model("structure", {"trend": trend, "levels": proximity, "breakout": broke}, 0.65, 1),
        _logistic_model("orderflow", {"aggressor": 1.2 * c("aggressor") * F.coalesce("coverage", F.lit(1.0)), "book": 0.4 * c("book_imbalance"), "walls": F.when(c("book_imbalance").isNotNull(), wall("bid") - wall("ask"))},
            F.when(c("aggressor").isNull(), 0.3).otherwise(0.7), 1),
        _logistic_model("derivatives", {"funding": funding, "crowding": funding * 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("oi_to_volume")) / 1.5)}, 0.6, 1),
        _logistic_model("volatility_regime", {"regime": F.when(c("vol_regime").isNotNull(), 0.0)}, _named(REGIME_CONFIDENCE, "vol_regime", 0.5), 1),
        _logistic_model("mean_reversion", {"z": -0.9 * range_gate * squash(c("z"), 2.0), "percent_b": -0.6 * range_gate * F.tanh((c("percent_b") - 0.5) * 2)}, 0.6, 1, F.coalesce(directed & (c("trend_strength") >= 0.6), F.lit(False))),
    ]
    return features.select("asset", F.explode(F.array(*models)).alias("m")).select("asset", "m.model", "m.p", "m.confidence", "m.parts", F.col("m.p").isNull().alias("abstained"))


def skill_weights(skills: DataFrame) -> DataFrame:
    """(model, weight) of skills(model, skill): the Brier skill where it is positive, PRIOR_WEIGHT where it is unknown; all alike if that is nothing."""
    raw = F.coalesce(F.greatest(F.lit(0.0), F.col("skill")), F.lit(PRIOR_WEIGHT))
    everyone = Window.partitionBy(F.lit(0))
    rows = skills.withColumn("raw", raw).withColumns({"total": F.sum("raw").over(everyone), "n": F.count(F.lit(1)).over(everyone)})
    return rows.select("model", F.when(F.col("total") == 0, 1.0 / F.col("n")).otherwise(F.col("raw")).alias("weight"))


def predict(features: DataFrame, skills: DataFrame, quality: DataFrame, calibrator: DataFrame | None = None) -> DataFrame:
    """(asset, raw_up, p_up, calibrated, agreement, voters, effective, confidence, direction): the models' log-odds pool, calibrated and graded.

    Weights come from skills(model, skill), a model without a row has PRIOR_WEIGHT; models that abstain or weigh nothing do
    not vote. calibrator(x, y) are the knots of an isotonic curve, used if given. Confidence multiplies data quality
    (quality(asset, score), 0 to 100; missing: 0), agreement, sample size, completeness, diversity and regime stability.
    Without voters p_up is one half and confidence 0.05 at most.
    """
    votes = model_outputs(features).where("not abstained").join(F.broadcast(skill_weights(skills)), "model", "left").withColumn("w", F.coalesce("weight", F.lit(PRIOR_WEIGHT))).where("w > 0")
    votes = votes.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("asset"))).withColumn("x", F.expr(P.logit("p"))).withColumn("y", F.expr(P.logit("(1e0 - p)")))
    votes = votes.withColumns({"mx": F.sum(F.col("w") * F.col("x")).over(Window.partitionBy("asset")), "my": F.sum(F.col("w") * F.col("y")).over(Window.partitionBy("asset"))})
    spread = lambda v, m: F.sqrt(F.sum(F.col("w") * F.pow(F.col(v) - F.col(m), 2)))
    sums = votes.groupBy("asset").agg(F.max("mx").alias("x"), ((spread("x", "mx") + spread("y", "my")) / 2).alias("sd"), F.count(F.lit(1)).alias("voters"), (1 / F.sum(F.col("w") * F.col("w"))).alias("effective"))
    rows = features.select("asset", "candles", "vol_regime").join(sums, "asset", "left").join(completeness(features), "asset").join(quality.select("asset", F.col("score").alias("dq")), "asset", "left")
    rows = rows.withColumn("raw_up", F.coalesce(F.expr(P.sigmoid("x")), F.lit(0.5))).withColumn("voters", F.coalesce("voters", F.lit(0))).withColumn("effective", F.coalesce("effective", F.lit(0.0)))
    if calibrator is None:
        rows = rows.withColumn("p_up", F.col("raw_up")).withColumn("calibrated", F.lit(False))
    else:
        knots = F.broadcast(calibrator.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots")))  # a calibrator has at most as many knots as bins
        low, high = F.element_at("knots", 1), F.element_at("knots", -1)
        below = F.element_at(F.filter("knots", lambda k: k["x"] <= F.col("raw_up")), -1)
        above = F.get(F.filter("knots", lambda k: k["x"] > F.col("raw_up")), F.lit(0))
        inner = below["y"] + (F.col("raw_up") - below["x"]) / (above["x"] - below["x"]) * (above["y"] - below["y"])
        curve = F.when(F.col("raw_up") <= low["x"], low["y"]).when(F.col("raw_up") >= high["x"], high["y"]).otherwise(inner)
        rows = rows.crossJoin(knots).withColumn("calibrated", F.size("knots") > 0).withColumn("p_up", F.when(F.col("calibrated"), curve).otherwise(F.col("raw_up")))
    agreement = F.when(F.col("voters") >= 2, 1 - F.least(F.lit(1.0), F.col("sd") / 2.2)).when(F.col("voters") == 1, 1.0).otherwise(0.0)
    rows = rows.withColumn("agreement", agreement)
    t = _clamp((F.coalesce("dq", F.lit(0.0)) / 100 - 0.4) / 0.55)
    terms = (
        0.35 + 0.65 * t * t * (3 - 2 * t), 0.3 + 0.7 * F.col("agreement"), F.col("candles") / (F.col("candles") + 200), 0.4 + 0.6 * F.pow("completeness", F.lit(1.5)),
        0.65 + 0.35 * F.col("effective") / (F.col("effective") + 5), 0.55 + 0.45 * _named(STABILITY, "vol_regime", 0.6),
    )
    own = F.lit(0.95)
    for term in terms:
        own = own * term
    own = _clamp(own, 0.01, 0.99)
    direction = F.when(F.col("p_up") > 0.52, "bullish").when(F.col("p_up") < 0.48, "bearish").otherwise("neutral")
    return rows.select("asset", "raw_up", "p_up", "calibrated", "agreement", "voters", "effective", F.when(F.col("voters") == 0, F.least(own, F.lit(0.05))).otherwise(own).alias("confidence"), direction.alias("direction"))
