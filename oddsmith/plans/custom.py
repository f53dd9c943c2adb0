"""Registered plans that need grouped Python, state or streams; where SQL can say the same recursively, that is the oracle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.dialect import DUCK, SPARK
from oddsmith.operators import clusters, features, folds, learning, matches, neighbours, quantiles, ratings, registry, store, volatility
from oddsmith.operators.orderflow import book_features
from oddsmith.operators.fixtures import league_form
from oddsmith.plans import candles, fixtures, markets, relations
from oddsmith.plans import text as texts
from oddsmith.streaming import candles as streams


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    from oddsmith.plans.catalog import register

    register(spark, sf_dir, text)
    return spark.sql(text)


def bars(spark: SparkSession, sf_dir: str, width_ms: int = 3_600_000) -> DataFrame:
    return _sql(spark, sf_dir, f"WITH {relations.bars(SPARK, width_ms)} SELECT * FROM bars")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"WITH {relations.games(SPARK)} SELECT * FROM games")


def _scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the one that driver and executors share; in local runs without one, under a temporary folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found and not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(found or tempfile.gettempdir()).rstrip('/')}/oddsmith-{label}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def ta_ema(spark, sf_dir):
    return _rounded(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "ema12").dropna())


def ta_rsi(spark, sf_dir):
    return _rounded(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "rsi14").dropna(), 5)


def ta_atr(spark, sf_dir):
    return _rounded(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "atr14").dropna())


def ta_macd_adx_stochrsi(spark, sf_dir):
    return _rounded(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "macd", "macd_signal", "macd_histogram", "stoch_rsi_k", "stoch_rsi_d", "adx14", "plus_di", "minus_di"))


def vol_ewma(spark, sf_dir):
    return _rounded(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "ewma_vol").dropna())


def structure_levels(spark, sf_dir):
    return _rounded(folds.support_levels(bars(spark, sf_dir)))


def structure_value_area(spark, sf_dir):
    return _rounded(folds.value_area(_sql(spark, sf_dir, candles.plans(SPARK)["structure_volume_bins"])))


def structure_breakout(spark, sf_dir):
    own = bars(spark, sf_dir)
    return _rounded(folds.breakouts(own, folds.support_levels(own)))


def sports_match_ensemble(spark, sf_dir):
    season = fixtures._Season(spark, sf_dir)
    played, pairs = season.games, season.pairs()
    outcomes = matches.outcome_rows(pairs, ratings.batch_elo(played), ratings.attack_defence(played), league_form(season.form()))
    outcomes = outcomes.unionByName(learning.learned_outcomes(pairs, played).select(*outcomes.columns))
    return _rounded(matches.pooled(outcomes), 4)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, for what several branches of a plan read."""
    path = _scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _features(spark, sf_dir):
    trends = _sql(spark, sf_dir, candles.plans(SPARK)["structure_trend"])
    book = _sql(spark, sf_dir, f"WITH {relations.asset_books(SPARK)} SELECT * FROM asset_books")
    series = _stored(features.series(bars(spark, sf_dir)), "series")
    levels = _stored(folds.support_levels(series), "levels")
    return _stored(features.feature_vector(series, levels, trends, book, _sql(spark, sf_dir, f"WITH {relations.derivatives(SPARK)} SELECT * FROM derivatives")), "features")


def candle_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir))


def candle_models(spark, sf_dir):
    found = features.model_outputs(_features(spark, sf_dir))
    return _rounded(found.select("asset", "model", "p", "confidence", "abstained", F.size("parts").cast("bigint").alias("terms"), F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["contribution"]).alias("tilt")))


def candle_predict(spark, sf_dir):
    """Skills of the models, data quality and the calibration curve come from the predictions that have come true."""
    skills = _sql(spark, sf_dir, "SELECT CAST(NULL AS STRING) AS model, CAST(NULL AS DOUBLE) AS skill WHERE false")
    graded = _sql(spark, sf_dir, "SELECT event_type AS asset, 100e0 * avg(CASE WHEN value IS NULL THEN 0e0 ELSE 1e0 END) AS score FROM events GROUP BY event_type")
    observed = _observations(spark, sf_dir).where("domain = 'F'").select(F.lit("candles").alias("domain"), "p", "y")
    curve = learning.isotonic_fit(observed).select("x", "y")
    return _rounded(features.predict(_features(spark, sf_dir), skills, graded, curve))


def feature_completeness(spark, sf_dir):
    return _rounded(features.completeness(_features(spark, sf_dir)))


def vol_atr_regime(spark, sf_dir):
    rows = volatility.regimes(folds.recursive_indicators(bars(spark, sf_dir)).select("asset", "rn", "atr14"))
    return _rounded(rows.where("atr_percentile is not null").select("asset", "rn", "atr_percentile", "vol_regime"))


def vol_forecast(spark, sf_dir):
    own = bars(spark, sf_dir)
    indicators = folds.recursive_indicators(own)
    one, day = (volatility.forecasts(own, indicators, h).withColumn("horizon", F.lit(h).cast("bigint")) for h in (1, 24))
    return _rounded(one.union(day))


def structure_consolidation(spark, sf_dir):
    return _rounded(features.consolidation(_stored(features.series(bars(spark, sf_dir)), "series")))


def orderflow_book_features(spark, sf_dir):
    return _rounded(book_features(_sql(spark, sf_dir, f"WITH {relations.asset_books(SPARK)} SELECT * FROM asset_books")))


def sports_elo_batch(spark, sf_dir):
    return _rounded(ratings.batch_elo(games(spark, sf_dir)), 4)


def sports_elo_sum(spark, sf_dir):
    rated = ratings.batch_elo(games(spark, sf_dir))
    return rated.groupBy("league").agg(F.round(F.sum("rating"), 4).alias("total"), F.count(F.lit(1)).alias("teams"), F.sum("games").alias("sides"))


def sports_elo_history(spark, sf_dir):
    return _rounded(ratings.elo_history(games(spark, sf_dir)), 4)


def sports_attack_defence(spark, sf_dir):
    return _rounded(ratings.attack_defence(games(spark, sf_dir)), 4)


def sports_learned_model(spark, sf_dir):
    played = games(spark, sf_dir)
    found = learning.learned_outcomes(played.select("league", "home", "away").distinct(), played)
    return _rounded(found.select("league", "home", "away", "home_p", "draw_p", "away_p", "confidence", F.get("factors", F.lit(0))["feature"].alias("most"), F.get("factors", F.lit(0))["contribution"].alias("share")), 4)


#: Folds of a league that are validated, the latest; each is trained anew from all games before it.
VALIDATED_FOLDS = 25


def _folds(spark, sf_dir):
    return learning.walk_forward(ratings.learned_features(games(spark, sf_dir)), ratings.FEATURES, most=VALIDATED_FOLDS)


def learn_walk_forward(spark, sf_dir):
    return _rounded(_folds(spark, sf_dir), 4)


def learn_walk_forward_totals(spark, sf_dir):
    return _rounded(learning.walk_forward_totals(_folds(spark, sf_dir)), 4)


def match_registry(elo, rates, form, pairs):
    """The three rated models of a pairing under the model contract."""
    names = matches.OUTCOMES
    of = lambda model: lambda asked: matches.outcome_rows(asked, elo, rates, form).where(F.col("model") == model)
    models = registry.Registry(("league", "home", "away"), names)
    for model, version, reason in (("elo", "1.0.0", "too few rated games"), ("rates", "1.0.0", "no fitted rates"), ("form", "1.0.0", "too few games of form")):
        models.register(registry.Model(model, version, names, of(model), reason))
    return models.outputs(pairs)


def sports_model_outputs(spark, sf_dir):
    """What each model says of every two teams of a league, met or not, or why it says nothing."""
    season = fixtures._Season(spark, sf_dir)
    teams = season.views.select("league", "team").distinct()
    pairs = teams.select("league", F.col("team").alias("home")).join(teams.select("league", F.col("team").alias("away")), "league").where("home <> away")
    return _rounded(match_registry(ratings.batch_elo(season.games), ratings.attack_defence(season.games), league_form(season.form()), pairs), 4)


def _observations(spark, sf_dir):
    return _sql(spark, sf_dir, f"WITH {relations.predictions(SPARK)} SELECT key AS domain, p, CASE WHEN key = actual THEN 1e0 ELSE 0e0 END AS y FROM predictions")


def metric_isotonic_fit(spark, sf_dir):
    return _rounded(learning.isotonic_fit(_observations(spark, sf_dir)))


def store_throttle(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"SELECT user_id, event_id, {SPARK.epoch_ms('ts')} AS at FROM events")
    return store.throttled(rows, "user_id", "at")


def store_upsert(spark, sf_dir):
    path, rows = _scratch(spark, "store"), _sql(spark, sf_dir, "SELECT o_custkey AS subject, o_orderstatus AS timeframe, o_orderkey AS id, o_orderdate AS generated_at FROM orders")
    store.append_new(rows.where("id % 2 = 0"), path, ["subject", "timeframe"], "id")
    store.append_new(rows, path, ["subject", "timeframe"], "id")
    store.append_new(rows, path, ["subject", "timeframe"], "id")
    return spark.read.parquet(path)


def store_opportunities(spark, sf_dir):
    """A market is stored first, then the opportunity on (market, outcome, time); saving again adds nothing."""
    rows = _sql(spark, sf_dir, f"WITH {relations.quotes(SPARK)} SELECT market, 'yes' AS outcome, max(updated) AS generated_at, max(p) AS p FROM quotes GROUP BY market")
    markets_at, found_at = _scratch(spark, "markets"), _scratch(spark, "opportunities")
    for batch in (rows.where("market % 3 > 0"), rows, rows):
        store.append_new(batch.select("market"), markets_at, ["market"])
        store.append_new(batch, found_at, ["market", "outcome", "generated_at"])
    return _rounded(spark.read.parquet(found_at).join(spark.read.parquet(markets_at), "market"))


def store_market_links(spark, sf_dir):
    """Links of markets to events, added once each; a confidence outside 0 to 1 or an unknown method is refused."""
    path = _scratch(spark, "market-links")
    rows = _sql(spark, sf_dir, "SELECT concat('event-', l_suppkey % 10) AS event_key, l_partkey AS market, CASE l_linenumber % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'embedding' WHEN 2 THEN 'ticker' ELSE 'guess' END AS method, l_quantity / 45e0 AS confidence FROM lineitem")
    good = rows.where("confidence BETWEEN 0e0 AND 1e0 AND method IN ('manual', 'embedding', 'ticker')").groupBy("event_key", "market").agg(F.min("method").alias("method"), F.max("confidence").alias("confidence"))
    for batch in (good.where("market % 2 = 0"), good, good):
        store.append_new(batch, path, ["event_key", "market"])
    return _rounded(spark.read.parquet(path))


def store_prekickoff(spark, sf_dir):
    """Predictions of scheduled games before their kick-off and not of demonstrations, at least half an hour apart for a subject."""
    rows = _sql(spark, sf_dir, f"SELECT user_id AS subject, event_id, {SPARK.epoch_ms('ts')} AS at FROM events WHERE event_id % 11 <> 0 AND event_type <> 'error' AND event_id % 5 <> 4")
    return store.throttled(rows, "subject", "at")


def latest_prediction_hydrated(spark, sf_dir):
    """Each subject's latest prediction with its outcomes, its models' outputs and its factors, as text."""
    d = SPARK
    outcomes = _sql(spark, sf_dir, f"WITH {relations.predictions(d)} SELECT id, subject, generated_at, ord, key, p, confidence FROM predictions")
    latest = store.latest_of(outcomes.select("subject", "generated_at", "id", "confidence").distinct().withColumn("newest", F.struct("generated_at", "id")), ["subject"], "newest").select("id", "subject", "confidence")
    outputs = _sql(spark, sf_dir, f"WITH {relations.predictions(d)}, {relations.model_outputs(d)} SELECT id, model, ord, key, p, abstained FROM model_outputs")
    factors = _sql(spark, sf_dir, "SELECT l_orderkey AS id, l_linenumber AS line, l_discount - l_tax AS contribution FROM lineitem")
    found = store.hydrated(latest, "id", {"outcomes": (outcomes.select("id", "ord", "key", "p"), ["ord"]), "outputs": (outputs, ["model", "ord"]), "factors": (factors, ["line"])})
    told = lambda xs, f: F.array_join(F.transform(xs, f), " ")
    return found.select(
        "subject", "id", "confidence", told("outcomes", lambda x: F.format_string("%s=%.4f", x["key"], x["p"])).alias("outcomes"),
        told(F.filter("outputs", lambda x: ~x["abstained"]), lambda x: F.format_string("%s:%s=%.4f", x["model"], x["key"], x["p"])).alias("outputs"), F.size(F.filter("outputs", lambda x: x["abstained"])).cast("bigint").alias("abstained"),
        told("factors", lambda x: F.format_string("%d=%.2f", x["line"], x["contribution"])).alias("factors"),
    )


def text_story_clusters(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"WITH {relations.articles(SPARK)} SELECT id, published, {texts.tokens(SPARK, 'title')} AS tokens FROM articles")
    return clusters.story_clusters(rows)


def text_tfidf_cosine(spark, sf_dir):
    vectors = _stored(_sql(spark, sf_dir, f"WITH {texts.weights(SPARK)} SELECT id, w, x FROM vec"), "weights")
    asked = _sql(spark, sf_dir, f"WITH {relations.articles(SPARK)} SELECT id FROM articles WHERE id % 50 = 0")
    return _rounded(neighbours.word_cosines(vectors, vectors.join(asked, "id")))


def embedding_cosine_knn(spark, sf_dir):
    """The five nearest of every fiftieth vector among all."""
    rows = _sql(spark, sf_dir, "SELECT vec_id, embedding FROM embeddings")
    return _rounded(neighbours.nearest(rows, rows.where("vec_id % 50 = 0")).withColumnRenamed("cos", "cosine"))


def _titles(spark, sf_dir):
    """(id, title, tokens) of all titles, dealt over the tasks before they are tokenised, which is done once."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _sql(spark, sf_dir, f"WITH {relations.titles(SPARK)} SELECT id, title FROM titles").repartition(parts, "id")
    return _stored(rows.withColumn("tokens", F.expr(markets.title_tokens(SPARK, "title"))), "titles")


def title_jaccard_links(spark, sf_dir):
    return _rounded(clusters.title_links(_titles(spark, sf_dir), markets.LINK_ABOVE))


def title_link_groups(spark, sf_dir):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_scratch(spark, "links"))
    return clusters.title_groups(_titles(spark, sf_dir), markets.LINK_ABOVE)


def agg_quantile_linear(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT l_returnflag AS key, l_extendedprice AS x FROM lineitem")
    return _rounded(quantiles.linear_quantiles(rows, {"q1": 0.25, "q3": 0.75, "p90": 0.9}).withColumnRenamed("key", "l_returnflag"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_candles(spark, sf_dir):
    out = streams.run_to_table(streams.tumbling_candles(_stream(spark, sf_dir)), _scratch(spark, "candles"))
    return out.select("asset", F.date_format("open_time", "yyyy-MM-dd HH:mm:ss").alias("open_time"), F.round("o", 6).alias("o"), F.round("h", 6).alias("h"), F.round("l", 6).alias("l"), F.round("c", 6).alias("c"), F.round("v", 4).alias("v"), "n")


def stream_deduplicated(spark, sf_dir):
    rows = streams.deduplicated(_stream(spark, sf_dir), ["event_type", "user_id"], "400 days")
    return streams.run_to_table(rows.select("event_type", "user_id"), _scratch(spark, "dedupe"))


def stream_throttled(spark, sf_dir):
    rows = streams.throttled(_stream(spark, sf_dir))
    return streams.run_to_table(rows, _scratch(spark, "throttle")).select("user_id", "event_id")


REGISTERED = (
    ta_ema, ta_rsi, ta_atr, ta_macd_adx_stochrsi, vol_ewma, structure_levels, structure_value_area, structure_breakout, sports_match_ensemble, candle_features, candle_models, candle_predict,
    feature_completeness, vol_atr_regime, vol_forecast, structure_consolidation, orderflow_book_features,
    sports_elo_batch, sports_elo_sum, sports_elo_history, sports_attack_defence, sports_learned_model, sports_model_outputs, learn_walk_forward, learn_walk_forward_totals, metric_isotonic_fit,
    store_throttle, store_upsert, store_opportunities, store_market_links, store_prekickoff, latest_prediction_hydrated, text_story_clusters, text_tfidf_cosine, embedding_cosine_knn, title_jaccard_links, title_link_groups, agg_quantile_linear, stream_candles, stream_deduplicated, stream_throttled,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    d, b = DUCK, relations.bars(DUCK)
    step = "step AS (SELECT asset, rn, c - lag(c) OVER (PARTITION BY asset ORDER BY rn) AS s, greatest(h - l, abs(h - lag(c) OVER (PARTITION BY asset ORDER BY rn)), abs(l - lag(c) OVER (PARTITION BY asset ORDER BY rn))) AS tr FROM bars)"
    wilder = lambda name, x: f"""{name}_src AS (SELECT asset, rn, {x} AS x FROM step WHERE rn >= 2),
{name} AS (SELECT asset, CAST(15 AS BIGINT) AS rn, avg(x) AS e FROM {name}_src WHERE rn <= 15 GROUP BY asset HAVING count(*) = 14
  UNION ALL SELECT s.asset, s.rn, s.x / 14e0 + r.e * 13e0 / 14e0 FROM {name} r JOIN {name}_src s ON s.asset = r.asset AND s.rn = r.rn + 1)"""  # noqa: E731
    # an average over source(asset, rn, x) from row `first` on, seeded with the mean of its first `period` values
    average = lambda name, source, first, period, alpha: f"""{name} AS (SELECT asset, CAST({first + period - 1} AS BIGINT) AS rn, avg(x) AS e FROM {source} WHERE rn BETWEEN {first} AND {first + period - 1} GROUP BY asset HAVING count(*) = {period}
  UNION ALL SELECT s.asset, s.rn, {alpha} * s.x + (1e0 - {alpha}) * r.e FROM {name} r JOIN {source} s ON s.asset = r.asset AND s.rn = r.rn + 1)"""  # noqa: E731
    summed = lambda name, x: f"""{name} AS (SELECT asset, CAST(15 AS BIGINT) AS rn, sum({x}) AS e FROM moves WHERE rn BETWEEN 2 AND 15 GROUP BY asset HAVING count(*) = 14
  UNION ALL SELECT s.asset, s.rn, r.e - r.e / 14e0 + s.{x} FROM {name} r JOIN moves s ON s.asset = r.asset AND s.rn = r.rn + 1)"""  # noqa: E731
    elo = lambda step, home: f"WITH RECURSIVE {fixtures.elo_replay(d, step, home)}"
    title_pairs = f"""WITH RECURSIVE {relations.titles(d)}, named_tokens AS (SELECT id, title, {markets.title_tokens(d, "title")} AS tk FROM titles),
toks AS (SELECT *, min(id) OVER (PARTITION BY tk) AS first FROM named_tokens WHERE len(tk) > 0), sets AS (SELECT DISTINCT first AS id, tk FROM toks), flat AS (SELECT id, len(tk) AS n, unnest(tk) AS w FROM sets),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) / CAST(min(a.n) + min(b.n) - count(*) AS DOUBLE) AS j FROM flat a JOIN flat b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / CAST(min(a.n) + min(b.n) - count(*) AS DOUBLE) > 0.6)"""
    return {
        "ta_ema": f"WITH RECURSIVE {b}, {candles.ema_sql(12, 2 / 13)} SELECT asset, rn, round(e, 6) AS ema12 FROM rec",
        "ta_rsi": f"""WITH RECURSIVE {b}, {step}, {wilder("up", "greatest(s, 0e0)")}, {wilder("down", "greatest(-s, 0e0)")}
SELECT u.asset, u.rn, round(CASE WHEN u.e + d.e = 0e0 THEN 50e0 ELSE 100e0 * u.e / (u.e + d.e) END, 5) AS rsi14 FROM up u JOIN down d ON d.asset = u.asset AND d.rn = u.rn""",
        "ta_macd_adx_stochrsi": f"""WITH RECURSIVE {b}, {step}, closes AS (SELECT asset, rn, c AS x FROM bars), {average("e12", "closes", 1, 12, "(2e0 / 13e0)")}, {average("e26", "closes", 1, 26, "(2e0 / 27e0)")},
line AS (SELECT a.asset, a.rn, a.e - b.e AS x FROM e12 a JOIN e26 b ON b.asset = a.asset AND b.rn = a.rn), {average("sig", "line", 26, 9, "0.2e0")}, {wilder("up", "greatest(s, 0e0)")}, {wilder("down", "greatest(-s, 0e0)")},
rsi AS (SELECT u.asset, u.rn, CASE WHEN u.e + d.e = 0e0 THEN 50e0 ELSE 100e0 * u.e / (u.e + d.e) END AS r FROM up u JOIN down d ON d.asset = u.asset AND d.rn = u.rn),
raw AS (SELECT asset, rn, CASE WHEN count(*) OVER w = 14 THEN CASE WHEN max(r) OVER w > min(r) OVER w THEN 100e0 * (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE 50e0 END END AS x FROM rsi WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 13 PRECEDING)),
k AS (SELECT asset, rn, CASE WHEN count(x) OVER w = 3 THEN avg(x) OVER w END AS x FROM raw WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 2 PRECEDING)), dd AS (SELECT asset, rn, CASE WHEN count(x) OVER w = 3 THEN avg(x) OVER w END AS x FROM k WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 2 PRECEDING)),
diffs AS (SELECT asset, rn, h - lag(h) OVER w AS u, lag(l) OVER w - l AS v, count(*) OVER (PARTITION BY asset) AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY rn)),
moves AS (SELECT d.asset, d.rn, CASE WHEN u > v AND u > 0 THEN u ELSE 0e0 END AS p, CASE WHEN v > u AND v > 0 THEN v ELSE 0e0 END AS q, t.tr AS t FROM diffs d JOIN step t ON t.asset = d.asset AND t.rn = d.rn WHERE d.rn >= 2 AND n >= 28),
{summed("ps", "p")}, {summed("qs", "q")}, {summed("ts", "t")},
di AS (SELECT p.asset, p.rn, CASE WHEN t.e > 0 THEN 100e0 * p.e / t.e ELSE 0e0 END AS plus, CASE WHEN t.e > 0 THEN 100e0 * q.e / t.e ELSE 0e0 END AS minus FROM ps p JOIN qs q ON q.asset = p.asset AND q.rn = p.rn JOIN ts t ON t.asset = p.asset AND t.rn = p.rn),
dx AS (SELECT asset, rn, CASE WHEN plus + minus > 0 THEN 100e0 * abs(plus - minus) / (plus + minus) ELSE 0e0 END AS x FROM di), {average("adx", "dx", 15, 14, "(1e0 / 14e0)")}
SELECT b.asset, b.rn, round(l.x, 6) AS macd, round(g.e, 6) AS macd_signal, round(l.x - g.e, 6) AS macd_histogram, round(k.x, 6) AS stoch_rsi_k, round(dd.x, 6) AS stoch_rsi_d, round(CASE WHEN a.e IS NOT NULL THEN least(100e0, greatest(0e0, a.e)) END, 6) AS adx14, round(di.plus, 6) AS plus_di, round(di.minus, 6) AS minus_di
FROM bars b LEFT JOIN line l USING (asset, rn) LEFT JOIN sig g USING (asset, rn) LEFT JOIN k USING (asset, rn) LEFT JOIN dd USING (asset, rn) LEFT JOIN adx a USING (asset, rn) LEFT JOIN di USING (asset, rn)""",
        "ta_atr": f"WITH RECURSIVE {b}, {step}, {wilder('atr', 'tr')} SELECT asset, rn, round(e, 6) AS atr14 FROM atr",
        "vol_ewma": f"""WITH RECURSIVE {b}, ret AS (SELECT asset, rn, ln(c / lag(c) OVER (PARTITION BY asset ORDER BY rn)) AS r FROM bars),
rec AS (SELECT asset, CAST(2 AS BIGINT) AS rn, r * r AS s FROM ret WHERE rn = 2 UNION ALL SELECT n.asset, n.rn, 0.94e0 * x.s + 0.06e0 * p.r * p.r FROM rec x JOIN ret n ON n.asset = x.asset AND n.rn = x.rn + 1 JOIN ret p ON p.asset = x.asset AND p.rn = x.rn)
SELECT asset, rn, round(sqrt(s), 6) AS ewma_vol FROM rec""",
        "title_jaccard_links": f"""{title_pairs} SELECT a, b, round(j, 6) AS jaccard FROM pairs""",
        "title_link_groups": f"""{title_pairs}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
rooted AS (SELECT t.id, t.title, t.tk, least(t.first, coalesce((SELECT min(other) FROM reach r WHERE r.id = t.first), t.first)) AS root FROM toks t),
named AS (SELECT root, arg_min(title, [length(title), id]) AS event_title, arg_min(tk, [length(title), id]) AS tk FROM rooted GROUP BY root HAVING count(*) > 1)
SELECT r.id, r.root, array_to_string(n.tk, '-') AS event_key, n.event_title FROM rooted r JOIN named n USING (root)""",
        "vol_atr_regime": f"""WITH RECURSIVE {b}, {step}, {wilder("atr", "tr")},
past AS (SELECT a.asset, a.rn, a.e, count(*) AS n, (sum(CASE WHEN b.e < a.e THEN 1e0 ELSE 0e0 END) + sum(CASE WHEN b.e = a.e THEN 0.5e0 ELSE 0e0 END)) / count(*) AS rank, median(b.e) AS middle
  FROM atr a JOIN atr b ON b.asset = a.asset AND b.rn BETWEEN a.rn - 99 AND a.rn GROUP BY a.asset, a.rn, a.e),
graded AS (SELECT *, CASE WHEN rank < 0.25e0 THEN 0 WHEN rank < 0.7e0 THEN 1 WHEN rank < 0.9e0 THEN 2 ELSE 3 END + CASE WHEN n >= 5 AND middle > 0 AND e / middle >= 1.75e0 THEN 1 ELSE 0 END AS level FROM past WHERE n >= 2)
SELECT asset, rn, round(rank, 6) AS atr_percentile, ['low', 'normal', 'elevated', 'extreme'][least(level, 3) + 1] AS vol_regime FROM graded""",
        "structure_value_area": f"""WITH RECURSIVE bins AS ({candles.plans(d)["structure_volume_bins"]}), v AS (SELECT asset, list(volume ORDER BY bin) AS v FROM bins GROUP BY asset),
grow AS (SELECT asset, v, list_sum(v) AS total, list_position(v, list_max(v)) AS poc, list_position(v, list_max(v)) AS lo, list_position(v, list_max(v)) AS hi, list_max(v) AS held FROM v
  UNION ALL SELECT asset, v, total, poc, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, held + CASE WHEN up THEN v[hi + 1] ELSE v[lo - 1] END
  FROM (SELECT *, hi < len(v) AND (lo = 1 OR v[hi + 1] >= v[lo - 1]) AS up FROM grow WHERE held < 0.7e0 * total AND (lo > 1 OR hi < len(v))))
SELECT asset, CAST(min(poc) - 1 AS BIGINT) AS poc_bin, CAST(min(lo) - 1 AS BIGINT) AS low_bin, CAST(max(hi) - 1 AS BIGINT) AS high_bin, round(max(held) / max(total), 6) AS share FROM grow GROUP BY asset""",
        "vol_forecast": f"""WITH RECURSIVE {b}, ret AS (SELECT asset, rn, ln(c / lag(c) OVER (PARTITION BY asset ORDER BY rn)) AS r FROM bars),
rec AS (SELECT asset, CAST(2 AS BIGINT) AS rn, r * r AS s FROM ret WHERE rn = 2 UNION ALL SELECT n.asset, n.rn, 0.94e0 * x.s + 0.06e0 * p.r * p.r FROM rec x JOIN ret n ON n.asset = x.asset AND n.rn = x.rn + 1 JOIN ret p ON p.asset = x.asset AND p.rn = x.rn),
e AS (SELECT asset, sqrt(arg_max(s, rn)) AS ewma FROM rec GROUP BY asset), size AS (SELECT asset, count(*) AS n FROM bars GROUP BY asset HAVING count(*) >= 30),
g AS (SELECT b.asset, s.n, sqrt(greatest(0, avg(0.5e0 * power(ln(h / l), 2) - (2e0 * ln(2e0) - 1e0) * power(ln(c / o), 2)))) AS gk FROM bars b JOIN size s ON s.asset = b.asset
  WHERE b.rn > s.n - least(20, greatest(2, s.n // 3)) GROUP BY b.asset, s.n),
f AS (SELECT g.asset, h.horizon, (0.6e0 * ewma + 0.4e0 * gk) * sqrt(h.horizon) AS move, (0.55e0 * CASE WHEN greatest(ewma, gk) = 0 THEN 1e0 ELSE least(ewma, gk) / greatest(ewma, gk) END + 0.45e0 * least(1e0, n / 200e0)) / (1e0 + ln(1e0 + h.horizon) / 6e0) AS conf
  FROM g JOIN e USING (asset) CROSS JOIN (VALUES (1), (24)) AS h(horizon))
SELECT asset, round(move, 6) AS expected_move, round(-1.645e0 * move, 6) AS range_low, round(1.645e0 * move, 6) AS range_high, round(conf, 6) AS vol_confidence, CAST(horizon AS BIGINT) AS horizon FROM f""",
        "structure_consolidation": f"""WITH {b}, x AS (SELECT asset, rn, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr, h, l, c, count(*) OVER (PARTITION BY asset) AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY rn)),
last AS (SELECT asset, n, sum(tr) AS path, max(h) - min(l) AS span FROM x WHERE rn > n - 20 AND n >= 22 GROUP BY asset, n),
band AS (SELECT asset, rn, CASE WHEN count(*) OVER w = 20 AND avg(c) OVER w > 0 THEN 4e0 * stddev_pop(c) OVER w / avg(c) OVER w END AS bw FROM x WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
now AS (SELECT asset, arg_max(bw, rn) AS bw FROM band GROUP BY asset), rank AS (SELECT b.asset, count(*) AS n, sum(CASE WHEN b.bw < w.bw THEN 1e0 WHEN b.bw = w.bw THEN 0.5e0 ELSE 0e0 END) / count(*) AS r FROM band b JOIN now w USING (asset) WHERE b.bw IS NOT NULL GROUP BY b.asset),
p AS (SELECT l.asset, CASE WHEN span <= 0 THEN 1e0 ELSE least(1e0, greatest(0e0, (path / span - 1e0) / 3e0)) END AS part, r.n, r.r FROM last l LEFT JOIN rank r USING (asset))
SELECT asset, round(0.5e0 * part + 0.5e0 * CASE WHEN coalesce(n, 0) < 3 THEN part ELSE 1e0 - r END, 6) AS consolidation FROM p""",
        "orderflow_book_features": f"""WITH {relations.asset_books(d)}, m AS (SELECT asset, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid, min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid') AS gap FROM asset_books GROUP BY asset),
x AS (SELECT b.*, m.mid, m.gap / m.mid * 10000 AS bps, abs(price - mid) / mid AS dist FROM asset_books b JOIN m USING (asset)),
s AS (SELECT asset, coalesce(sum(qty) FILTER (side = 'bid' AND dist <= 0.005), 0) AS b0, coalesce(sum(qty) FILTER (side = 'ask' AND dist <= 0.005), 0) AS a0, coalesce(sum(qty) FILTER (side = 'bid' AND dist <= 0.01), 0) AS b1, coalesce(sum(qty) FILTER (side = 'ask' AND dist <= 0.01), 0) AS a1,
  max(bps) AS bps, count(*) FILTER (dist <= 0.01 AND qty > 0) AS n, max(qty) FILTER (dist <= 0.01) AS largest FROM x GROUP BY asset),
med AS (SELECT asset, side, median(qty) AS med FROM x WHERE dist <= 0.05 AND qty > 0 GROUP BY asset, side HAVING count(*) >= 5),
w AS (SELECT x.asset, x.side, qty / med AS multiple, dist, row_number() OVER (PARTITION BY x.asset, x.side ORDER BY dist, price) AS r FROM x JOIN med USING (asset, side) WHERE dist <= 0.05 AND qty >= 5 * med)
SELECT s.asset, round(CASE WHEN b0 + a0 = 0 THEN 0 ELSE (b0 - a0) / (b0 + a0) END, 6) AS book_imbalance,
  round(CASE WHEN b1 > 0 AND a1 > 0 THEN 0.35 * exp(-bps / 10) + 0.3 * least(1, n / 40) + 0.2 * (1 - abs(b1 - a1) / (b1 + a1)) + 0.15 * (1 - largest / (b1 + a1)) ELSE 0 END, 6) AS book_depth,
  round(wb.multiple, 6) AS bid_wall, round(wb.dist, 6) AS bid_wall_distance, round(wa.multiple, 6) AS ask_wall, round(wa.dist, 6) AS ask_wall_distance
FROM s LEFT JOIN w wb ON wb.asset = s.asset AND wb.side = 'bid' AND wb.r = 1 LEFT JOIN w wa ON wa.asset = s.asset AND wa.side = 'ask' AND wa.r = 1""",
        "sports_elo_batch": f"""{elo(fixtures.CONSTANT, "60e0")}
SELECT league, CAST(team AS INT) AS team, round(rating, 4) AS rating, games FROM (SELECT league, unnest(range(0, 25)) AS team, unnest(r) AS rating, unnest(n) AS games FROM (SELECT league, arg_max(r, k) AS r, arg_max(n, k) AS n FROM rec GROUP BY league)) WHERE games > 0""",
        "sports_elo_history": f"""{elo(fixtures.ADAPTIVE, "65e0")}
SELECT league, game_id, home AS team, round(a, 4) AS "before", round(a + step, 4) AS "after" FROM rec WHERE k > 0 UNION ALL SELECT league, game_id, away, round(b, 4), round(b - step, 4) FROM rec WHERE k > 0""",
        "sports_elo_sum": f"""WITH {relations.games(d)}, t AS (SELECT league, home AS team FROM games UNION ALL SELECT league, away FROM games)
SELECT league, 1500e0 * count(DISTINCT team) AS total, count(DISTINCT team) AS teams, count(*) AS sides FROM t GROUP BY league""",
        "latest_prediction_hydrated": f"""WITH {relations.predictions(d)}, {relations.model_outputs(d)}, last AS (SELECT subject, arg_max(id, [epoch_us(generated_at), id]) AS id FROM predictions GROUP BY subject),
o AS (SELECT id, max(confidence) AS confidence, string_agg(printf('%s=%.4f', key, p), ' ' ORDER BY ord) AS outcomes FROM predictions GROUP BY id),
m AS (SELECT id, coalesce(string_agg(printf('%s:%s=%.4f', model, key, p), ' ' ORDER BY model, ord) FILTER (NOT abstained), '') AS outputs, count(*) FILTER (abstained) AS abstained FROM model_outputs GROUP BY id),
f AS (SELECT l_orderkey AS id, string_agg(printf('%d=%.2f', l_linenumber, l_discount - l_tax), ' ' ORDER BY l_linenumber, l_discount - l_tax) AS factors FROM lineitem GROUP BY l_orderkey)
SELECT subject, id, confidence, outcomes, coalesce(outputs, '') AS outputs, coalesce(abstained, 0) AS abstained, coalesce(factors, '') AS factors FROM last JOIN o USING (id) LEFT JOIN m USING (id) LEFT JOIN f USING (id)""",
        "store_upsert": """WITH r AS (SELECT o_custkey AS subject, o_orderstatus AS timeframe, o_orderkey AS id, o_orderdate AS generated_at, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey DESC) AS n FROM orders)
SELECT subject, timeframe, id, generated_at FROM r WHERE n = 1""",
        "store_opportunities": f"WITH {relations.quotes(d)} SELECT market, 'yes' AS outcome, max(updated) AS generated_at, round(max(p), 6) AS p FROM quotes GROUP BY market",
        "store_market_links": """SELECT 'event-' || (l_suppkey % 10) AS event_key, l_partkey AS market, min(CASE l_linenumber % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'embedding' ELSE 'ticker' END) AS method, round(max(l_quantity / 45e0), 6) AS confidence
FROM lineitem WHERE l_linenumber % 4 <> 3 AND l_quantity BETWEEN 0 AND 45 GROUP BY 1, 2""",
        "store_prekickoff": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_id % 11 <> 0 AND event_type <> 'error' AND event_id % 5 <> 4),
pass AS (SELECT user_id, event_id, t, k, t AS last, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN e.t - p.last >= 1800000 THEN e.t ELSE p.last END, e.t - p.last >= 1800000 FROM pass p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT user_id AS subject, event_id, t AS "at" FROM pass WHERE kept""",
        "store_throttle": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
pass AS (SELECT user_id, event_id, t, k, t AS last, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN e.t - p.last >= 1800000 THEN e.t ELSE p.last END, e.t - p.last >= 1800000 FROM pass p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT user_id, event_id, t AS "at" FROM pass WHERE kept""",
        "stream_deduplicated": "SELECT DISTINCT event_type, user_id FROM events",
    }
