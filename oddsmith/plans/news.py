"""News plans over all documents. Spark runs operators/news.py; the oracles are relational SQL of their own, a row per word and mention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions import lexicons as L
from oddsmith.functions.dialect import DUCK, SPARK
from oddsmith.operators import clusters, news
from oddsmith.plans import relations as R
from oddsmith.plans import text as texts


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oddsmith.plans.catalog import register

    text = f"WITH {R.headlines(SPARK)} SELECT id, published, source, class, category, lead, title, cluster, {texts.tokens(SPARK, 'title')} AS tokens FROM headlines"
    register(spark, sf_dir, text)
    return spark.sql(text)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.entity_rows(_headlines(spark, sf_dir))


def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_headlines(spark, sf_dir).select("id", news.article_sentiment(F.col("title")).alias("s")).select("id", "s.score", "s.hits", "s.confidence"))


def text_entity_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(news.entity_sentiment(_headlines(spark, sf_dir)))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headlines(spark, sf_dir)
    as_of = rows.agg(F.coalesce(F.max("published"), F.lit(0))).first()[0]
    return news.story_importance(rows, news.unit_vectors(rows), news.entity_rows(rows), as_of)


def text_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_importance(spark, sf_dir).select("cluster", "importance", "unverified", "novelty"))


def text_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_importance(spark, sf_dir).select("cluster", "breaking", F.col("per_hour").alias("velocity")))


def text_board_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred stories: breaking ones, then by importance, then the latest; headline of the best source, then the earliest."""
    rows = _headlines(spark, sf_dir)
    quality = F.coalesce(news._lookup(news.RELIABILITY, F.col("class")), F.lit(0.15))
    best = rows.groupBy("cluster").agg(F.min_by("title", F.struct(-quality, "published", "id")).alias("headline"), F.max("published").alias("latest"), F.count(F.lit(1)).alias("n"))
    top = _importance(spark, sf_dir).join(best, "cluster").orderBy(F.desc("breaking"), F.desc("importance"), F.desc("latest"), "cluster").limit(100)
    return top.select("cluster", "headline", "importance", "breaking", "n")


def briefing_moving_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four first verified stories - breaking ones, then by importance - each with its three most mentioned entities."""
    rows = _headlines(spark, sf_dir)
    named = news.entity_rows(rows).join(rows.select("id", "cluster"), "id").groupBy("cluster", "entity").agg(F.sum("n").alias("n"))
    most = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "entity"))), 1, 3)["entity"]
    top = _importance(spark, sf_dir).where("not unverified").orderBy(F.desc("breaking"), F.desc("importance"), "cluster").limit(4)
    return top.join(named.groupBy("cluster").agg(F.array_join(most, ", ").alias("about")), "cluster", "left").select("cluster", "importance", "breaking", "about")


def text_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.story_summaries(_headlines(spark, sf_dir))


def text_cluster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headlines(spark, sf_dir)
    return _rounded(news.story_entities(rows, news.entity_rows(rows), news.entity_sentiment(rows)))


def text_story_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of the stories that the headlines themselves form."""
    rows = _headlines(spark, sf_dir)
    members = clusters.story_clusters(rows.select("id", "published", "tokens"))
    return _rounded(news.story_entities(members, news.entity_rows(rows), news.entity_sentiment(rows)))


REGISTERED = (text_cluster_summary, text_cluster_entities, text_story_entities, briefing_moving_news, text_entities, text_sentiment, text_entity_sentiment, text_importance, text_breaking, text_board_order)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    word = "[a-z0-9]+(?:[''’][a-z]+)?"
    pattern = lambda alias, cased: ("" if cased else "(?i)") + rf"\b{alias.replace('.', '[.]')}" + ("(?:[^a-zA-Z0-9]|$)" if alias[-1] == "." else r"\b")
    aliases = [(entity, kind, pattern(alias, cased)) for entity, kind, alias, cased in L.aliases()]
    base = f"""WITH {R.headlines(DUCK)},
names(entity, kind, pattern) AS ({_values(aliases)}), lexicon(word, weight) AS ({_values(L.sentiment_words())}), negators(word) AS ({_values([(w,) for w in L.NEGATORS])}),
stretch(word, factor) AS ({_values(list(L.INTENSIFIERS.items()))}), quality(class, q) AS ({_values(list(news.RELIABILITY.items()))}),
named AS (SELECT h.id, h.title, n.entity, n.kind, string_split_regex(h.title, n.pattern) AS gaps, regexp_extract_all(h.title, n.pattern) AS own FROM headlines h JOIN names n ON regexp_matches(h.title, n.pattern)),
mentions AS (SELECT DISTINCT id, title, entity, kind, CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(own[:i - 1], lambda m: length(m))), 0) AS BIGINT) AS place
  FROM (SELECT *, unnest(generate_series(1, len(own))) AS i FROM named)),
entities AS (SELECT id, entity, kind, count(*) AS n FROM mentions GROUP BY id, entity, kind),
words AS (SELECT id, generate_subscripts(t, 1) - 1 AS pos, replace(unnest(t), '’', '''') AS word FROM (SELECT id, regexp_extract_all(lower(title), '{word}') AS t FROM headlines)),"""
    # a range of words to score: (id, part, first, last); hits of a range look back no further than its first word
    scored = """hit AS (SELECT r.id, r.part, r.first, w.pos, l.weight FROM ranges r JOIN words w ON w.id = r.id AND w.pos BETWEEN r.first AND r.last JOIN lexicon l ON l.word = w.word),
flip AS (SELECT DISTINCT h.id, h.part, h.pos FROM hit h JOIN words w ON w.id = h.id AND w.pos BETWEEN greatest(h.first, h.pos - 3) AND h.pos - 1 JOIN negators n ON n.word = w.word),
boost AS (SELECT h.id, h.part, h.pos, arg_max(s.factor, w.pos) AS factor FROM hit h JOIN words w ON w.id = h.id AND w.pos BETWEEN greatest(h.first, h.pos - 2) AND h.pos - 1 JOIN stretch s ON s.word = w.word GROUP BY ALL),
adjusted AS (SELECT h.id, h.part, h.weight * CASE WHEN f.pos IS NULL THEN 1e0 ELSE -1e0 END * coalesce(b.factor, 1e0) AS x FROM hit h
  LEFT JOIN flip f ON f.id = h.id AND f.part = h.part AND f.pos = h.pos LEFT JOIN boost b ON b.id = h.id AND b.part = h.part AND b.pos = h.pos)"""
    score = "CAST(CASE WHEN count(a.x) = 0 THEN 0 ELSE greatest(-100, least(100, floor(avg(a.x) * 25e0 + 0.5e0))) END AS BIGINT) AS score, count(a.x) AS hits, round(least(0.95e0, count(a.x) / (count(a.x) + 3e0)), 6) AS confidence"
    around = f"""seen AS (SELECT DISTINCT id, entity, greatest(0, len(regexp_extract_all(lower(substr(title, 1, place + 1)), '{word}')) - 1) AS i FROM mentions),
starts AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY id, entity ORDER BY i) <= 25 THEN 0 ELSE 1 END AS new FROM seen),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id, entity ORDER BY i) AS g FROM starts),
ranges AS (SELECT id, entity || '#' || CAST(g AS VARCHAR) AS part, entity, greatest(0, min(i) - 12) AS first, max(i) + 12 AS last FROM numbered GROUP BY id, entity, g)"""
    types = _values(list(news.TYPE_WEIGHT.items()))
    single = _values(list(news.ENTITY_WEIGHT.items()))
    priors = _values(list(news.CATEGORY_PRIOR.items()))
    stories = f"""types(kind, w) AS ({types}), single(entity, w) AS ({single}), priors(category, p) AS ({priors}),
tok AS (SELECT id, cluster, unnest({texts.tokens(DUCK, "title")}) AS w FROM headlines), tf AS (SELECT cluster, id, w, count(*) AS n FROM tok GROUP BY ALL),
idf AS (SELECT w, ln(((SELECT count(*) FROM headlines) + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM tf GROUP BY w),
doc AS (SELECT tf.cluster, tf.id, tf.w, tf.n * idf.idf AS x FROM tf JOIN idf USING (w)), len AS (SELECT id, sqrt(sum(x * x)) AS s FROM doc GROUP BY id),
cen AS (SELECT cluster, w, sum(x / s) AS x FROM doc JOIN len USING (id) GROUP BY cluster, w), clen AS (SELECT cluster, sqrt(sum(x * x)) AS s FROM cen GROUP BY cluster),
unit AS (SELECT cluster, w, x / s AS x FROM cen JOIN clen USING (cluster)),
story AS (SELECT cluster, avg(coalesce(q, 0.15e0)) AS rel, max(coalesce(q, 0.15e0)) AS best, count(DISTINCT source) AS sources, min(published) AS began, max(published) AS latest, count(*) AS n,
  arg_min(category, published * 1000000 + id) AS category, arg_min(title, [-coalesce(q, 0.15e0), published, id]) AS headline FROM headlines LEFT JOIN quality USING (class) GROUP BY cluster),
ent AS (SELECT cluster, entity, kind, sum(n) AS n FROM entities JOIN (SELECT id, cluster FROM headlines) USING (id) GROUP BY ALL),
best_ent AS (SELECT cluster, max(coalesce(s.w, t.w) * CASE WHEN n >= 2 THEN 1e0 ELSE 0.8e0 END) AS w FROM ent LEFT JOIN single s USING (entity) LEFT JOIN types t USING (kind) GROUP BY cluster),
sim AS (SELECT a.cluster, b.cluster AS other, sum(a.x * b.x) AS c FROM unit a JOIN story sa ON sa.cluster = a.cluster JOIN unit b ON b.w = a.w JOIN story sb ON sb.cluster = b.cluster
  WHERE sb.began < sa.began AND sa.began - sb.began <= 172800000 GROUP BY ALL), nearest AS (SELECT cluster, max(c) AS c FROM sim GROUP BY cluster),
graded AS (SELECT s.*, s.best <= 0.35e0 AS unverified, 1e0 - least(1e0, coalesce(c, 0e0)) AS novelty, sources / greatest(1e0, ((SELECT max(published) FROM headlines) - began) / 3600000e0) AS per_hour,
  (SELECT max(published) FROM headlines) - began AS age, coalesce(e.w, 0e0) AS ent, coalesce(p.p, 0.6e0) AS prior FROM story s LEFT JOIN best_ent e USING (cluster) LEFT JOIN nearest USING (cluster) LEFT JOIN priors p USING (category)),
ranked AS (SELECT *, CAST(least(CASE WHEN unverified THEN 35 ELSE 100 END, floor(100e0 * greatest(0e0, least(1e0, 0.2e0 * rel + 0.24e0 * least(1e0, log2(sources) / 3e0) + 0.2e0 * ent + 0.1e0 * prior + 0.12e0 * novelty
  + 0.14e0 * least(1e0, per_hour / 3e0))) + 0.5e0)) AS BIGINT) AS importance, NOT unverified AND per_hour >= 1.5e0 AND age < 21600000 AND sources >= 3 AS breaking FROM graded)"""
    return {
        "text_entities": f"{base} done AS (SELECT 1) SELECT id, entity, kind, n FROM entities",
        "text_sentiment": f"{base} ranges AS (SELECT id, 'all' AS part, 0 AS first, 1000000 AS last FROM headlines), {scored} SELECT h.id, {score} FROM headlines h LEFT JOIN adjusted a ON a.id = h.id GROUP BY h.id",
        "text_entity_sentiment": f"{base} {around}, {scored} SELECT r.id, r.entity, {score} FROM ranges r LEFT JOIN adjusted a ON a.id = r.id AND a.part = r.part GROUP BY r.id, r.entity",
        "text_cluster_entities": f"""{base} {around}, {scored}, felt AS (SELECT r.id, r.entity, {score} FROM ranges r LEFT JOIN adjusted a ON a.id = r.id AND a.part = r.part GROUP BY r.id, r.entity),
both_of AS (SELECT h.cluster, e.entity, sum(e.n) AS mentions, sum(f.score * f.hits) AS weighted, sum(f.hits) AS hits FROM entities e JOIN headlines h USING (id) LEFT JOIN felt f ON f.id = e.id AND f.entity = e.entity GROUP BY h.cluster, e.entity)
SELECT cluster, entity, CAST(mentions AS BIGINT) AS mentions, CAST(CASE WHEN coalesce(hits, 0) = 0 THEN 0 ELSE greatest(-100, least(100, floor(weighted / hits + 0.5e0))) END AS BIGINT) AS score, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(least(0.95e0, hits / (hits + 3e0)), 0), 6) AS confidence FROM both_of""",
        "text_cluster_summary": f"""WITH {R.headlines(DUCK)}, r AS (SELECT *, coalesce(list_position({list(news.RELIABILITY)!r}, class), 7) AS rank FROM headlines),
mixed AS (SELECT cluster, string_agg(rank || ':' || n, ' ' ORDER BY rank) AS mix FROM (SELECT cluster, rank, count(*) AS n FROM r GROUP BY ALL) GROUP BY cluster)
SELECT r.cluster, count(*) AS articles, count(DISTINCT source) AS sources, arg_min(class, rank) AS best_class, arg_min(id, [rank, published, id]) AS headline, min(published) AS first_seen, max(published) AS latest, any_value(mix) AS mix FROM r JOIN mixed USING (cluster) GROUP BY r.cluster""",
        "text_importance": f"{base} {stories} SELECT cluster, importance, unverified, round(novelty, 6) AS novelty FROM ranked",
        "text_breaking": f"{base} {stories} SELECT cluster, breaking, round(per_hour, 6) AS velocity FROM ranked",
        "briefing_moving_news": f"""{base} {stories}, top AS (SELECT cluster, importance, breaking FROM ranked WHERE NOT unverified ORDER BY breaking DESC, importance DESC, cluster LIMIT 4),
named3 AS (SELECT cluster, entity, sum(n) AS n, row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, entity) AS r FROM ent GROUP BY cluster, entity)
SELECT t.cluster, t.importance, t.breaking, string_agg(entity, ', ' ORDER BY r) AS about FROM top t LEFT JOIN named3 e ON e.cluster = t.cluster AND r <= 3 GROUP BY ALL""",
        "text_board_order": f"{base} {stories} SELECT cluster, headline, importance, breaking, n FROM ranked ORDER BY breaking DESC, importance DESC, latest DESC, cluster LIMIT 100",
    }
