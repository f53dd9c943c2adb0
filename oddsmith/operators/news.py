"""News over DataFrames: entities by dictionary, sentiment with negation, and the importance of stories.

Everything is built-in expressions: an article's matches and scores come from one projection, without a row per word.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import lexicons as L

#: Words before a hit that may flip it, and that may stretch it; words around a mention that count for it.
NEGATION, INTENSIFIER, AROUND = 3, 2, 12
#: Importance of an entity by type, and by itself.
TYPE_WEIGHT = {"macro": 1.0, "asset": 0.8, "org": 0.7, "company": 0.7, "country": 0.65, "topic": 0.55, "league": 0.45, "team": 0.35}
ENTITY_WEIGHT = {"fed": 1.0, "cpi": 0.95, "interest-rates": 0.95, "sec": 0.9, "btc": 0.9, "eth": 0.85, "tariffs": 0.9, "recession": 0.9, "nvidia": 0.85}
#: Quality of a class of sources, from the best; prior of a category and of any other.
RELIABILITY = {"OFFICIAL": 1.0, "PRIMARY_SOURCE": 0.97, "HIGH_RELIABILITY": 0.92, "ESTABLISHED_MEDIA": 0.85, "SECONDARY": 0.65, "SOCIAL": 0.35, "UNVERIFIED": 0.15}
CATEGORY_PRIOR = {"markets": 0.9, "business": 0.85, "crypto": 0.85, "world": 0.8, "tech": 0.7, "sports": 0.55}
OTHER_CATEGORY = 0.6
#: Weights of the parts of importance; what makes a story breaking; the cap of unverified stories.
WEIGHTS = {"reliability": 0.2, "sources": 0.24, "entity": 0.2, "category": 0.1, "novelty": 0.12, "velocity": 0.14}
BREAKING_PER_HOUR, BREAKING_HOURS, BREAKING_SOURCES, UNVERIFIED_CAP = 1.5, 6, 3, 35
HOUR_MS = 3_600_000
WINDOW_MS = 48 * HOUR_MS


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def _lookup(values: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def words(text: Column) -> Column:
    """Lower-case words with stopwords and contractions."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(?:['’][a-z]+)?)"), 1), lambda w: F.regexp_replace(w, "’", "'"))


def _hit(tokens: Column, i: Column, low: Column) -> Column:
    """The weight of word i (from 0), flipped by a negator and stretched by the nearest modifier not before word `low`; null for other words."""
    weight = _lookup(dict(L.sentiment_words()), F.get(tokens, i))
    before = lambda n: F.slice(tokens, F.greatest(low, i - n) + 1, i - F.greatest(low, i - n))
    flipped = F.arrays_overlap(before(NEGATION), F.array(*map(F.lit, L.NEGATORS)))
    stretch = F.element_at(F.concat(F.array(F.lit(1.0)), F.filter(F.transform(before(INTENSIFIER), lambda w: _lookup(L.INTENSIFIERS, w)), lambda x: x.isNotNull())), -1)
    return weight * F.when(flipped, -1.0).otherwise(1.0) * stretch


def _sureness(hits: Column) -> Column:
    """Of a score by its number of hits."""
    return F.least(F.lit(0.95), hits / (hits + 3))


def _scored(hits: Column) -> Column:
    """(score, hits, confidence) of an array of adjusted weights."""
    n = F.size(hits)
    mean = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / n
    score = F.when(n > 0, F.greatest(F.lit(-100), F.least(F.lit(100), js_round(mean * 25)))).otherwise(0)
    return F.struct(score.cast("bigint").alias("score"), n.cast("bigint").alias("hits"), _sureness(n).alias("confidence"))


def _indexes(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def article_sentiment(text: Column) -> Column:
    """Struct (score, hits, confidence) of a whole text; a null text has no hits."""
    tokens = words(F.coalesce(text, F.lit("")))
    hits = F.filter(F.transform(_indexes(F.lit(0), F.size(tokens) - 1), lambda i: _hit(tokens, i, F.lit(0))), lambda x: x.isNotNull())
    return _scored(hits)


def with_entities(articles: DataFrame, text: str = "title") -> DataFrame:
    """articles and `found`, an array of (entity, kind, n, offsets) of the entities that the text names; characters from 0.

    A mention that two names of one entity share counts once. Null texts name nothing.
    """
    by: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for entity, kind, alias, cased in L.aliases():
        by.setdefault((entity, kind), []).append((alias.lower(), L.alias_pattern(alias) if cased else f"(?i){L.alias_pattern(alias)}"))

    def offsets(pattern: Column) -> Column:
        sizes = lambda parts: F.transform(parts, F.length)
        gaps, own = sizes(F.split("__given", pattern, -1)), sizes(F.regexp_extract_all("__given", pattern, F.lit(0)))
        start = lambda i: F.aggregate(F.concat(F.slice(gaps, F.lit(1), i), F.slice(own, F.lit(1), i - 1)), F.lit(0), lambda a, x: a + x)
        return F.transform(_indexes(F.lit(1), F.size(own)), start)

    # a search for the names' own characters is cheap and leaves few entities, whose patterns then decide
    rows = articles.withColumn("__given", F.coalesce(F.col(text), F.lit(""))).withColumn("__low", F.lower("__given"))
    near = F.array_compact(F.array(*(
        F.when(reduce(or_, (F.col("__low").contains(literal) for literal, _ in own)), F.struct(F.lit(entity).alias("entity"), F.lit(kind).alias("kind"), F.array(*(F.lit(p) for _, p in own)).alias("patterns")))
        for (entity, kind), own in by.items()
    )))
    places = lambda e: F.array_sort(F.array_distinct(F.flatten(F.transform(e["patterns"], offsets))))
    placed = F.transform(near, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), places(e).alias("offsets")))
    found = F.transform(F.filter(placed, lambda e: F.size(e["offsets"]) > 0), lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), F.size(e["offsets"]).cast("bigint").alias("n"), e["offsets"].alias("offsets")))
    return rows.withColumn("found", found).drop("__given", "__low")


def _each_found(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each entity of `found`, as e.

    By the outer form: the plain one puts a filter on `found` before itself, which is pushed below the projections that
    hold the text, so that the text would be derived anew for every name.
    """
    return rows.select(*columns, F.explode_outer("found").alias("e")).where("e is not null")


def entity_rows(articles: DataFrame, text: str = "title") -> DataFrame:
    """(id, entity, kind, n): the most mentioned first within an article is for the reader to order."""
    return _each_found(with_entities(articles, text), "id").select("id", "e.entity", "e.kind", "e.n")


def entity_sentiment(articles: DataFrame, text: str = "title") -> DataFrame:
    """(id, entity, score, hits, confidence): weights of words within AROUND words of a mention; overlapping surroundings count once."""
    rows = with_entities(articles, text).select("id", words(F.coalesce(F.col(text), F.lit(""))).alias("tokens"), F.col(text).alias("text"), "found")
    rows = _each_found(rows, "id", "tokens", "text")
    # the word that a mention begins in, or the one before it: the words of the text up to and with the mention's first character, less one
    at = F.transform("e.offsets", lambda o: F.greatest(F.lit(0), F.size(words(F.substring(F.col("text"), F.lit(1), o + 1))) - 1))
    joined = lambda a, i: F.when(
        (F.size(a) > 0) & (i - AROUND <= F.element_at(a, -1)["to"] + 1),
        F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["from"].alias("from"), F.greatest(F.element_at(a, -1)["to"], i + AROUND).alias("to")))),
    ).otherwise(F.concat(a, F.array(F.struct((i - AROUND).alias("from"), (i + AROUND).alias("to")))))
    rows = rows.select("id", "e.entity", "tokens", F.aggregate(at, F.array().cast("array<struct<from:int,to:int>>"), joined).alias("ranges"))
    last = F.size("tokens") - 1
    inside = F.flatten(F.transform("ranges", lambda r: F.transform(_indexes(F.greatest(F.lit(0), r["from"]), F.least(last, r["to"])), lambda i: _hit(F.col("tokens"), i, F.greatest(F.lit(0), r["from"])))))
    return rows.select("id", "entity", _scored(F.filter(inside, lambda x: x.isNotNull())).alias("s")).select("id", "entity", "s.score", "s.hits", "s.confidence")


def story_entities(members: DataFrame, entities: DataFrame, sentiments: DataFrame) -> DataFrame:
    """(cluster, entity, mentions, score, hits, confidence) of the stories of members(id, cluster): mentions summed, sentiment as a mean weighted by hits.

    entities(id, entity, n) and sentiments(id, entity, score, hits) are those of the articles; an entity without hits is neutral.
    """
    of = members.select("id", "cluster")
    named = entities.join(of, "id").groupBy("cluster", "entity").agg(F.sum("n").alias("mentions"))
    felt = sentiments.where("hits > 0").join(of, "id").groupBy("cluster", "entity").agg(F.sum(F.col("score") * F.col("hits")).alias("weighted"), F.sum("hits").alias("hits"))
    rows = named.join(felt, ["cluster", "entity"], "left")
    felt = F.col("hits") > 0
    score = F.when(felt, F.greatest(F.lit(-100), F.least(F.lit(100), js_round(F.col("weighted") / F.col("hits"))))).otherwise(0)
    return rows.select(
        "cluster", "entity", "mentions", score.cast("bigint").alias("score"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.when(felt, _sureness(F.col("hits"))).otherwise(0.0).alias("confidence")
    )


def story_summaries(members: DataFrame) -> DataFrame:
    """(cluster, articles, sources, best_class, headline, first_seen, latest, mix) of members(id, cluster, source, class, published, title).

    best_class is the most reliable of the members', and the headline that of its earliest article; mix counts members by class.
    """
    order = F.array(*map(F.lit, RELIABILITY))  # from the best
    place = F.coalesce(F.array_position(order, F.col("class")), F.lit(0))
    rows = members.withColumn("rank", F.when(place == 0, len(RELIABILITY)).otherwise(place))
    mix = rows.groupBy("cluster", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: F.format_string("%d:%d", x["rank"], x["n"])), " ").alias("mix"))
    found = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources"), F.min("rank").alias("best"), F.min_by("id", F.struct("rank", "published", "id")).alias("headline"),
        F.min("published").alias("first_seen"), F.max("published").alias("latest"),
    )
    return found.join(mix, "cluster").select("cluster", "articles", "sources", F.element_at(order, F.col("best").cast("int")).alias("best_class"), "headline", "first_seen", "latest", "mix")


def story_importance(members: DataFrame, vectors: DataFrame, entities: DataFrame, as_of: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """(cluster, importance, breaking, unverified, per_hour, novelty) of each story at the instant as_of, in milliseconds.

    members(cluster, id, published, source, class, category), vectors(cluster, w, x) with unit centroids, entities(id,
    entity, kind, n). Novelty is one less the highest cosine to a story that began before, at most window_ms before: the
    comparison is bucketed by the window and by shared words. Unknown classes count as unverified.
    """
    quality = F.coalesce(_lookup(RELIABILITY, F.col("class")), F.lit(RELIABILITY["UNVERIFIED"]))
    stories = members.groupBy("cluster").agg(
        F.avg(quality).alias("reliability"), F.max(quality).alias("best"), F.count_distinct("source").alias("n_sources"),
        F.min("published").alias("began"), F.min_by("category", F.struct("published", "id")).alias("category"),
    )
    weight = F.coalesce(_lookup(ENTITY_WEIGHT, F.col("entity")), _lookup(TYPE_WEIGHT, F.col("kind")))
    named = entities.join(members.select("cluster", "id"), "id").groupBy("cluster", "entity", "kind").agg(F.sum("n").alias("n"))
    named = named.groupBy("cluster").agg(F.max(weight * F.when(F.col("n") >= 2, 1.0).otherwise(0.8)).alias("entity"))
    own = vectors.join(stories.select("cluster", "began"), "cluster").withColumn("bucket", F.floor(F.col("began") / window_ms))
    older = own.select(F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), "w", F.col("cluster").alias("other"), F.col("x").alias("y"), F.col("began").alias("before"))
    pairs = own.join(older, ["bucket", "w"]).where((F.col("before") < F.col("began")) & (F.col("began") - F.col("before") <= window_ms))
    alike = pairs.groupBy("cluster", "other").agg(F.sum(F.col("x") * F.col("y")).alias("cosine")).groupBy("cluster").agg(F.max("cosine").alias("alike"))
    age = F.greatest(F.lit(0), F.lit(as_of) - F.col("began"))
    per_hour = F.col("n_sources") / F.greatest(F.lit(1.0), age / HOUR_MS)
    parts = {
        "reliability": F.col("reliability"), "sources": F.least(F.lit(1.0), F.log2(F.col("n_sources").cast("double")) / 3), "entity": F.coalesce("entity", F.lit(0.0)),
        "category": F.coalesce(_lookup(CATEGORY_PRIOR, F.col("category")), F.lit(OTHER_CATEGORY)), "novelty": F.col("novelty"), "velocity": F.least(F.lit(1.0), per_hour / 3),
    }
    blended = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    raw = js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended)) * 100)
    unverified = F.col("best") <= RELIABILITY["SOCIAL"]
    breaking = ~unverified & (per_hour >= BREAKING_PER_HOUR) & (age < BREAKING_HOURS * HOUR_MS) & (F.col("n_sources") >= BREAKING_SOURCES)
    joined = stories.join(named, "cluster", "left").join(alike, "cluster", "left").withColumn("novelty", 1 - F.least(F.lit(1.0), F.coalesce("alike", F.lit(0.0))))
    return joined.select(
        "cluster", F.when(unverified, F.least(raw, F.lit(UNVERIFIED_CAP))).otherwise(raw).cast("bigint").alias("importance"), breaking.alias("breaking"), unverified.alias("unverified"),
        per_hour.alias("per_hour"), "novelty",
    )


def unit_vectors(members: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(cluster, w, x): normalised sums of the members' TF-IDF vectors, each of length one; IDF over all members."""
    n = members.agg(F.count(F.lit(1)).cast("double").alias("all"))
    tf = members.select("cluster", "id", F.explode(tokens).alias("w")).groupBy("cluster", "id", "w").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((F.col("all") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    x = tf.join(idf, "w").select("cluster", "id", "w", (F.col("tf") * F.col("idf")).alias("x"))
    x = x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id"))))
    total = x.groupBy("cluster", "w").agg(F.sum("x").alias("x"))
    return total.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("cluster"))))
