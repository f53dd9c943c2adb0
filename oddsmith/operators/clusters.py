"""Greedy story clustering and links between equal titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STORY_HOURS, LEAST_SIMILARITY = 48, 0.45


def vectors(articles: DataFrame) -> DataFrame:
    """articles with `words`, the sorted (w, x) of each: term count times the IDF over all articles, of length one."""
    n = articles.agg(F.count(F.lit(1)).cast("double").alias("n"))
    tf = articles.select("id", F.explode("tokens").alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    words = tf.join(idf, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("tf") * F.col("idf")).alias("x")))).alias("words"))
    return articles.join(words, "id", "left")


class Stories:
    """The stories of the last window_ms, oldest first, and what an article joins: the one most alike, the elder at ties.

    open holds a story under its first article's id: (sum of unit vectors, (published, id) of its founding, sum of times,
    members), and may be given. Words lead to the stories that have them, with the word's weight there, so an article meets
    only stories that share a word and adds up only what is shared; stories whose mean time is out of reach are let go.
    """

    def __init__(self, window_ms: int, least: float, open: dict | None = None) -> None:
        self.window_ms, self.least, self.open = window_ms, least, {} if open is None else open
        self.norms, self.holders, self.swept = {}, {}, None
        for k in self.open:
            self._index(k)

    def _index(self, k: int) -> None:
        import math

        total = self.open[k][0]
        self.norms[k] = math.sqrt(sum(x * x for x in total.values())) or 1.0
        for w, x in total.items():
            self.holders.setdefault(w, {})[k] = x

    def _close(self, k: int) -> None:
        for w in self.open.pop(k)[0]:
            own = self.holders[w]
            del own[k]
            if not own:
                del self.holders[w]
        del self.norms[k]

    def place(self, article: int, published: int, vector: dict[str, float]) -> int:
        import math

        if self.swept is None or published - self.swept > self.window_ms // 16:
            self.swept = published
            for k in [k for k, (_, _, time, n) in self.open.items() if published - time / n > self.window_ms]:
                self._close(k)
        if not vector:
            return article
        size = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        vector = {w: x / size for w, x in vector.items()}
        shared: dict[int, float] = {}
        for w, x in vector.items():
            for k, y in self.holders.get(w, {}).items():
                shared[k] = shared.get(k, 0.0) + x * y
        best, found = None, article
        for k, s in shared.items():
            alike = s / self.norms[k]
            if alike >= self.least:
                _, founded, time, n = self.open[k]
                if abs(published - time / n) <= self.window_ms and (best is None or (-alike, founded) < best):
                    best, found = (-alike, founded), k
        total, founded, time, n = self.open.get(found, ({}, (published, article), 0, 0))
        total = dict(total)
        for w, x in vector.items():
            total[w] = total.get(w, 0.0) + x
        self.open[found] = (total, founded, time + published, n + 1)
        self._index(found)
        return found


def story_clusters(articles: DataFrame, window_ms: int = STORY_HOURS * 3_600_000) -> DataFrame:
    """(id, cluster): articles(id, published, tokens), oldest first, join the cluster whose normalised centroid is most alike.

    The order decides, so a stretch of news is one sorted pass that holds only the clusters whose mean time is at most
    window_ms back: no later article can join the others. A stretch ends where window_ms go by without an article.
    """
    buckets = articles.select(F.floor(F.col("published") / window_ms).alias("bucket")).distinct()
    in_order = Window.orderBy("bucket")
    breaks = buckets.select("bucket", F.when(F.col("bucket") - F.lag("bucket").over(in_order) > 1, 1).otherwise(0).alias("new"))
    stretches = breaks.select("bucket", F.sum("new").over(in_order).alias("stretch"))
    rows = vectors(articles.select("id", "published", "tokens")).withColumn("bucket", F.floor(F.col("published") / window_ms)).join(stretches, "bucket")
    rows = rows.select("stretch", "published", "id", F.col("words.w").alias("w"), F.col("words.x").alias("x"))

    def each(batches):
        import pandas as pd

        stretch, stories = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            found = []
            for r in pdf.itertuples():
                if r.stretch != stretch:
                    stretch, stories = r.stretch, Stories(window_ms, LEAST_SIMILARITY)
                found.append(stories.place(r.id, r.published, dict(zip(r.w, r.x, strict=True)) if r.w is not None else {}))
            yield pd.DataFrame({"id": pdf["id"], "cluster": pd.Series(found, dtype="int64")})

    return rows.repartition("stretch").sortWithinPartitions("stretch", "published", "id").mapInPandas(each, "id bigint, cluster bigint")


def link_groups(links: DataFrame) -> DataFrame:
    """(id, root) of links(a, b): alternating large and small stars bring every id to the least that it is linked with.

    A round leaves about a link an id, so later ones are small however many links there were; no side of a join is sent to
    the driver, and a round is checkpointed.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least.hint("merge"), "u").where("v <> m").select("v", "m").union(least).toDF("u", "v").distinct().checkpoint()


def title_links(titles: DataFrame, above: float = 0.6) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of token sets of titles(id, tokens) whose similarity is above the bound, each set under its least id.

    Prefix filtering: with the rarest tokens first, two sets beyond the bound share one of the first
    n - ceil(above * n) + 1 tokens of each, so that common words make no candidates; at the first of them both must have
    enough words left. A candidate is counted where it meets, and only links are shuffled. Empty sets link to nothing.
    """
    sets = titles.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("id").alias("id")).withColumn("n", F.size("tokens"))
    words = sets.select("id", "n", F.explode("tokens").alias("w"))
    frequency = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).select("w", F.row_number().over(Window.orderBy("df", "w")).alias("word"))
    own = Window.partitionBy("id")
    head = words.join(frequency, "w").select("id", "n", "word", F.row_number().over(own.orderBy("word")).alias("rank"), F.collect_list("word").over(own).alias("words"))
    head = head.where(F.col("rank") <= F.col("n") - F.ceil(above * F.col("n")) + 1)
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (head.select("word", F.col("id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "rank", "words"))).repartition(parts, "word") for x in "ab")
    left = F.least(F.col("na") - F.col("ranka"), F.col("nb") - F.col("rankb")) + 1
    may = (F.least("na", "nb") > above * F.greatest("na", "nb")) & (left >= above / (1 + above) * (F.col("na") + F.col("nb")) - 1e-9)
    both = F.size(F.array_intersect("wordsa", "wordsb"))
    scored = one.join(two.hint("merge"), "word").where((F.col("a") < F.col("b")) & may).select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))
    return scored.where(F.col("jaccard") > above).distinct()


def title_groups(titles: DataFrame, above: float = 0.6) -> DataFrame:
    """(id, root, event_key, event_title) of titles(id, title, tokens) in groups of two and more: linked titles, and those of equal token sets.

    The shortest title of a group, the least id at ties, names it; its sorted tokens are the key.
    """
    own = titles.where(F.size("tokens") > 0).join(titles.groupBy("tokens").agg(F.min("id").alias("first")), "tokens")
    rooted = own.join(link_groups(title_links(titles, above)).withColumnRenamed("id", "first"), "first", "left").withColumn("root", F.coalesce("root", "first"))
    groups = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("title").alias("size"), "id", "title", "tokens")).alias("best")).where("n > 1")
    return rooted.join(groups, "root").select("id", "root", F.array_join("best.tokens", "-").alias("event_key"), F.col("best.title").alias("event_title"))
