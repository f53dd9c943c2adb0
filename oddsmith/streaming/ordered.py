"""Folds over a stream in event-time order: rows wait until the watermark has passed them, so late arrivals fall into place.

Ratings of a league and clusters of stories depend on the order of games and articles. Each key keeps the rows that are
not yet due, its fold's state as a map, and an event-time timer at its last row; when the watermark passes, due rows are
applied in order. Rows behind the watermark are dropped. Waiting rows are stored a frame at a time, so that a row costs no call to
the store of its own. State is in the store, so a restarted query goes on.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a frame that a fold gives, and rows of one micro-batch of a replay.
FRAME, BATCH_ROWS = 10_000, 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Subclasses say what a row is, what is due when, and what the fold does with it.

    The map state holds the fold's entries by key; entries that a step does not touch are neither written nor removed.
    """

    time, order, columns, output = "at", (), (), ()
    closes_after_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.serial = handle.getValueState("serial", "n long")
        self.waiting = handle.getMapState("waiting", "n long", "first long, rows binary")
        self.entries = handle.getMapState("entries", "entry long", "value binary")

    def step(self, entries: dict, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def closed(self, entries: dict, now_ms: int) -> list[int]:
        """Entries that no row from now on can change."""
        return []

    def _ms(self, pdf):
        return pdf[self.time].astype("datetime64[us]").astype("int64") // 1000

    def _keep(self, pdf) -> None:
        """Rows that are not yet due, a frame as one value."""
        n = self.serial.get()[0] + 1 if self.serial.exists() else 0
        self.serial.update((n,))
        self.waiting.updateValue((n,), (int(self._ms(pdf).min()), pickle.dumps(pdf)))

    def _due(self, key: tuple, now_ms: int):
        import pandas as pd

        found = sorted((k[0], v[1]) for k, v in self.waiting.iterator() if v[0] < now_ms)
        if found:
            rows = pd.concat([pickle.loads(v) for _, v in found], ignore_index=True)
            for n, _ in found:
                self.waiting.removeKey((n,))
            # a row that comes again before it is due replaces the one before it
            rows = rows.assign(__ms=self._ms(rows)).drop_duplicates(["__ms", self.order], keep="last").sort_values(["__ms", self.order])
            later, rows = rows[rows["__ms"] >= now_ms], rows[rows["__ms"] < now_ms]
            if len(later):
                self._keep(later[list(self.columns)])
            rows = rows[list(self.columns)]
        held = {k[0]: pickle.loads(v[0]) for k, v in self.entries.iterator()}
        before = {k: pickle.dumps(v) for k, v in held.items()}
        for at in range(0, len(rows) if found else 0, FRAME):
            out = []
            for row in rows.iloc[at : at + FRAME].itertuples(index=False, name=None):
                out += [(*key, *r) for r in self.step(held, row)]
            yield pd.DataFrame(out, columns=self.output)
        for entry in self.closed(held, now_ms):
            del held[entry]
        for entry in before.keys() - held.keys():
            self.entries.removeKey((entry,))
        for entry, value in held.items():
            if before.get(entry) != (packed := pickle.dumps(value)):
                self.entries.updateValue((entry,), (packed,))

    def handleInputRows(self, key, rows, timerValues):
        now, last = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            pdf = pdf.loc[pdf[self.order].notna(), list(self.columns)]  # rows without it only move time
            at = self._ms(pdf)
            pdf = pdf[at >= now]
            if len(pdf):
                self._keep(pdf)
                last = int(at.max()) if last is None else max(last, int(at.max()))
        if last is not None:
            self.handle.registerTimer(last + 1)
            if self.closes_after_ms is not None:
                self.handle.registerTimer(last + 1 + self.closes_after_ms)
        yield from self._due(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class LeagueRatings(OrderedFold):
    """Adaptive ratings: steps shrink with experience and grow with the log of the margin."""

    order = "game_id"
    columns = ("at", "game_id", "home", "away", "hs", "aws")
    output = ("league", "game_id", "team", "before", "after")
    schema = "league int, game_id long, team int, before double, after double"

    def __init__(self, advantage: float = 65.0, start: float = 1500.0) -> None:
        self.advantage, self.start = advantage, start

    def step(self, entries: dict, row: tuple) -> Iterator[tuple]:
        _, game, home, away, hs, aws = row
        if hs is None or aws is None or hs != hs or aws != aws:
            return  # not played
        home, away = int(home), int(away)
        (a, played_a), (b, played_b) = (entries.get(t, (self.start, 0)) for t in (home, away))
        won = 1.0 if hs > aws else 0.5 if hs == aws else 0.0
        k = sum(20 + 20 * math.exp(-n / 25) for n in (played_a, played_b)) / 2
        move = k * math.log1p(max(1, abs(hs - aws))) / math.log(2) * (won - 1 / (1 + 10 ** (-(a + self.advantage - b) / 400)))
        entries[home], entries[away] = (a + move, played_a + 1), (b - move, played_b + 1)
        yield int(game), home, a, a + move
        yield int(game), away, b, b - move


class StoryClusters(OrderedFold):
    """Greedy stories: an article joins the cluster whose normalised centroid is most alike, if alike enough and near enough in time."""

    order = "id"
    columns = ("at", "id", "published", "w", "x")
    output = ("topic", "id", "cluster")
    schema = "topic int, id long, cluster long"

    def __init__(self, window_ms: int, least: float) -> None:
        self.window_ms, self.least = window_ms, least
        self.closes_after_ms, self.stories = window_ms, None

    def _due(self, key: tuple, now_ms: int):
        self.stories = None  # the entries are read anew
        yield from super()._due(key, now_ms)

    def closed(self, entries: dict, now_ms: int) -> list[int]:
        return [k for k, (_, _, time, n) in entries.items() if now_ms - time / n > self.window_ms]

    def step(self, entries: dict, row: tuple) -> Iterator[tuple]:
        from oddsmith.operators.clusters import Stories

        if self.stories is None:
            self.stories = Stories(self.window_ms, self.least, entries)
        _, article, published, words, weights = row
        yield int(article), self.stories.place(int(article), published, dict(zip(words, weights, strict=True)) if words is not None else {})


def ordered_fold(rows: DataFrame, by: str, fold: OrderedFold, lateness: str) -> DataFrame:
    """The fold's rows of a stream with a time column `at`; a row is applied once the watermark, `lateness` behind the latest row, has passed it."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.withWatermark("at", lateness).groupBy(by).transformWithStateInPandas(fold, fold.schema, "Append", "EventTime")


def replayed(rows: DataFrame, path: str, batches: int, by: str | None = None, last_at: str = "2200-01-01", split: bool = False) -> DataFrame:
    """rows as a stream of `batches` batches or more in order of time `at`; with `by`, one more batch moves time past all rows.

    A batch is a file of its own, written after the one before it, so there are as many as keep a file to BATCH_ROWS rows; the
    last holds a row a key with nothing but its time. rows are computed once, and each batch reads its own part of them.
    With `split` there are `batches` batches however many rows: a batch is as many files as keep a file to BATCH_ROWS rows,
    for streams whose every batch costs as much as all results and which need no time: rows without one come first.
    """
    spark, kind = rows.sparkSession, rows.schema
    rows.write.parquet(f"{path}-rows")
    rows = spark.read.schema(kind).parquet(f"{path}-rows")
    wanted = -(-rows.count() // BATCH_ROWS)
    files = max(1, -(-wanted // batches)) if split else 1
    batches = max(batches, 1 if split else wanted) if batches > 1 else 1
    if batches > 1:
        edges = rows.select(F.percentile_approx(F.unix_micros("at"), F.array(*(F.lit(i / batches) for i in range(1, batches))), F.lit(10_000)).alias("e")).first()["e"] or []
        part = sum((F.when(F.unix_micros("at") > e, 1).otherwise(0) for e in edges), F.lit(0))
        dealt = rows.withColumn("part", part) if split else rows.where("at is not null").withColumn("part", part).repartition(batches, "part")
        dealt.write.partitionBy("part").parquet(f"{path}-parts")
        cut = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kind)}, part int").parquet(f"{path}-parts")
    for i in range(batches):
        own = rows if batches == 1 else cut.where(F.col("part") == i).drop("part")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.parquet(f"{path}/part={i}")
    if by is not None:
        end = rows.select(by).distinct().withColumn("at", F.lit(last_at).cast("timestamp"))
        blank = [F.col(c) if c in end.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
        end.select(*blank).coalesce(1).write.parquet(f"{path}/part={batches}")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")
