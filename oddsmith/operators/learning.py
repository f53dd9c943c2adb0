"""Small models fitted inside a group: multinomial logistic regression, walk-forward validation, isotonic calibration."""

from __future__ import annotations

import array
import tempfile

from pyspark.sql import DataFrame


#: Rows that a step of training takes at once, so that what it computes stays in the cache.
TRAINING_BLOCK = 4096


def train_logistic(x, y, classes: int = 3, rate: float = 0.5, steps: int = 400, l2: float = 0.01):
    """Weights (classes, features + 1) by full-batch gradient descent from zero; the intercept is not shrunk."""
    return train_in_blocks(lambda: ((x[at : at + TRAINING_BLOCK], y[at : at + TRAINING_BLOCK]) for at in range(0, len(x), TRAINING_BLOCK)), x.shape[1], classes, rate, steps, l2)


def train_in_blocks(blocks, width: int, classes: int, rate: float, steps: int, l2: float):
    """train_logistic's weights; blocks() gives (x, y) of at most TRAINING_BLOCK rows each, anew for every pass.

    Each step passes over the blocks and copies nothing of their number. Class 0 is what the others are measured by, and as
    the classes' probabilities sum to one its gradient follows from theirs.
    """
    import numpy as np

    n, w, target, everything = 0, np.zeros((classes, width + 1)), np.zeros((classes, width + 1)), np.zeros(width + 1)
    for x, y in blocks():
        own = np.eye(classes)[y].T
        target[:, :-1] += own @ x
        target[:, -1] += own.sum(axis=1)
        n += len(y)
    everything[:] = target.sum(axis=0)
    keep = np.append(np.ones(width), 0)
    for _ in range(steps):
        total, gap = np.zeros_like(w), w[1:] - w[0]
        for part, _ in blocks():
            p = gap[:, :-1] @ part.T
            p += gap[:, -1:]
            np.minimum(p, 700, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0) + 1
            total[1:, :-1] += p @ part
            total[1:, -1] += p.sum(axis=1)
        total[0] = everything - total[1:].sum(axis=0)
        w -= rate * ((total - target) / n + l2 * w * keep)
    return w


class Samples:
    """Feature rows and their outcomes, in order: full blocks wait in a temporary file of the task, so that one block is held, however many there are."""

    def __init__(self, width: int) -> None:
        self.width, self.n, self.x, self.y, self.file = width, 0, array.array("d"), array.array("b"), None

    def add(self, outcome: int, values) -> None:
        self.x.extend(values)
        self.y.append(outcome)
        self.n += 1
        if len(self.y) == TRAINING_BLOCK:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(self.x.tobytes() + self.y.tobytes())
            del self.x[:], self.y[:]

    def blocks(self):
        import numpy as np

        if self.file is not None:
            self.file.seek(0)
            while data := self.file.read(TRAINING_BLOCK * (8 * self.width + 1)):
                yield np.frombuffer(data, count=TRAINING_BLOCK * self.width).reshape(-1, self.width), np.frombuffer(data, np.int8, offset=8 * TRAINING_BLOCK * self.width)
        if self.y:
            yield np.array(self.x).reshape(-1, self.width), np.array(self.y)


def predict(w, x):
    import numpy as np

    z = np.column_stack([x, np.ones(len(x))]) @ w.T
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


#: Least games to learn from, games at which a model's confidence is half, and its cap.
LEAST_SAMPLES, HALF_SAMPLES, MOST_CONFIDENCE = 120, 250, 0.75


def learned_outcomes(fixtures: DataFrame, games: DataFrame, rate: float = 0.5, steps: int = 300, l2: float = 0.02) -> DataFrame:
    """(league, home, away, model, home_p, draw_p, away_p, confidence, factors) of fixtures(league, home, away) by a model of the league's games.

    A league with fewer than LEAST_SAMPLES games to learn from abstains, and so does a fixture whose teams have played too
    few: neither has a row. factors are the three largest (feature, contribution), the gap of the home and away
    coefficients times the feature, a tenth of it.
    """

    from pyspark.sql import functions as F

    from oddsmith.operators import ratings

    class Known:
        """A league's sides and samples, and the model once the first fixture is asked for."""

        def __init__(self) -> None:
            self.sides, self.samples, self.now, self.w = {}, Samples(len(ratings.FEATURES)), float("-inf"), None

    def step(known, g):
        import numpy as np

        if not g.asked:
            sample = ratings.replay_step(known.sides, g)
            known.now = max(known.now, float(g.kickoff))
            if sample is not None:
                known.samples.add(sample[3], sample[4:])
            return ()
        n = known.samples.n
        if n < LEAST_SAMPLES:
            return ()
        if known.w is None:
            known.w = train_in_blocks(known.samples.blocks, len(ratings.FEATURES), 3, rate, steps, l2)
        values = ratings.fixture_values(known.sides, g.home, g.away, known.now)
        if values is None:
            return ()
        w, p = known.w, predict(known.w, np.array([values]))[0]
        shares = (w[0, :-1] - w[2, :-1]) * np.array(values) * 0.1
        top = [{"feature": ratings.FEATURES[i], "contribution": float(shares[i])} for i in np.argsort(-np.abs(shares), kind="stable") if shares[i] != 0][:3]
        return ((g.league, g.home, g.away, "learned", *map(float, p), min(MOST_CONFIDENCE, n / (n + HALF_SAMPLES)), top),)

    columns = ("league", "home", "away", "model", "home_p", "draw_p", "away_p", "confidence", "factors")
    schema = "league int, home int, away int, model string, home_p double, draw_p double, away_p double, confidence double, factors array<struct<feature:string,contribution:double>>"
    # fixtures come behind the games of their league, so one pass learns and answers
    played = games.select("league", F.lit(False).alias("asked"), "kickoff", "game_id", "home", "away", "hs", "aws")
    blank = [F.lit(0).cast(played.schema[c].dataType).alias(c) for c in ("kickoff", "game_id")]
    asked = fixtures.select("league", F.lit(True).alias("asked"), *blank, "home", "away", *(F.lit(0).cast(played.schema[c].dataType).alias(c) for c in ("hs", "aws")))
    return ratings.in_time(played.unionByName(asked), Known, step, ratings._nothing, columns, schema, ("asked", "kickoff", "game_id", "home", "away"))


def logistic_trainer(x, y):
    """The default trainer: a function from feature rows to class probabilities, learned from x and y."""
    w = train_logistic(x, y, 3, 0.5, 300, 0.02)
    return lambda asked: predict(w, asked)


#: Tasks that share a league's folds.
FOLD_SHARES = 5


def walk_forward(samples: DataFrame, features: tuple[str, ...], trainer=logistic_trainer, first: int = 120, step: int = 40, most: int | None = None, classes: int = 3) -> DataFrame:
    """(league, fold, trained, n, brier, log_loss, accuracy, base_brier): each fold of `step` games is scored by a model of all games before it.

    trainer(x, y) gives a function from feature rows to class probabilities; it must travel to the executors. base_brier is that
    of the outcome shares so far. With `most` only a league's latest folds are kept, and only they are trained. A league's
    folds are dealt to FOLD_SHARES tasks, and a game goes once to each task with a fold that needs it: in order of time a
    fold's games are the first of the task's.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("league").orderBy("kickoff", "game_id")
    rows = samples.withColumn("k", F.row_number().over(order) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("league")))
    last = F.floor((F.col("all") - 1 - first) / step)  # the last fold has a game at least
    oldest = F.lit(0) if most is None else F.greatest(F.lit(0), last - (most - 1))
    own = F.floor((F.col("k") - first) / step)  # the fold that a game is judged in, the first that does not learn from it
    start = F.greatest(oldest, own)
    shares = F.filter(F.sequence(F.lit(0), F.lit(FOLD_SHARES - 1)), lambda s: F.pmod(s - start, F.lit(FOLD_SHARES)) <= last - start)
    rows = rows.where(F.col("all") > first).select("league", F.explode(shares).alias("share"), "k", "all", "outcome", *features)
    columns = ["league", "fold", "trained", "n", "brier", "log_loss", "accuracy", "base_brier"]

    def scored(league, share, size, x, y):
        import numpy as np

        x, y = np.frombuffer(x).reshape(len(y), -1), np.frombuffer(y, np.int8)
        newest = (size - 1 - first) // step
        eldest = 0 if most is None else max(0, newest - (most - 1))
        for fold in range(eldest + (share - eldest) % FOLD_SHARES, newest + 1, FOLD_SHARES):
            cut = first + fold * step
            known, judged = y[:cut], y[cut : cut + step]
            p, truth = trainer(x[:cut], known)(x[cut : cut + step]), np.eye(classes)[judged]
            if np.abs(p.sum(axis=1) - 1).max() > 1e-6:
                raise ValueError("the trainer's class probabilities do not sum to one")
            base, n = np.bincount(known, minlength=classes) / cut, len(p)
            chosen = p[np.arange(n), judged]
            scores = (((p - truth) ** 2).sum(1).mean(), -np.log(np.maximum(chosen, 1e-12)).mean(), (p.argmax(1) == judged).mean(), ((base - truth) ** 2).sum(1).mean())
            yield (league, fold, cut, n, *map(float, scores))

    def each(batches):
        import numpy as np
        import pandas as pd

        task, x, y = None, bytearray(), bytearray()
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["league", "share", "all"], dropna=False):
                key = tuple(None if v != v else int(v) for v in key)
                if key != task:
                    if task is not None:
                        out += scored(*task, x, y)
                    task, x, y = key, bytearray(), bytearray()
                x += np.ascontiguousarray(part[list(features)].to_numpy(float)).tobytes()
                y += part["outcome"].to_numpy(np.int8).tobytes()
            yield pd.DataFrame(out, columns=columns)
        if task is not None:
            yield pd.DataFrame(list(scored(*task, x, y)), columns=columns)

    dealt = rows.repartition("league", "share").sortWithinPartitions("league", "share", "k")
    return dealt.mapInPandas(each, "league int, fold bigint, trained bigint, n bigint, brier double, log_loss double, accuracy double, base_brier double")


def walk_forward_totals(folds: DataFrame) -> DataFrame:
    """(league, folds, n, brier, log_loss, accuracy, base_brier, skill): the folds of a league together, weighted by their games."""
    from pyspark.sql import functions as F

    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    sums = folds.groupBy("league").agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), *map(mean, ("brier", "log_loss", "accuracy", "base_brier")))
    return sums.withColumn("skill", 1 - F.col("brier") / F.col("base_brier"))


def _pool(pools: list[list[float]], x: float, y: float, weight: float) -> None:
    """Adds a point behind the pools and merges while the last two do not rise."""
    pools.append([x, y, weight])
    while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
        b, a = pools.pop(), pools.pop()
        w = a[2] + b[2]
        pools.append([(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w])


def pool_adjacent_violators(p, y) -> list[tuple[float, float, float]]:
    """(position, value, weight) of the pools of a non-decreasing fit, in order of p; the order of y breaks ties."""
    pools: list[list[float]] = []
    for x, v in sorted(zip(p, y, strict=True)):
        _pool(pools, x, v, 1.0)
    return [tuple(q) for q in pools]


def isotonic_fit(observations: DataFrame, least: int = 500) -> DataFrame:
    """(domain, x, y, weight, usable): the pools of each domain's fit; null probabilities and outcomes are left out.

    Observations of equal probability are summed first. Ranges of the sorted points are then pooled each in its own task:
    the pools of a stretch are parts of the whole fit's pools, so pooling them once more gives that fit, and a domain
    gathers pools only.
    """
    from pyspark.sql import functions as F

    counted = observations.where("p is not null and y is not null").groupBy("domain", "p").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    points = counted.select("domain", F.col("p").alias("x"), (F.col("hits") / F.col("n")).alias("y"), F.col("n").cast("double").alias("weight"))

    def stretch(batches):
        import pandas as pd

        domain, pools = None, []
        for pdf in batches:
            out = []
            for d, x, y, w in zip(pdf["domain"], pdf["x"], pdf["y"], pdf["weight"], strict=True):
                if d != domain:
                    out += [(domain, *q) for q in pools]
                    domain, pools = d, []
                _pool(pools, x, y, w)
            yield pd.DataFrame(out, columns=["domain", "x", "y", "weight"])
        yield pd.DataFrame([(domain, *q) for q in pools], columns=["domain", "x", "y", "weight"])

    def whole(pdf):
        import pandas as pd

        pools: list[list[float]] = []
        for x, y, w in pdf.sort_values("x")[["x", "y", "weight"]].itertuples(index=False):
            _pool(pools, x, y, w)
        n = sum(q[2] for q in pools)
        return pd.DataFrame([(pdf["domain"].iloc[0], *q, n >= least) for q in pools], columns=["domain", "x", "y", "weight", "usable"])

    parts = points.repartitionByRange("domain", "x").sortWithinPartitions("domain", "x").mapInPandas(stretch, "domain string, x double, y double, weight double")
    return parts.groupBy("domain").applyInPandas(whole, "domain string, x double, y double, weight double, usable boolean")
