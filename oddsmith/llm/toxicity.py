"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Features of a token are the word and its leading 4 to 8 bytes. Documents with a feature are counted by label in two
hashed tables of fixed size, the counts give log-odds under an informative Dirichlet prior, and a token scores as its
feature with the largest lower confidence bound. A linear scan (Ruzzo and Tompa, 1999) finds all maximal segments; the
Karlin-Altschul law turns their scores into expectations, and a logistic curve over the logarithm of the evidence gives a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, materialize, small_batches, utf8_list, words_of

#: Buckets of each of the two hashed tables: the model has this size for any corpus.
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the corpus-wide prior in documents, standard errors of the confidence bound, cost of a token in a segment.
PRIOR_DOCS, ERRORS, DRIFT = 20.0, 1.5, 0.05
#: Smaller weights are noise and count as nothing.
LEAST = 0.7
#: A segment counts if fewer than this many as good are expected in a clean document of the same length.
MAX_EXPECTED = 1.0
LEAST_EVIDENCE = -math.log(MAX_EXPECTED)
_CACHE = 1 << 20


def feature_hashes(word: bytes) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(word, 0), *(xxh64_intdigest(word[:k], 1) for k in PREFIXES if len(word) >= k)]


class _Cached(dict):
    """A word's value, computed once; emptied when it has _CACHE words, so that a task's memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= _CACHE:
            self.clear()
        found = self[word] = self.make(word)
        return found


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a score sequence, in linear time."""
    import numpy as np

    sums = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.asarray(scores) > 0).astype(np.int8), [0]])))
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, index of the next lower start
    for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right = float(sums[first]), float(sums[end])
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                stack.append((first, end, left, right, at))
                break
            first, left = stack[at][0], stack[at][2]
            lower = stack[at][4]
            del stack[at:]
            at = lower
    return [(f, e, r - x) for f, e, x, r, _ in stack]


@dataclass
class ToxicityModel:
    """Token weights in two hashed tables, the law of clean segments (decay, volume) and the logistic curve."""

    weights: object
    decay: float = 1.0
    volume: float = 0.05
    offset: float = -2.0
    slope: float = 1.0
    cache: _Cached = field(default=None, repr=False)

    def __post_init__(self):
        self.cache = _Cached(self.token_weight)

    def __getstate__(self):
        return {**self.__dict__, "cache": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def token_weight(self, word: bytes) -> float:
        """The feature's weight with the largest magnitude; a feature's two buckets must agree in sign, the smaller counts."""
        best = 0.0
        for h in feature_hashes(word):
            a, b = float(self.weights[0][h % BUCKETS]), float(self.weights[1][(h >> 24) % BUCKETS])
            x = (min(a, b) if a > 0 else max(a, b)) if a * b > 0 else 0.0
            best = x if abs(x) > abs(best) else best
        return best

    def token_scores(self, words: list[bytes]):
        """Weights less the cost of a token; the n-th time a word occurs in a text it counts for one n-th, as repeats are no new evidence."""
        import numpy as np

        scores = np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(scores).tolist():
            seen[words[i]] = n = seen.get(words[i], 0) + 1
            scores[i] /= n
        return scores - DRIFT

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of the label and the significant passages (first word, words, score, expected number)."""
        rare = [(f, e, s, self.decay * s - math.log(self.volume * max(n, 1))) for f, e, s in segments]  # minus the log of the expected number
        rare = [x for x in rare if x[3] > LEAST_EVIDENCE]
        x = self.offset + self.slope * math.log1p(math.fsum(r[3] for r in rare))
        score = 1 / (1 + math.exp(-x)) if x > 0 else math.exp(x) / (1 + math.exp(x))
        return score, [(f, e - f, s, math.exp(-r)) for f, e, s, r in rare]

    def judge(self, data: bytes | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        words = words_of(data)
        return self.score(len(words), maximal_segments(self.token_scores(words)) if words else [])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fifth, by crc32 of the id as text. Two labels of one id: the larger; null labels or ids: no label."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("__id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("__id").cast("string")) % 5 != 0).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    known = broadcast_if_small(materialize(known, "labels"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return rows.join(known, "__id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def _count_features(batches: Iterator) -> Iterator:
    """Documents with each bucket, by label, summed over the task; bucket -1 counts the documents."""
    import numpy as np
    import pyarrow as pa

    counts, totals = np.zeros((2, 2 * BUCKETS), np.int32), np.zeros(2, np.int64)
    hashes = _Cached(feature_hashes)
    for batch in batches:
        for data, y in zip(utf8_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            totals[y] += 1
            own = {h for w in set(words_of(data)) for h in hashes[w]}
            h = np.fromiter(own, np.uint64, len(own))
            counts[y][np.unique(np.concatenate([h % BUCKETS, (h >> np.uint64(24)) % BUCKETS + BUCKETS]).astype(np.int64))] += 1
    if totals.any():
        seen = np.flatnonzero(counts.any(axis=0))
        columns = [np.append(seen, -1), np.append(counts[1][seen], totals[1]), np.append(counts[0][seen], totals[0])]
        table = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "toxic", "clean"])
        for at in range(0, table.num_rows, 1 << 16):
            yield table.slice(at, 1 << 16)


def _log_odds(counts: DataFrame):
    """Weights of the buckets: the lower confidence bound of the log-odds of toxic against clean documents."""
    import numpy as np

    totals = counts.where("bucket = -1").first()
    weights = np.zeros((2, BUCKETS), np.float32)
    if totals is None or not totals["toxic"] or not totals["clean"]:
        return weights, totals
    t, c = float(totals["toxic"]), float(totals["clean"])
    share = PRIOR_DOCS * (F.col("toxic") + F.col("clean")) / (t + c)
    with_t, with_c = F.col("toxic") + share, F.col("clean") + share
    delta = F.log(with_t / (t + PRIOR_DOCS - with_t + 1e-9)) - F.log(with_c / (c + PRIOR_DOCS - with_c + 1e-9))
    bound = F.abs(delta) - ERRORS * F.sqrt(1 / with_t + 1 / with_c)
    rows = counts.where("bucket >= 0").select("bucket", (F.signum(delta) * bound).cast("float").alias("w")).where(bound > LEAST)
    found = rows.toArrow()  # at most 2 * BUCKETS rows of 12 bytes
    weights.reshape(-1)[found["bucket"].to_numpy()] = found["w"].to_numpy()
    return weights, totals


def _decay(scores: dict[float, float], rest: float) -> float:
    """The positive root of mean(exp(root * score)) = 1 over clean tokens; scores: counts of positive scores, rest: of others."""
    total = sum(scores.values()) + rest
    mean = lambda r: (sum(n * math.exp(r * s) for s, n in scores.items()) + rest * math.exp(-r * DRIFT)) / total
    low, high = 1e-3, 1.0
    if mean(low) >= 1:
        return low
    if mean(high) <= 1:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def _logistic(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Offset and slope by Newton's method over (evidence, toxic, clean) bins, with a small ridge on the slope."""
    import numpy as np

    x, t, c = (np.array(v, float) for v in zip(*bins, strict=True))
    n, w = t + c, np.array([math.log((t.sum() + 0.5) / (c.sum() + 0.5)), 0.0])
    loss = lambda w: float((n * np.logaddexp(0, w[0] + w[1] * x) - t * (w[0] + w[1] * x)).sum() + 0.05 * w @ w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        gradient = np.array([(n * p - t).sum(), ((n * p - t) * x).sum()]) + 0.1 * w
        v = n * p * (1 - p)
        step = np.linalg.solve(np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.1 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from all labelled documents outside the held-out fifth; counts and laws cover every such row.

    Without toxic or without clean rows every document gets the same score, below one half.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col)
    counted = rows.mapInArrow(_count_features, "bucket bigint, toxic bigint, clean bigint")
    counts = materialize(counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "odds")
    weights, totals = _log_odds(counts)
    model = ToxicityModel(weights)
    if totals is None:
        return model
    if not totals["toxic"] or not totals["clean"]:
        model.offset = min(-1e-3, math.log((totals["toxic"] + 0.5) / (totals["clean"] + 0.5)))
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 0):
                out = []
                for data in utf8_list(part.column(0)):
                    words = words_of(data)
                    scores = held.value.token_scores(words)
                    value, count = np.unique(np.round(scores[scores > 0] * 4) / 4, return_counts=True)
                    out.append((len(words), [s for _, _, s in maximal_segments(scores)], [{"s": float(a), "n": int(b)} for a, b in zip(value, count, strict=True)]))
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int64())])))
                arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(1), *arrays], names=["toxic", "n", "segments", "positive"])

    scanned = rows.mapInArrow(scan, "toxic int, n bigint, segments array<double>, positive array<struct<s:double,n:bigint>>")
    scanned = materialize(scanned, "scanned")
    clean = scanned.where("toxic = 0")
    positive = clean.select(F.explode("positive").alias("p")).groupBy("p.s").agg(F.sum("p.n").alias("n")).collect()  # scores in quarters: a few hundred rows
    scores = {r["s"]: float(r["n"]) for r in positive}
    tokens, n_clean = clean.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scores[max([*scores, 1.0])] = scores.get(max([*scores, 1.0]), 0) + 1  # one unseen token: the decay stays finite
    model.decay = _decay(scores, max(1.0, tokens - sum(scores.values())))
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    model.volume = n_clean / (clean.agg(F.sum(F.greatest("n", F.lit(1)) * F.exp(-model.decay * best))).first()[0] + 1.0)
    rare = lambda s: model.decay * s - F.log(F.lit(model.volume) * F.greatest(F.col("n"), F.lit(1)))
    sure = F.filter(F.transform("segments", rare), lambda x: x > LEAST_EVIDENCE)
    # the logarithm of the evidence to two places: no cap, and a few thousand bins whatever the texts
    evidence = F.round(F.log1p(F.aggregate(sure, F.lit(0.0), lambda a, x: a + x)), 2)
    bins = scanned.groupBy(evidence.alias("x")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    model.offset, model.slope = _logistic([(r["x"], r["t"], r["c"]) for r in bins])
    return model


def toxic_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) for every row: score in 0 to 1, passages with their words, score and expected number.

    Null, empty and wordless texts have no passages and the score of a document without evidence. Repeated rows stay;
    equal texts score equally; other columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
        for batch in batches:
            for part in small_batches(batch, 1):
                out = [held.value.judge(x) for x in utf8_list(part.column(1))]
                spans = [[dict(zip(("first_word", "n_words", "score", "expected"), p, strict=True)) for p in o[1]] for o in out]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, score double, passages array<struct<first_word:bigint,n_words:bigint,score:double,expected:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Null, empty and wordless texts score as a document without evidence and stay unless that reaches the threshold;
    repeated rows stay or go together; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, at):
                yield part.filter(pa.array([held.value.judge(x)[0] < threshold for x in utf8_list(part.column(at))]))

    return docs.mapInArrow(each, docs.schema)
