import math
import random
import re
from collections import Counter, defaultdict

import pytest

from oddsmith.llm import mixing

SF = "/root/testdata/sf0.01"


def brute_targets(words, weights=(1, 2, 3), most=3):
    """Shares by weight; the excess over a limit is shared again until none is above."""
    order = sorted((s for s in words if s is not None), key=str.encode) + [None] * (None in words)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(words.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * words[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * words[s]
            left -= target[s]
            free.remove(s)
    return target


def brute_rates(sizes, target, most=3):
    """Rates min(most, exp(lambda size)) that give the target, by bisection."""
    if target >= most * sum(sizes):
        return [most] * len(sizes)
    low, high = -800.0, 800.0
    for _ in range(300):
        middle = (low + high) / 2
        rates = [min(most, math.exp(min(700, middle * x))) for x in sizes]
        low, high = (low, middle) if sum(x * r for x, r in zip(sizes, rates, strict=True)) > target else (middle, high)
    return rates


def check(rows, docs):
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = Counter((i, s, words(t)) for i, s, t in docs)
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == want
    total = defaultdict(int)
    for _, s, t in docs:
        total[s] += words(t)
    target, by = brute_targets(total), defaultdict(list)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        by[r.source].append(r)
    for s, own in by.items():
        sized = [r["size"] for r in own]
        rates = brute_rates(sized, target[s]) if total[s] else [3] * len(own)
        assert [r.rate for r in own if r["size"]] == pytest.approx([x for x, n in zip(rates, sized, strict=True) if n], abs=2e-4)
        taken, least = sum(r.taken for r in own), min([n for n in sized if n], default=0)
        assert abs(taken - target[s]) <= max(least, max(sized) / 2), s
    return by


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.mix(docs).collect()
    by = check(rows, [tuple(r) for r in docs.collect()])
    assert all(abs(sum(r.taken for r in own) / own[0].target - 1) < 0.001 for own in by.values())
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_odd_rows(spark):
    random.seed(5)
    docs = [(i, random.choice(["é", "a", "a", "a", "Z", "bé", "", "\U00010400", "￿"]), "w " * random.choice([0, 1, 1, 2, 5, 90])) for i in range(300)]
    docs += [(7, "a", "one and the same")] * 200 + [(None, None, None), (None, None, "x\x0by"), (1, None, "z " * 70_000), (2, "empty", " "), (3, "none", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "'x' AS rank", "2 AS target", "0 AS copies")
    rows = mixing.mix(df).collect()
    check(rows, docs)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_one_source_stays_whole(spark):
    df = spark.createDataFrame([(i, "only", "w " * i) for i in range(50)], "doc_id long, source string, text string")
    assert all(r.copies == 1 for r in mixing.mix(df).collect() if r["size"])
