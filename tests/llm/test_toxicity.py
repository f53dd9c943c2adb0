import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsmith.llm import toxicity as t


def brute_segments(x):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""

    def walk(lo, hi):
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return [*walk(lo, i), (i, j, best[0]), *walk(j, hi)]

    return walk(0, len(x))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-7, -3, -2, -1, 1, 2, 4, 9, 16]), max_size=14).map(lambda x: [v + 0.001 * 2**-i for i, v in enumerate(x)]))
def test_maximal_segments(x):
    got = t.maximal_segments(np.array(x))
    assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in brute_segments(x)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = t.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in t.toxic_passages(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows]
    assert len(good) > 300 and sum(good) / len(good) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "fine words here", None), (4, "bad " * 200000, None)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        model = t.fit(docs, known)
        rows = t.toxic_passages(docs, model).collect()
        assert len(rows) == 5 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert t.toxic_passages(docs.limit(0), model).count() == 0
    assert t.drop_toxic(docs, t.fit(docs, labels.limit(0))).count() == 5
