from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsmith.llm import decontaminate as d

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), []
    for name, t in items:
        x = words(t)
        if not x:
            continue
        k = min(window, len(x))
        grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        places = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams]
        hit.update(j for i in places for j in range(i, i + k))
        found += [name] if places else []
    return len(w), len(hit), sorted(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6), st.lists(st.text("abc ", max_size=12), max_size=4), st.integers(1, 5))
def test_search_against_brute_force(texts, tests, window):
    items = [(str(i), t) for i, t in enumerate(tests)]
    block = d.TestItems.encode([(n, t.encode()) for n, t in items], window)
    got = d.search([t.encode() for t in texts], block)
    assert [(n, sum(b - a for a, b in spans), names) for n, spans, names in got] == [brute(t, items, window) for t in texts]
    assert all(a[1] < b[0] for _, spans, _ in got for a, b in zip(spans, spans[1:], strict=False))


def brute_longest(texts, tests, window):
    """(item, word) to the length of its longest match, for suffixes that match a window and do not continue the one before."""
    shown = [f" {' '.join(words(t))} " for t in texts]
    want = {}
    for i, t in enumerate(tests):
        x, before = words(t), 0
        for j in range(len(x)):
            n = max((k for k in range(1, len(x) - j + 1) if any(f" {' '.join(x[j : j + k])} " in s for s in shown)), default=0)
            if n >= min(window, len(x)) and n != before - 1:
                want[i, j] = n
            before = n
    return want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6), st.lists(st.text("abc ", max_size=12), max_size=4), st.integers(1, 3))
def test_longest_matches_against_brute_force(texts, tests, window):
    block = d.TestItems.encode([(str(i), t.encode()) for i, t in enumerate(tests)], window)
    got = {}
    for item, j, doc, at, n in d.longest_in_shard([t.encode() for t in texts], block, window):
        i = int(block.names[item])
        assert words(texts[doc])[at : at + n] == words(tests[i])[j : j + n]
        got[i, j] = n
    want = brute_longest(texts, tests, window)
    least = min((min(window, len(words(t))) for t in tests if words(t)), default=0)
    assert {k: n for k, n in got.items() if n >= least} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(x):
    text = np.array([*x, 0])
    ends = {i: [*x, 0].index(0, i) for i in range(len(x) + 1)}
    want = sorted((i for i in range(len(x)) if x[i]), key=lambda i: (x[i : ends[i]], i))
    got = d.suffix_array(text, 64).tolist()
    assert [x[i : ends[i]] for i in got] == [x[i : ends[i]] for i in want] and sorted(got) == sorted(want)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 3000])
def test_whole_tables_and_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(d, "BLOCK_BYTES", block_bytes)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    bench = read("benchmark").union(spark.createDataFrame([(1000, "Une  phrase; COURTE"), (1000, "une phrase courte"), (1001, None), (None, "..."), (1002, "")], read("benchmark").schema))
    docs = read("documents").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "ah, une phrase courte!", "x"), (-3, "ah, une phrase courte!", "x"), (None, "a b", None)], docs.schema))
    docs = docs.withColumn("n_hit", docs["lang"])
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = sorted((str(r.doc_id), *map(str, brute(r.text, items))) for r in docs.collect())
    rows = d.contaminated_words(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r.item_ids)) for r in rows) == want
    assert sum(r.n_hit > 0 for r in rows) > 2
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(r.n_hit == 0 for r in rows)
    assert d.contaminated_words(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert d.contaminated_words(docs.limit(0), bench).count() == 0 == d.longest_matches(docs.limit(0), bench).count()
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    longest = d.longest_matches(docs, bench).collect()
    tests = defaultdict(list)
    for name, t in items:
        tests[name].append(words(t))
    for r in longest:
        assert texts[r.doc_id][r.doc_word : r.doc_word + r.n_words] in [t[r.item_word : r.item_word + r.n_words] for t in tests[r.item_id]]
    assert {r.item_id for r in longest} == {i for r in rows for i in r.item_ids}


def test_a_passage_that_all_share_stays_linear():
    text = b"one passage that thousands of items and documents share word for word"
    block = d.TestItems.encode([(str(i), text) for i in range(5000)], 10)
    assert len(block.at) == 3
    got = d.search([text] * 5000, block)
    assert all(spans == [(0, 12)] and len(names) == 5000 for _, spans, names in got)
    assert len({id(names) for *_, names in got}) == 1
