import random
from collections import defaultdict

import pytest
import xxhash

from oddsmith.llm import simhash


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=2):
    ids = list(range(len(rows)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                ids[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted((rows[i][0], min(least[root(i)])) for i in range(len(rows)))


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "Ab"), (900005, "aB"), (900006, "É a b c"), (900006, "É a b c"), (900007, "x y z " * 70000)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    found = simhash.near_duplicate_classes(docs).collect()
    assert sorted((r.doc_id, r.fp % 2**64) for r in found) == sorted(rows)
    assert sorted((r.doc_id, r.component_id) for r in found) == brute_components(rows)


def test_chain_of_links_and_sign_bit(spark):
    fps = [0, 3, 15, 63, -1, (1 << 63) - 1, -(1 << 63), 1 << 40]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in fps], "fp bigint")).collect()
    near = {(max(a, b), min(a, b)) for a in fps for b in fps if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.u, r.v) for r in links} == near


def test_other_radii(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), n)) for x in fps for n in (1, 2, 3, 4, 5)] + [0, 7, 15, 31]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    links = [(r.u, r.v) for r in simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4).collect()]
    root = dict(brute_components([(x, x % 2**64) for x in signed], 4))
    joined = {x: x for x in signed}

    def own(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in links:
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 4
        a, b = sorted((own(u), own(v)))
        joined[b] = a
    assert {x: own(x) for x in signed} == root
    for bits in (1, 3):
        with pytest.raises(ValueError):
            simhash.ball_links(spark.createDataFrame([(0,), (7,)], "fp bigint"), bits)


def test_drop_keeps_one_and_all_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x", 1), (1, "A b c d", "y", 2), (2, "other words stay here", "z", 3), (None, None, None, 4)], "doc_id long, text string, fp string, component_id int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component_id for r in kept.collect()) == [2, 3, 4]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def brute_kept(rows, least=0.8):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both):
                part = [part[j] if p == part[i] else p for p in part]
    best = {}
    for p, (doc, _) in zip(part, rows, strict=True):
        best[p] = min(best.get(p, (True, 0)), (doc is None, doc or 0))
    return sorted(best.values())


def test_drop_reaches_jaccard_of_four_fifths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = [f"w{i}" for i in range(200)]
    edited = [words[:at] + ["new"] + words[at + 1 :] for at in range(5, 200, 12)]  # of the base 0.95 alike, of each other 0.9
    far = words[:3] + [w if i % 30 else "far" for i, w in enumerate(words[3:])]  # seven edits: below 0.8 of the base
    rows = [(900000 + i, " ".join(w)) for i, w in enumerate([words, *edited])] + [(900100, " ".join(far)), (None, "only null ids in this class"), (None, "Only null ids in this class"), (900200, "a b"), (900200, "a b")]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert (False, 900000) in kept and (False, 900001) not in kept and kept.count((False, 900200)) == 1 and kept.count((True, 0)) == 1


def test_candidates_of_a_large_group_stay_linear(spark):
    n = 300
    sets = spark.createDataFrame([(i, list(range(simhash.BANDS))) for i in range(n)], "row long, bands array<long>")
    assert n - 1 <= simhash.candidate_pairs(sets).count() <= 2 * simhash.BANDS * n


def test_stage_links_by_the_ball(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1100], "new", *words[1101:]]), "quite another text of seven words", None]
    fps = [simhash.simhash64(t.encode()) if t else None for t in texts]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= 2
    signed = [None if x is None else x - (1 << 64) if x >> 63 else x for x in fps]
    rows = [*enumerate(signed), (4, signed[2])]
    assert sorted(simhash.ball_pairs(spark.createDataFrame(rows, "row long, fp long")).collect()) == [(1, 0), (4, 2)]
    monkeypatch.setattr(simhash, "candidate_pairs", lambda sets: sets.selectExpr("row u", "row v").where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2, 3]


def test_ball_pairs_of_a_large_group_stay_linear(spark):
    n = 300
    assert n - 1 <= simhash.ball_pairs(spark.createDataFrame([(i, 5) for i in range(n)], "row long, fp long")).count() <= 2 * n


def edited_twins(groups):
    """Up to 169 texts of a base of 300 words with four words changed, two texts at one place in common at most, each beside a twin of six words more.

    Twins are 0.816 alike, any others less than 0.8, and most of what twins share they share with all.
    """
    rng, words, rows = random.Random(9), [f"w{i}" for i in range(300)], []
    for g in range(groups):
        own, places = list(words), [13 * j + (g % 13 + j * (g // 13)) % 13 for j in range(4)]
        for i in places:
            own[5 + 5 * i] = f"own{g}"
        twin = list(own)
        for i in rng.sample([i for i in range(58) if i not in places], 6):
            twin[5 + 5 * i] = f"twin{g}"
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(twin))]
    return rows


def test_large_buckets_lose_no_link(spark):
    rows = edited_twins(169)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted((False, r.doc_id) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == brute_kept(rows) and len(kept) == 169


def test_remaining_pairs_hold_all_that_are_alike(spark, monkeypatch):
    """Without any candidates of the first round the classes are the same; pairs of one part are not formed again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(900000 + i, t) for i, t in edited_twins(8)] + [(900100 + n, " ".join(f"v{i}" for i in range(n))) for n in range(1, 40)] + [(None, "only null ids"), (900200, ""), (900201, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    none = lambda sets: sets.selectExpr("row u", "row v").where("false")
    monkeypatch.setattr(simhash, "candidate_pairs", none)
    monkeypatch.setattr(simhash, "ball_pairs", none)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    prefixes = spark.createDataFrame([(1, 5, 0, 7), (2, 5, 0, 7), (3, 5, 0, 7), (4, 9, 0, 7), (5, 5, 1, 8), (6, 5, 1, 8)], "row long, n int, at int, token long")
    parts = spark.createDataFrame([(2, 1), (1, 1)], "node long, root long")
    assert sorted(simhash.remaining_pairs(prefixes, parts, 0.8).collect()) == [(3, 1), (3, 2)]
