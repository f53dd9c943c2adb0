import random
import re
from collections import Counter, defaultdict

from oddsmith.llm import divergence


def brute(docs, least=3, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    freq, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        freq[lang].update(set(words))
        groups[lang, source].update(words)
    rows = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in freq[lang].items() if n >= least)
        own = {s: [groups[lang, s][t] for t in kept] for g, s in groups if g == lang}
        share = lambda n: [1 + 1_000_000_000 * (x + 1) // (sum(n) + len(kept)) for x in n]
        p = {s: share(n) for s, n in own.items()}
        q = share([sum(x) for x in zip(*own.values())]) if kept else []
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            listed = {"pair": [(sum(map(gap, p[s], p[o])), o) for o in own if o != s], "term": [(gap(a, b), t) for a, b, t, n in zip(p[s], q, kept, own[s]) if n and a > b]}
            for part, found in listed.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return Counter(rows)


def odd_docs():
    random.seed(11)
    words = [f"{a}{b}" for a in "abcdefgHIJKé" for b in ("", "x", "Y", "ß", "漢", " z")]
    long = "q" * 400
    docs = [(random.choice(["en", "fr", None]), random.choice(["s1", "s2", "s3", "é", ""]), " ".join(random.choices(words, weights=range(1, len(words) + 1), k=random.randint(0, 60)))) for _ in range(150)]
    docs += [("en", "s1", f"{long} don't {long}X a1b2c {long}é"), ("en", "s2", long.upper()), ("en", "s4", f"x {long} {long}"), ("en", None, None)]
    docs += [("de", "only", "eins zwei")] * 5 + [("xx", "a", "rare"), ("xx", "b", "once"), ("xx", "c", "")]
    docs += [("en", "hot", "same words here, same words there")] * 60 + [("en", "big", "abc hot aa " * 120_000 + "\x00\x7f[\\]^_`{|}~@")]
    return docs


def test_against_brute_force(spark):
    docs = odd_docs()
    df = spark.createDataFrame(docs, "lang string, source string, text string").selectExpr("*", "'x' AS term", "1 AS chunk", "2 AS value").repartition(3)
    want = brute(docs)
    for size in (divergence.CHUNK, 3000):
        assert Counter(map(tuple, divergence.divergences(df, size=size).collect())) == want
    assert divergence.divergences(df.limit(0)).collect() == []
    top = divergence.divergences(df, least=1, top=3)
    assert Counter(map(tuple, top.collect())) == brute(docs, 1, 3)


def test_pieces_of_long_texts():
    data = b"ab " * 700_000 + b"x" * 3_000_000 + b" end"
    pieces = list(divergence._pieces(data))
    assert b"".join(pieces) == data and [w for p in pieces for w in p.split()] == data.split()
    rows = list(divergence._Chunk().add("l", "s", data))
    assert len(rows) >= 2 and all(len(divergence._unsqueezed(r[2])) < divergence.PIECE + (1 << 13) for r in rows)
