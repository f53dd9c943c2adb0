from collections import Counter

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from oddsmith.llm import common, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def as_set(df):
    return {tuple(r) for r in df.select("source", "lang", "tokenizer_version", "n_docs", "n_tokens", "n_bytes").collect()}


def batch(spark, rows):
    return spark.createDataFrame(rows, tokencounts.CHANGE)


def test_totals_equal_a_recount(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, "é", "en", "s", 1), (-3, "é", "en", "s", 1), (-3, "two more", "de", "s", 1), (None, "no id", "en", "s", 1), (-4, "word <|endoftext|> " * 50000, "xx", "s", 9)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("op", docs["lang"])
    library, sums = Tokenizer.from_file(PATH), {}
    for r in docs.collect():
        n = (1, len(library.encode(r.text or "", add_special_tokens=False).ids), len((r.text or "").encode()))
        key = (r.source, r.lang, "v1")
        sums[key] = tuple(a + b for a, b in zip(sums.get(key, (0, 0, 0)), n, strict=True))
    path = common.fresh_path(spark, "ledger")
    assert as_set(tokencounts.maintained_totals(docs, path, PATH, "v1")) == {(*k, *v) for k, v in sums.items()}
    assert len(tokencounts.Ledger(spark, path).commits()) == 2


def test_signed_changes_and_replays(spark):
    ledger = tokencounts.Ledger(spark, common.fresh_path(spark, "ledger"))
    assert as_set(ledger.totals()) == set()
    one = batch(spark, [("a", "v", "upsert", "s", "en", 1, 5, 9), ("b", "v", "upsert", "s", "en", 1, 2, 3), ("b", "w", "upsert", "s", "en", None, 7, 3), (None, "v", "upsert", "s", "en", 1, 1, 1)])
    assert ledger.apply("it's 1/2", one) and not ledger.apply("it's 1/2", one)
    assert as_set(ledger.totals()) == {("s", "en", "v", 2, 7, 12), ("s", "en", "w", 1, 7, 3)}
    gone = (None,) * 5
    two = [("a", "v", "upsert", "t", "en", 1, 6, 9), ("a", "v", "delete", *gone), ("b", "v", "delete", *gone), ("zz", "v", "delete", *gone), ("c", "v", "upsert", None, None, 1, 1, None), ("c", "v", "upsert", None, None, 1, 1, None)]
    assert ledger.apply("2", batch(spark, two)) and not ledger.apply("2", batch(spark, two))
    assert as_set(ledger.totals()) == {("t", "en", "v", 1, 6, 9), ("s", "en", "w", 1, 7, 3), (None, None, "v", 2, 2, 0)}
    assert ledger.apply("3", batch(spark, [("b", "v", "upsert", "s", "en", 1, 4, 4), ("a", "v", "delete", *gone), ("c", "v", "upsert", "s", "en", 1, 9, 9)])) and ledger.apply("4", one.limit(0))
    assert as_set(ledger.totals()) == {("s", "en", "v", 2, 13, 13), ("s", "en", "w", 1, 7, 3)}
    assert Counter(c.seq for c in ledger.commits()) == Counter([1, 2, 3, 4])


def test_compaction_against_a_replay(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "COMPACT_EVERY", 2)
    ledger, live = tokencounts.Ledger(spark, common.fresh_path(spark, "ledger")), {}
    for n in range(5):
        rows = [(f"k{i}", "v", "delete" if (i + n) % 3 == 0 else "upsert", f"s{(i + n) % 2}", "en", 1, i + n, n) for i in range(n, n + 6)]
        for key, _, op, source, _, docs, tokens, size in rows:
            live.pop(key, None)
            if op == "upsert":
                live[key] = (source, docs, tokens, size)
        assert ledger.apply(str(n), batch(spark, rows))
        want = {}
        for source, *own in live.values():
            want[source] = [a + b for a, b in zip(want.get(source, [0, 0, 0]), own, strict=True)]
        assert as_set(ledger.totals()) == {(k, "en", "v", *v) for k, v in want.items()}
    assert [c.compacted for c in ledger.commits()] == [False, False, True, False, True]


def test_a_writer_that_died_does_not_count_or_block(spark, monkeypatch):
    ledger = tokencounts.Ledger(spark, common.fresh_path(spark, "ledger"))
    rows = batch(spark, [("a", "v", "upsert", "s", "en", 1, 5, 9)])

    def dies(self, attempt, seq):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tokencounts.Ledger, "_published", dies)
        with pytest.raises(RuntimeError):
            ledger.apply("1", rows)
    assert as_set(ledger.totals()) == set()
    assert ledger.apply("1", rows) and as_set(ledger.totals()) == {("s", "en", "v", 1, 5, 9)}


def test_an_overtaken_writer_starts_again(spark, monkeypatch):
    ledger = tokencounts.Ledger(spark, common.fresh_path(spark, "ledger"))
    assert ledger.apply("0", batch(spark, [("a", "v", "upsert", "s", "en", 1, 5, 5)]))
    other, real = tokencounts.Ledger(spark, ledger.path), tokencounts.Ledger._published

    def overtaken(self, attempt, seq):
        monkeypatch.setattr(tokencounts.Ledger, "_published", real)
        assert other.apply("other", batch(spark, [("a", "v", "upsert", "s", "en", 1, 7, 7)]))
        return real(self, attempt, seq)

    monkeypatch.setattr(tokencounts.Ledger, "_published", overtaken)
    assert ledger.apply("own", batch(spark, [("a", "v", "upsert", "s", "en", 1, 9, 9)]))
    assert [c.batch for c in ledger.commits()] == ["0", "other", "own"] and as_set(ledger.totals()) == {("s", "en", "v", 1, 9, 9)}
