import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddsmith.llm import packing, tokens
from oddsmith.llm.tokens import CachedBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN, LIBRARY = CachedBpe(PATH), Tokenizer.from_file(PATH)


def library_ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=20))
def test_patterns_meet_the_demand(demand):
    plan = packing.whole_patterns(demand, 32)
    got = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 32 and times > 0
        got.update({n: c * times for n, c in Counter(pattern).items()})
    assert got == Counter(demand)
    patterns, bound = packing.cutting_stock(demand, 32)
    total = sum(n * c for n, c in demand.items())
    met = Counter()
    for pattern, v in patterns:
        for n, c in pattern.items():
            met[n] += c * v
    assert all(abs(met[n] - c) < 1e-6 for n, c in demand.items())
    assert sum(v for _, v in patterns) >= max(bound, total / 32) - 1e-6 and bound <= sum(t for _, t in plan) + 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " "]), st.text(st.sampled_from("abé 'sT1²_\n\t\x85\xa0\x1c-漢🙂ǅ"), max_size=60)), max_size=4).map("".join))
def test_ids_are_those_of_the_library(text):
    assert OWN.encode([text, None, ""]) == [library_ids(text), b"", b""]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "_LONG", 50)
    monkeypatch.setattr(tokens, "_AT_ONCE", 20)
    text = " ".join(f"w{i} 漢字 it's  <|endoftext|> a\n b <|end of|>" for i in range(60))
    for t in (text, text.replace("漢字", "x"), text.replace(" ", ""), "x" * 500 + text):
        assert OWN.encode([t, t]) == [library_ids(t)] * 2


@pytest.mark.parametrize("bucket_pieces", [packing.BUCKET_PIECES, 7])
def test_every_id_in_one_piece(spark, monkeypatch, bucket_pieces):
    monkeypatch.setattr(packing, "BUCKET_PIECES", bucket_pieces)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("offset", packing.F.lit("x"))
    odd = [(None, None, "x"), (-1, "", None), (-2, "same", "x"), (-2, "same", "x"), (-3, "long <|endoftext|> " * 9000, "x")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string, offset string"))
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    want = Counter(library_ids(r.text or "") + b"\0\0\0\0" for r in docs.collect())
    own, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        own[r.doc_id].append(r)
        lanes[r.sequence_id].append((r.offset, r.length))
    assert sorted(lanes) == list(range(len(lanes)))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert total / (1024 * len(lanes)) > 0.99
    got = Counter()
    for doc, pieces in own.items():
        copies = Counter((p.start, bytes(p.ids)) for p in pieces)
        n = min(copies.values())
        assert doc == -2 or n == 1
        got[b"".join(ids for _, ids in sorted(copies))] += n
    assert got == want
    assert packing.pack(docs.limit(0), PATH).count() == 0
