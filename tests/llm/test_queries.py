import re

import pytest

from oddsmith.llm import queries

SF = "/root/testdata/sf0.001"
#: The columns that the registered queries promise; more may follow.
PROMISED = {
    "op1_": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_": "doc_id bigint, text string",
    "op6_": "page_id bigint, lang string, confidence double",
    "op7_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_": "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_bytes bigint",
    "op11_": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op13_": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


def test_one_query_per_operator():
    assert sorted(re.match(r"op\d+_", n)[0] for n in queries.queries()) == sorted(PROMISED)


@pytest.mark.parametrize("prefix", sorted(PROMISED))
def test_promised_columns(spark, prefix):
    name = next(n for n in queries.queries() if n.startswith(prefix))
    df = queries.queries()[name](spark, SF)
    promised = [tuple(c.split(" ")) for c in PROMISED[prefix].split(", ")]
    assert [t for t in df.dtypes if t in promised] == promised
    rows = df.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    if prefix in ("op2_", "op3_", "op5_", "op7_", "op8_", "op9_", "op12_"):
        assert len(rows) == docs
    if prefix == "op8_":
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
