from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from oddsmith.llm import pii, toxicity
from oddsmith.llm.queries import SURROGATE_KEY
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect() if model.judge(r.text.encode())[0] < 0.5}
    kept = {i for _, i in brute_kept(list(rows.items()))}
    rows = {i: t for i, t in rows.items() if i in kept}
    rows = {i: t for i, t in rows.items() if not brute(t, items)[1]}
    rows = {i: pii.pseudonymize(t, pii.Surrogates(SURROGATE_KEY))[0] for i, t in rows.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    got, lanes = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.start, r.length))
        lanes[r.sequence_id] += r.length
    assert {i: sum(n for _, n in p) for i, p in got.items()} == sizes
    assert max(lanes.values()) <= 1024 and np.mean(list(lanes.values())) > 1000


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "pii_surrogates", "packing"]
