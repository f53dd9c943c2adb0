import zlib
from collections import defaultdict

import pytest

from oddsmith.llm import common, sharding


def test_every_row_once_gapless_and_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("shard", common.F.lit("mine"))
    odd = [(None, None, "x"), (None, "a", "x"), (-1, "", None), (-2, None, "x"), (-3, "é", "x"), (-3, "é", "x"), (-4, "long " * 20000, "x")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string, shard string"))
    rows = sharding.assign_shards(docs, common.fresh_path(spark, "map")).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8))
    loads = [sum(r["size"] for r in x) for x in by.values()]
    assert max(loads) - min(loads) <= 0.005 * sum(loads) / 8 and {r.map_version for r in rows} == {2}
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    assert len({(r.doc_id, r.virtual_slot) for r in rows if r.doc_id is not None}) == len({r.doc_id for r in rows if r.doc_id is not None})
    assert sharding.assign_shards(docs.limit(0), common.fresh_path(spark, "map")).count() == 0


def test_map_versions(spark):
    size = [(i * 7919) % 1000 for i in range(256)]
    first = sharding.SlotMap.initial(8, 256)
    even = first.rebalanced(size)
    loads = even.loads(size)
    assert max(loads) - min(loads) <= max(2, 0.001 * sum(loads) / 8) and even.version == 2
    assert sum(a != b for a, b in zip(first.shard_of, even.shard_of, strict=True)) < 64
    more = even.grown(size)
    assert {b for a, b in zip(even.shard_of, more.shard_of, strict=True) if a != b} == {8}
    assert more.loads(size)[8] > 0.9 * sum(size) / 9
    path = common.fresh_path(spark, "map")
    for m in (first, even, more):
        m.store(spark, path)
    assert sharding.SlotMap.load(spark, path) == more and sharding.SlotMap.load(spark, path, 1) == first
    with pytest.raises(Exception, match="(?i)exists"):
        even.store(spark, path)
