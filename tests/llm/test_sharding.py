import zlib
from collections import Counter

import pytest

from tokenloom.llm import sharding


def jump(key, shards):
    """The published loop, on Python's own integers."""
    state, bucket, target = key % 2**64, -1, 0
    while target < shards:
        bucket = target
        state = (state * 2862933555777941757 + 1) % 2**64
        target = int((bucket + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return bucket


KEYS = [0, 1, -1, 7, 2**62, -2**63, 2**63 - 1, 123456789, *range(1000, 1040)]


@pytest.mark.parametrize("shards", [1, 2, 12, 13, 300])
def test_shards_follow_the_published_loop(spark, shards):
    found = sharding.assign_shards(spark.createDataFrame([(k,) for k in KEYS], "k bigint"), "k", shards).collect()
    assert all(r.shard == jump(r.k, shards) for r in found)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    found = sharding.assign_shards(sharding.assign_shards(spark.range(4000), "id", 40, "old"), "id", 41, "new").collect()
    moved = [r for r in found if r.old != r.new]
    assert {r.new for r in moved} == {40} and 50 < len(moved) < 160
    assert max(Counter(r.old for r in found).values()) < 200


def test_manifest_of_hard_rows(hard):
    found = sharding.shard_manifest(hard, "doc_id", "text", 3, chunk=1).collect()
    texts = {(r.doc_id, r.text) for r in hard.collect()}
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), jump(i or 0, 3), jump(i or 0, 4))
                   for i, t in [(r.doc_id, r.text) for r in hard.collect()])
    assert texts and Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found) == want
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_other_key_types_and_empty_tables(spark):
    named = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    found = sharding.assign_shards(named, "k", 5).collect()
    assert len(found) == 4 and len({r.shard for r in found if r.k == "a"}) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_manifest(empty, "doc_id", "text", 40).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(named, "k", 0)
