import zlib
from collections import defaultdict

import pytest

from tessera.llm import sharding


def test_balance_and_slots(spark):
    texts = [None, "", *("x" * (i * 37 % 900) + str(i) for i in range(900)), *["hot copy " * 30] * 600, "y" * 5_000]
    docs = spark.createDataFrame([(i if i % 50 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int").repartition(6)
    rows = sharding.sharded(docs, 8).collect()
    assert sorted((r.id or -1, r.size, r.crc) for r in rows) == sorted(((i if i % 50 else None) or -1, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(abs(s - mean) for s in size.values()) <= 5_001
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = {r.shard for r in rows if r.size == len("hot copy " * 30) + 1}
    assert len(copies) < 8


@pytest.mark.parametrize(("per_range", "rows", "ranges"), [(1, 20, 4096), (2, 5, 64), (64, 50, 16)])
def test_ranges_are_subdivided_until_none_is_overfull(spark, monkeypatch, per_range, rows, ranges):
    for name, value in (("PER_RANGE", per_range), ("ROWS", rows), ("RANGES", ranges)):
        monkeypatch.setattr(sharding, name, value)
    texts = ["x" * (i * 37 % 400) + str(i) for i in range(1500)] + ["hot copy " * 30] * 700 + ["z" * 300_000, "w" * 90_000, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    seen = []
    real = sharding.ranged
    monkeypatch.setattr(sharding, "ranged", lambda r, s: seen.append(real(r, s)) or seen[-1])
    got = sharding.sharded(docs, 4).collect()
    assert sorted(r.id for r in got) == list(range(len(texts)))
    held = defaultdict(list)
    for r in seen[-1].collect():
        held[r.range].append(r.size)
    count = min(max(32, -(-len(texts) // rows)), max(32, ranges))
    assert len(seen) > 1 and all(len(s) == 1 or sum(s) <= 1.5 * sum(map(sum, held.values())) / count for s in held.values())
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * 300_001


def test_one_row_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 40 + [(None, None)], "doc_id long, text string")
    rows = sharding.sharded(docs, 8).collect()
    assert len(rows) == 41 and max(r.shard for r in rows) <= 7
    assert [(r.shard, r.slot) for r in sharding.sharded(docs.limit(1), 8).collect()] == [(4, 0)]


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
