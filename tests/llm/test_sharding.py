"""Shards of nearly equal bytes, whole groups of equal texts, slots without gaps."""

import zlib
from collections import Counter, defaultdict

import pytest

from colsql.llm import sharding


def check(rows, text, shards, off):
    """text: what each doc_id has."""
    size, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    assert set(size) <= set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(size.values()) / shards
    assert all(abs(size[s] - mean) <= off * mean for s in range(shards)), size
    return groups


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_whole_table(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = check(sharding.shard(docs, shards).collect(), {r.doc_id: r.text for r in docs.collect()}, shards, 0.03)
    assert all(len(x) == 1 for x in groups.values())


def test_a_group_with_a_third_of_all_rows(spark):
    text = {i: "the same text for all of these" if i % 3 == 0 else f"text {i} " + "x" * (i % 50) for i in range(6000)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 7}") for i, t in text.items()], "doc_id long, text string, lang string, source string")
    groups = check(sharding.shard(docs, 8).collect(), text, 8, 0.02)
    assert len(groups[b"the same text for all of these"]) > 1 and all(len(x) == 1 for t, x in groups.items() if not t.startswith(b"the"))


def test_groups_nearly_as_large_as_a_shard_stay_whole(spark):
    text = {i: f"group {i % 4} " * 20 if i < 800 else f"text {i} " + "y" * (i % 90) for i in range(9000)}
    docs = spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")
    groups = check(sharding.shard(docs, 16).collect(), text, 16, 0.02)
    assert all(len(x) == 1 for x in groups.values())


def test_target_bytes(spark):
    text = {i: "z" * 99 for i in range(500)} | {1000 + i: f"{i:099d}" for i in range(500)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    rows = sharding.shard(docs, None, target_bytes=25_000).collect()
    assert len({r.shard for r in rows}) == 4
    check(rows, text, 4, 0.02)


def test_fewer_texts_than_shards(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, text string")
    got = sharding.shard(rows, 16).collect()
    assert len(got) == 3 and all(0 <= r.shard < 16 for r in got)


def test_thousands_of_shards(spark):
    """Plans don't grow with the number of shards."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', id, repeat('x', cast(id % 70 as int))) AS text", "CASE WHEN id % 3 = 0 THEN 'en' ELSE 'de' END AS lang", "concat('s', id % 11) AS source")
    rows = sharding.shard(docs, 2048).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 2048
    assert len(rows) == 40_000 and len(size) == 2048 and max(size.values()) < 2 * mean and min(size.values()) > mean / 3
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_rows_equal_in_all_ways(spark):
    """A third of all rows have one doc_id and text."""
    rows = sharding.shard(spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one text' ELSE concat('text ', id) END AS text"), 4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
