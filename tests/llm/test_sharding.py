import zlib

from onsetframe.llm import sharding

SCHEMA = "doc_id long, text string, part int, place string, size string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "p", "s") for d, t in rows], SCHEMA)


def checked(rows, shards):
    by_shard = {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 16
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
        by_shard.setdefault(r.shard, []).append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    ordered = [by_shard[s] for s in sorted(by_shard)]
    for one, other in zip(ordered, ordered[1:]):  # key ranges follow each other
        assert max(r.sort_key for r in one) < min(r.sort_key for r in other)
    return [sum(r.size for r in by_shard.get(s, [])) for s in range(shards)]


def test_equal_bytes_and_neighbours(spark):
    rows = [(i, f"{i % 700} " * (1 + i * 31 % 97)) for i in range(3000)]
    out = sharding.shard_documents(table(spark, rows), shards=8).collect()
    assert len(out) == 3000 and "place" in out[0]
    sizes = checked(out, 8)
    mean = sum(sizes) / 8
    slack = sharding.TOLERANCE * mean + max(r.size for r in out)
    assert all(abs(s - mean) <= 2 * slack for s in sizes)


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text for a third of all rows") for i in range(1000)]
    rows += [(i, f"text {i} of its own, about as long as it") for i in range(1000, 3000)]
    out = sharding.shard_documents(table(spark, rows), shards=10).collect()
    sizes = checked(out, 10)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 10 + 200


def test_small_groups_stay_together(spark):
    rows = [(i, f"text of group {i // 3}") for i in range(3000)]
    out = sharding.shard_documents(table(spark, rows), shards=4).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_edges(spark):
    rows = [(None, "a"), (1, None), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000), (4, "é")]
    out = sharding.shard_documents(table(spark, rows), shards=5).collect()
    assert len(out) == 6
    checked(out, 5)
    assert len({r.shard for r in out if r.doc_id == 3}) == 1
    assert sharding.shard_documents(table(spark, rows).limit(0), shards=5).count() == 0


def test_same_shards_again(spark):
    docs = table(spark, [(i, f"t{i * 7}") for i in range(500)])
    one, other = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs, 6).collect()) for _ in range(2))
    assert one == other
