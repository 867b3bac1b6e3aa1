import zlib
from collections import Counter

from corpusmill.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string"


def test_shards(spark):
    rows = [(i, "x" * (i % 97) + "é", "clash", "clash") for i in range(5000)] + [(7, "again", "", ""), (9000, None, "", ""), (None, "none", "", ""), (9001, "", "", ""), (None, "none", "", ""), (9002, "y" * 100_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sharding.shards(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    loads = sorted(sum(r.size for r in rs) for rs in by.values())
    assert loads[-2] < 1.05 * loads[0]  # but for the shard of the one huge record
    where = {(r.doc_id, r.size): r.shard for r in got}
    assert where == {(r.doc_id, r.size): r.shard for r in sharding.shards(df.repartition(7)).collect()}


def test_map_versions(spark):
    df = spark.createDataFrame([(i, "t" * (i % 50), "", "") for i in range(3000)], SCHEMA)
    sizes = sharding.slot_sizes(df, slots=512)
    one = sharding.SlotMap.balanced(sizes, 8, 512)
    two = one.grow(sizes)
    moved = [(a, b) for a, b in zip(one.current, two.current) if a != b]
    assert moved and {b for _, b in moved} == {8}
    loads = two.loads(sizes)
    assert max(loads.values()) < 1.1 * min(loads.values())
    skewed = {**sizes, **{s: 20 * sizes.get(s, 1) for s in range(512) if one.current[s] == 0}}
    three = one.rebalance(skewed)
    before, after = one.loads(skewed), three.loads(skewed)
    assert max(after.values()) < max(before.values())
    path = two.save(spark)
    assert sharding.SlotMap.load(spark, path) == two
    out = sharding.assign(df, 8, one)
    assert {"size", "vslot", "shard", "text"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert out.count() == 3000


def test_stored_map_is_kept(spark, tmp_path):
    rows = [(i, "t" * (i % 50), "", "") for i in range(3000)]
    df, path = spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/map"
    place = lambda d, n=8: {r.doc_id: (r.shard, r.slot) for r in sharding.shards(d, n, path).collect()}
    one = place(df)
    assert place(df.repartition(5)) == one and len(sharding.SlotMap.load(spark, path).versions) == 1
    grown = place(df, 9)
    kept = sharding.SlotMap.load(spark, path)
    assert len(kept.versions) >= 2 and {b for a, b in zip(kept.versions[0], kept.versions[1]) if a != b} == {8}
    assert any(s == 8 for s, _ in grown.values())
    more = spark.createDataFrame(rows + [(9000 + i, "long " * 400, "", "") for i in range(40)], SCHEMA)
    assert len(place(more, 9)) == 3040
    again = sharding.SlotMap.load(spark, path)
    assert again.versions[: len(kept.versions)] == kept.versions
    loads = again.loads(sharding.slot_sizes(more))
    assert max(loads.values()) < 1.2 * sum(loads.values()) / 9


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.shards(df).collect() == []
    assert sharding.assign(df, 4).collect() == []
