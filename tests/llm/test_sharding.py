import random
import zlib
from collections import defaultdict

import pytest

from assay.llm import sharding
from assay.llm.sharding import assign, op1_sharding, plan, write_shards


def check(rows, shards, off=0.02):
    load, slots = [0] * shards, defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for some in slots.values():
        assert sorted(some) == list(range(len(some)))
    assert max(load) - min(load) <= off * sum(load) / shards, load


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()} and len(got) == len(texts)
    check(got, 8)
    shards = defaultdict(set)
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_hot_text_is_divided_only_if_over_a_shard(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(10000 + i, f"text {i:05d}") for i in range(6000)]
    got = assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(got, 4, 0.1)
    rows = [(i, "hot text") for i in range(500)] + [(10000 + i, f"text {i:05d}") for i in range(6000)]
    got = assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(got, 4, 0.05)
    assert len({r.shard for r in got if r.id < 10000}) == 1


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, None), (2, ""), (2, ""), (3, "é" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as key", "3 as shard", "4 as range")
    got = assign(df, 3).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 2, 2, 200001]
    check(got, 3, 10)
    assert assign(df.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        assign(df, 0)
    write_shards(df, 3, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["doc_id", "text", "size", "key", "range", "slot", "shard"]
    assert sorted(((r.doc_id, r.text, r.size, r.key, r.range) for r in got.collect()), key=repr) == sorted(((d, t, 1, 2, 4) for d, t in rows), key=repr)
    for s in range(3):
        assert sorted(r.slot for r in got.where(f"shard = {s}").collect()) == list(range(got.where(f"shard = {s}").count()))


def test_hot_repeated_rows_are_divided(spark):
    """Rows that agree in id and text, far more than a shard's share, and rows without an id."""
    rows = [(7, "x" * 60)] * 6000 + [(None, "y" * 50)] * 3000 + [(i, f"text {i:06d}") for i in range(2000)]
    got = assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(got) == len(rows)
    check(got, 8, 0.15)


def slow_deal(units, shards, total):
    """Largest first, each to the shard with the least: by looking at all shards each time."""
    load, homes = [0.0] * shards, {}
    for size, r, p in sorted(units, key=lambda d: (-d[0], d[1], d[2])):
        s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += size
        homes[r, p] = s
    return homes


def test_deal_matches_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        shards = rng.randrange(1, 6)
        units = [(2 * r, rng.randrange(1, 100), 1, 0) for r in range(rng.randrange(1, 40))]
        total = sum(u[1] for u in units)
        fair = max(1.0, total / (shards * sharding.RANGES_A_SHARD))
        parts, homes = plan(units, shards, total)
        assert all(parts[r] == (round(size / fair) if size > 2 * fair else 1) for r, size, _, _ in units)
        want = slow_deal([(size, r, 0) for r, size, _, _ in units], shards, total)
        assert all(set(homes[r]) == {want[r, 0]} and len(homes[r]) == parts[r] for r in homes)


def test_assignment_matches_brute_force(spark):
    """The whole assignment by plain Python, from the splitters that the sample gave."""
    rows = [(i % 50 or None, f"text {i % 37}" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    records = sharding._records(df, "doc_id", "text")
    every = [r.asDict() for r in records.collect()]
    total = sum(r["size"] for r in every)
    cuts = sharding._splitters(records, 3 * sharding.RANGES_A_SHARD, total)
    assert cuts == sorted(cuts) and set(cuts) <= {r["key"] for r in every}
    for r in every:
        r["range"] = 2 * sum(c < r["key"] for c in cuts) + (r["key"] in cuts)
    sums = defaultdict(lambda: [0, 0])
    for r in every:
        sums[r["range"]][0] += r["size"]
        sums[r["range"]][1] += 1
    parts, homes = plan([(k, size, n, size if k % 2 else 0) for k, (size, n) in sums.items()], 3, total)
    hashed = {(r.row, c): h for r in records.selectExpr("row", "xxhash64(row) as a", "xxhash64(key) as b").collect() for c, h in (("a", r.a), ("b", r.b))}
    groups = defaultdict(list)
    for r in every:
        part = hashed[r["row"], "a" if r["range"] % 2 else "b"] % parts[r["range"]] if parts[r["range"]] > 1 else 0
        groups[r["range"], part].append(r)
    first, want = defaultdict(int), {}
    for range_, part in sorted(groups):
        s = homes[range_][part]
        for r in sorted(groups[range_, part], key=lambda r: (r["key"], r["id"] is not None, r["id"] or 0, r["row"])):
            want[r["row"]] = (r["size"], r["text_crc32"], s, first[s])
            first[s] += 1
    got = {r.row: (r["size"], r.text_crc32, r.shard, r.slot) for r in sharding._assigned(records, 3).collect()}
    assert got == want
