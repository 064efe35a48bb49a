import os
from types import SimpleNamespace

import pytest

from assay.llm import common, decontaminate, embeddings, lmscore, nearcopies, sharding, simhash
from assay.llm.common import broadcast_if_small, components, release, scratch_dir, stored, tidy, unused


def left(spark):
    release(spark)
    folder = scratch_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    return lambda: {f for f in os.listdir(folder) if not f.startswith(".")} - before


def test_operators_leave_what_their_results_read(spark):
    tables = left(spark)
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more of them {i % 3}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "text 3 and more")], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 5), 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    marked = docs.selectExpr("doc_id", "text", "doc_id % 2 = 0 as target")
    runs = [lambda: simhash.near_duplicates(docs), lambda: nearcopies.one_of_each_group(docs), lambda: decontaminate.contamination(docs, items, size=3), lambda: decontaminate.clean_documents(docs, items, size=3), lambda: embeddings.links(vectors), lambda: sharding.assign(docs, 3), lambda: lmscore.score(marked)]
    for run in runs:
        assert tables() == set()
        df = run()
        n, there = df.count(), tables()
        assert n and len(there) <= 8
        assert {name for name in there if name not in common._folders(df)} == set()
        release(spark)
    assert tables() == set()


def test_tables_of_an_operator_that_fails_go(spark):
    tables = left(spark)

    @tidy
    def fails():
        stored(spark.range(3), "x")
        raise ValueError("no")

    with pytest.raises(ValueError):
        fails()
    assert tables() == set()


def test_inner_operators_hand_on_their_results(spark):
    tables = left(spark)

    @tidy
    def outer():
        parts = components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long"))
        return stored(parts, "out")

    got = outer()
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(tables()) == 1


def test_broadcasts_are_bounded_in_bytes_and_rows(spark, monkeypatch):
    hinted = lambda df: "BroadcastHint" in df._jdf.queryExecution().logical().toString() or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.createDataFrame([(1, "x" * 1000, ["a", "b"])] * 10, "k long, s string, a array<string>")
    assert hinted(broadcast_if_small(few))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 9000)
    assert not hinted(broadcast_if_small(few)) and hinted(broadcast_if_small(few.select("k")))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 9)
    assert not hinted(broadcast_if_small(few.select("k"))) and hinted(broadcast_if_small(few.limit(0)))


def test_no_local_folder_on_a_cluster():
    fake = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named), sparkContext=SimpleNamespace(master=master))
    assert scratch_dir(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(fake(master))


def test_unused_names(spark):
    assert unused(spark.createDataFrame([(1, 2)], "D int, _d int"), "d", "t", "d") == ["__d", "t", "___d"]
