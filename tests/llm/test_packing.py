from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm.packing import best_fit, op6_packing, pack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from("aaab") | st.none(), st.integers(0, 3) | st.none()), max_size=40))
def test_takes_the_tightest_compatible_bin(pieces):
    lengths, sources, clusters = ([p[i] for p in pieces] for i in range(3))
    bins, offsets = best_fit(lengths, sources, clusters, 12)
    state = {}
    for n, s, c, k, at in zip(lengths, sources, clusters, bins, offsets, strict=True):
        fit = [b["r"] for b in state.values() if b["r"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fit:
            assert k in state and state[k]["r"] == min(fit)
        else:
            assert k not in state
        b = state.setdefault(k, {"r": 12, "s": set(), "c": set()})
        assert at == 12 - b["r"] and (s is None or s not in b["s"]) and (c is None or c not in b["c"])
        b["r"] -= n
        b["s"].add(s)
        b["c"].add(c)
        assert b["r"] >= 0


def check(rows, capacity, source, cluster, length):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        if r.bin is not None:
            by_bin[r.bin].append(r)
    for d, some in by_doc.items():
        assert sum(r.n for r in some) == length[d]
        assert sorted((r.piece, r.start) for r in some) == [(k, k * capacity) for k in range(len(some))]
    for some in by_bin.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == [sum(x.n for x in some[:k]) for k in range(len(some))] and sum(r.n for r in some) <= capacity
        for of in (source, cluster):
            kinds = [of[r.id] for r in some if of[r.id] is not None]
            assert len(kinds) == len(set(kinds))


def test_odd_rows(spark):
    rows = [(1, "a", 5, 25), (2, "a", 5, 3), (3, None, None, 4), (4, "b", 5, 0), (5, "b", None, None), (6, "c", -(2**62) - 1, 10), (7, "d", -(2**62) - 1, 1), (8, "d", -(2**62), 9)]
    items = spark.createDataFrame(rows, "id long, source string, cluster long, length long").selectExpr("*", "7 as bin", "'x' as row", "1 as piece")
    got = pack(items, capacity=10, group=100).collect()
    check(got, 10, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, {r[0]: r[3] or 0 for r in rows})
    assert {r.id for r in got if r.bin is None} == {4, 5}
    assert pack(items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack(items, capacity=0)


def test_repeated_rows_and_null_ids_keep_their_pieces(spark):
    got = pack(spark.createDataFrame([(None, "a", 1, 2)] * 30, "id long, source string, cluster long, length long"), capacity=10, group=8).collect()
    assert len(got) == 30 and len({r.bin for r in got}) == 30


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_packing(spark, sf).toDF("id", "piece", "start", "n", "bin", "offset").collect()
    length = {d: len([w for w in r.text.translate({c: 32 for c in range(9, 14)}).split(" ") if w]) for d, r in docs.items()}
    check(got, 2048, {d: r.source for d, r in docs.items()}, {d: r.text for d, r in docs.items()}, length)
    assert {r.id for r in got} == set(docs)
