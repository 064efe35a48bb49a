import random

import pytest
import xxhash

from assay.llm.simhash import fingerprint, linked_fingerprints, near_duplicates, op7_simhash

M = (1 << 64) - 1


def slow(text, k=3):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) & M).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "Two words Ünder É", "a b c a b c a b c", "x " * 70000, "A\x1fb c\x85d e"])
def test_fingerprint_of_whole_text(text):
    assert fingerprint(None if text is None else text.encode()) & M == slow(text)


def test_components_match_brute_force(spark):
    rng, fps = random.Random(1), set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f - (1 << 64) if f >> 63 else f)
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    edges = linked_fingerprints(spark.createDataFrame([(f,) for f in fps] * 2, "fp long"), 2).collect()
    assert all(bin((e.a ^ e.b) & M).count("1") <= 2 for e in edges)
    from assay.llm.common import components

    got = {r.node: r.component for r in components(spark.createDataFrame([(e.a, e.b) for e in edges], "a long, b long")).collect()}
    want = reach(fps, 2)
    assert all(len({got.get(f, f) for f in fps if want[f] == w}) == 1 for w in set(want.values()))
    assert len({got.get(f, f) for f in fps}) == len(set(want.values()))


def test_long_chain_is_one_component(spark):
    from assay.llm.common import components

    got = components(spark.range(1, 300).selectExpr("id as x", "id - 1 as y")).collect()
    assert len(got) == 300 and {r.component for r in got} == {0}


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (None, "same text here", 1), (7, "same text here", 1), (7, "same text here", 1), (9, "w " * 50000, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"), "doc_id", "text").collect()
    assert sorted((r.id if r.id is not None else -1, r.component_id) for r in got) == [(-1, 7), (1, 1), (3, 1), (7, 7), (7, 7), (9, 9)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_simhash(spark, sf).collect()}
    want = {d: slow(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in want.items()}
    parts = reach(set(want.values()), 2)
    least = {}
    for d in sorted(want, reverse=True):
        least[parts[want[d]]] = d
    assert {d: r.component_id for d, r in got.items()} == {d: least[parts[f]] for d, f in want.items()}
