import numpy as np
import pytest

from assay.llm import embeddings
from assay.llm.embeddings import _hadamard, buckets, classes_of, links, op4_embeddings, unit


def slow(rows, least=0.95):
    """(id, links, component) by all cosines."""
    x, good = zip(*(unit([v]) for _, v in rows), strict=True)
    ok = [bool(g[0]) for g in good]
    n, parent = len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    counts = [0] * n
    by_len = {}
    for i in range(n):
        if ok[i]:
            by_len.setdefault(x[i].shape[1], []).append(i)
    for own in by_len.values():
        m = np.concatenate([x[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= least, 1)), strict=True):
            a, b = own[a], own[b]
            counts[a] += 1
            counts[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least_id = {}
    for i in range(n):
        if rows[i][0] is not None:
            least_id[root(i)] = min(least_id.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], counts[i], least_id.get(root(i))) for i in range(n)]


def test_parts():
    x = np.random.default_rng(0).standard_normal((5, 8))
    y = _hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(_hadamard(y), x)
    assert (buckets(x, 1, 9, 4) >= 0).all() and (buckets(x, 1, 9, 4) < 512).all()
    assert sorted(np.concatenate(classes_of(x, -1.0, 2)).tolist()) == list(range(5))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_embeddings(spark, sf).collect()}
    want = {i: (n, c, i == c) for i, n, c in slow(rows)}
    assert len(got) == len(rows)
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * there


def test_links_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        for s in (0.3, 0.33, 0.4):
            e = rng.standard_normal(64)
            e -= (e @ c) * c
            rows.append((len(rows), (c + s * e / np.linalg.norm(e)).tolist()))
        rows.append((len(rows), c.tolist()))
    got = links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), similarity=0.95).collect()
    want = slow(rows)
    found, there = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    print("recall near the threshold", found / there, there)
    assert 0.9 * there <= found <= there


@pytest.mark.parametrize("n", [300, 1200])
def test_large_groups_stay_few_rows(spark, monkeypatch, n):
    """Equal vectors, very close ones and a hot bucket: exact links from a number of pairs that does not grow with the group."""
    monkeypatch.setattr(embeddings, "GROUP", 64)
    made, counts = {}, {}
    store, drop = embeddings.stored, embeddings.dropped

    def kept(df, name, *more):
        made[name] = store(df, name, *more)
        return made[name]

    def counted(*tables):
        counts.update({name: df.count() for name, df in made.items() if any(df is t for t in tables)})
        drop(*tables)

    monkeypatch.setattr(embeddings, "stored", kept)
    monkeypatch.setattr(embeddings, "dropped", counted)
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, (a * (1 + i % 3)).tolist()) for i in range(n)] + [(10_000 + i, (b + 0.01 * rng.standard_normal(16)).tolist()) for i in range(n)]
    rows += [(20_000 + i, rng.standard_normal(16).tolist()) for i in range(50)]
    got = embeddings.links.__wrapped__(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == sorted(slow(rows))
    assert counts["met"] < 400 and made["decided"].count() < 100 and made["compared"].count() < 100


def test_large_group_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    c = rng.standard_normal(16)
    rows = [(i, (c + 0.09 * rng.standard_normal(16)).tolist()) for i in range(700)]
    rows += [(1000 + i, c.tolist()) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1e300] * 16), (2007, [1e-300] * 16), (2008, [1.0] * 5), (2009, [1.0] * 5), (None, [1.0] * 5), (None, None), (None, c.tolist()), (2010, [3.0]), (2011, [-3.0]), (5, c.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rid", "2 as size", "3 as id")
    got = sorted(((r.id, r.n_links, r.component_id) for r in links(df).collect()), key=repr)
    want = sorted(slow(rows), key=repr)
    assert len(got) == len(want)
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want]
    assert sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want)
    assert links(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        links(df, similarity=2.0)
