import random
import re

from assay.llm.nearcopies import one_of_each_group


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def groups(docs, least):
    sets, parent = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    for some in by.values():
        for a in some[:40]:
            for b in some:
                if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: root(d) for d in docs}


def test_one_of_each_group_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    kept = {r.doc_id for r in one_of_each_group(df).collect()}
    assert kept == set(groups(docs, 0.8).values()) and len(kept) < len(docs)


def test_odd_rows(spark):
    long = " ".join(random.Random(3).choices([f"w{i}" for i in range(500)], k=400))
    rows = [(4, long, 1), (2, long + " end", 2), (None, long, 3), (9, None, 4), (8, "", 5), (7, "one", 6), (6, "one", 7), (6, "one", 7), (5, "one two", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    got = sorted(one_of_each_group(df).collect())
    assert got == [(2, long + " end", 2), (5, "one two", 8), (6, "one", 7), (8, "", 5)]
    assert one_of_each_group(df.limit(0)).collect() == []
    alone = one_of_each_group(spark.createDataFrame([(None, "a", 1), (None, "b", 1)], "doc_id long, text string, rid int")).collect()
    assert len(alone) == 2


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items):
    """Ids of documents with a window of ten words of an item, or all words of a shorter one."""
    windows = {}
    for text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[s : s + 10]), set()).add(tuple(w[s : s + 10]))
    out = set()
    for d, text in docs.items():
        w = words(text)
        if any(tuple(w[s : s + n]) in some for n, some in windows.items() for s in range(len(w) - n + 1)):
            out.add(d)
    return out


def test_pipeline_matches_brute_force(spark):
    """Each stage's rows by plain Python from the rows of the one before, the learned model given, and run()'s rows at the end."""
    import corpus_pipeline

    from assay.llm import toxicity
    from assay.llm.common import stored

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    given = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == names
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(seen[-1])
    assert seen[0].keys() == {d for d, r in given.items() if toxicity.document_score(model.sentences(r.text or "")[0]) < toxicity.THRESHOLD}
    assert seen[1].keys() == set(groups({d: r.text for d, r in seen[0].items()}, 0.8).values())
    assert seen[2].keys() == seen[1].keys() - contaminated({d: r.text for d, r in seen[1].items()}, items)
    assert len(given) > len(seen[0]) > len(seen[1]) > len(seen[2]) > 0
    assert all(tuple(r) == tuple(given[d]) for d, r in seen[2].items())
    last = corpus_pipeline.run(spark, sf).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in seen[2].items()}
    want = sorted((d, k, k * 2048, min(2048, n - k * 2048)) for d, n in size.items() for k in range(max(1, -(-n // 2048))))
    assert sorted((r.doc_id, r.piece, r.start_word, r.n_words) for r in last) == want
    bins = {}
    for r in sorted((r for r in last if r.n_words), key=lambda r: r.bin_offset):
        held = bins.setdefault(r.bin_id, [])
        assert r.bin_offset == sum(x.n_words for x in held) and r.bin_offset + r.n_words <= 2048
        assert seen[2][r.doc_id].source is None or seen[2][r.doc_id].source not in [seen[2][x.doc_id].source for x in held]
        held.append(r)


def test_stages_take_effect(spark):
    import corpus_pipeline

    from assay.llm.common import stored

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1")
    assert docs.join(toxic, "doc_id", "left_semi").count() <= 2
    assert docs.select("doc_id").distinct().count() == sizes[-1]
