import hashlib
import random
import re

import duckdb
import pytest

from assay.llm.decontaminate import OP3_SQL, build_index, contamination, matches, op3_decontaminate, vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for s in range(max(1, len(b) - size + 1) if b else 0):
                phrase = b[s : s + size]
                for k in range(len(w) - len(phrase) + 1):
                    if w[k : k + len(phrase)] == phrase:
                        hit |= set(range(k, k + len(phrase)))
                        found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def rows(df):
    return sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_matches_brute_force(spark, size):
    rng = random.Random(size)
    text = lambda n: " ".join(rng.choice("a b B c d é ü7 -- x,y".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(None, text(30)), (5, text(40)), (6, None), (7, ""), (8, "a " * 3000)]
    docs += docs[:3]
    items = [(i, text(rng.choice([0, 1, 2, 4, 9]))) for i in range(12)] + [(None, "a b c"), (90, None), (91, "a a"), (91, "a a")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(d.selectExpr("*", "1 as pos", "2 as key"), b.selectExpr("*", "1 as w"), size=size)) == sorted(slow(docs, items, size), key=repr)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(contamination(d, b)) == [(1, 2, 0, [])]
    assert rows(contamination(d.limit(0), b)) == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero one xx two three"), (2, "one two three"), (3, "one two xx xx xx three")], "doc_id long, text string")
    phrases = spark.createDataFrame([(0, ["one", "two", "three"])], "wid long, phrase array<string>")
    vocab = vocabulary(phrases)
    index = build_index(docs, vocab)
    at = {r.d: r.id for r in docs.selectExpr("xxhash64(doc_id) as d", "doc_id as id").collect()}
    assert {at[r.d] for r in matches(index, phrases, vocab).collect()} == {2}
    assert {at[r.d] for r in matches(index, phrases, vocab, slop=1).collect()} == {1, 2}
    assert {at[r.d] for r in matches(index, phrases, vocab, slop=3).collect()} == {1, 2, 3}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({OP3_SQL})").fetchall())
    got = sorted(map(tuple, op3_decontaminate(spark, f"/root/testdata/{sf}").collect()))
    assert got == want and any(r[-1] for r in got)
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in got}
