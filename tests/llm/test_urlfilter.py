import duckdb
import pytest

from assay.llm import urlfilter
from assay.llm.urlfilter import OP9_SQL, BlockedBloom, domains, judge, op9_urls


def test_filter_holds_all_and_few_others(spark):
    keys = [f"host{i} /x" for i in range(3000)]
    bloom = BlockedBloom.of(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert bloom.holds([k.encode() for k in keys]).all()
    assert bloom.holds([f"other{i}".encode() for i in range(20000)]).mean() < 0.02
    assert not BlockedBloom.of(spark.createDataFrame([], "key string")).holds([b"x"]).any()


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def test_odd_urls(spark):
    rules = [("a.com", "/", "block"), ("a.com", "/ok", "allow"), ("com", "", "block"), ("x.org", "/é", "block"), ("x.org", "/é", "allow"), ("", "/", "block"), ("q", None, "block")]
    urls = [None, "", "a.com/", "http://A.com/OK", "http://a.com/ok?x", "https://b.a.com#/ok", "x://y://a.com/", "://com", "http://xa.com/ok", "http://x.org/éa b", "http://x.org./é", "ht\ntp://a.com/o\nk", "http://" + "s." * 300 + "com/" + "p" * 5000, "http://q/", "http:///", "http://a.com?"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string").selectExpr("*", "1 as url_host", "2 as key")
    got = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == 2 * len(urls)
    assert {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in got} == {i: slow(u, rules) for i, u in enumerate(urls)}
    assert judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []
    none = judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r.url_verdict for r in none} == {"allow"} and len(none) == 2 * len(urls)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    assert sorted(map(tuple, op9_urls(spark, f"/root/testdata/{sf}").collect()), key=repr) == sorted(con.execute(OP9_SQL).fetchall(), key=repr)


def test_domains():
    assert domains("a.b.c.com", 2) == ["com", "c.com"] and domains("a.com", 9) == ["com", "a.com"] and domains("", 3) == [""] and domains("x", 0) == []


def test_keys_are_tested_in_parts(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "TESTED", 9)
    test_odd_urls(spark)


def test_long_hosts(spark):
    """A host of many labels costs memory for the labels that rules have only, and still meets its rule."""
    host = "s." * 200_000 + "a.com"
    pages = spark.createDataFrame([(1, f"http://{host}/ok/1"), (2, f"http://{host}x/ok/1"), (3, "http://" + "y" * 300_000 + ".com/")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/ok", "block"), ("b.c.d.com", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.url_rule, r.url_verdict) for r in judge(pages, rules).collect()}
    assert got == {1: ("a.com/ok", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert sum(map(len, domains(host, 4))) < 100
