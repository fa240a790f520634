"""URL filters: rules, patterns and their tokens, the index against all patterns on all URLs."""

import re

import duckdb
import pytest

from cytoplan.llm import queries, urls

ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "HTTPS://Www.Example.COM/EN/x", "https://www.example.com/en/1?q=://y/", "http://a.example.net/es/1#x", "http://a.example.net?x=/es/", "http://net/es/", "http://xnet/es/", "http://u:p@example.com:80/en/", "http://u@example.com/en/",
       "ftp://host.de/ads/x", "http://h.de/adsx/", "http://1.2.3.4/x", "http://my-ads-track.de/", "http://ads-track.de/", "http://x.de/a?affid=1", "http://x.de/a&AFFID=1", "http://x.de/_aff_id=1", "http://adserver.gov/ads/", "http://x.de/ads/policy", "http://\u00e9.de/ads/\n", "://a.com/b", "a://b://c.com/d"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = lower(raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(r), v, r) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    hit = [p for p in map(urls.compiled, urls.PATTERNS) if re.search(p.regex.replace(r"\z", r"\Z"), lower(url or ""))]
    blocked = hit and not any(p.exception for p in hit)
    return (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "block" if blocked else "allow", min(p.text for p in hit) if blocked and not fits else None)


@pytest.mark.parametrize("most", [urls.INDEX_BYTES, 0])
def test_odd_urls(spark, most):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ODD)], "page_id int, url string, rule string, low string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, most=most).collect()}
    assert [got[i] for i in range(len(ODD))] == [brute(u) for u in ODD]
    assert urls.judge(pages.limit(0), most=most).collect() == []


def test_tokens():
    tokens = lambda p: urls.compiled(p).tokens
    assert tokens("||ads-track.") == ("ads", "track") and tokens("||casino-*.") == ("casino",) and tokens("banner") == () and tokens("*banner*/x") == () and tokens("|http://a.b|") == ("http", "a", "b")
    assert tokens(r"/\/wp-login\.php/") == ("wp", "login") and tokens(r"/-a+b-|-c-/") == () and tokens(r"/-ab?-cd-(ef)-gh\/\/?ij-/") == ("cd", "gh")


def test_every_match_holds_the_token_that_its_pattern_is_kept_under(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    index = urls.indexed(pages, [urls.compiled(p) for p in urls.PATTERNS])
    assert sum(token == "" for token, _ in index) <= 2
    for token, p in index:
        for (url,) in duckdb.sql("SELECT url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
            if re.search(p.regex.replace(r"\z", r"\Z"), url):
                assert token in ["", *re.split("[^a-z0-9]+", url)]


def test_a_long_list_and_the_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://s{i % 50}.common.de/p{i}/") for i in range(500)], "page_id long, url string")
    patterns = [f"||s{i}.common." for i in range(0, 2000, 7)]
    index = urls.indexed(pages, [urls.compiled(p) for p in patterns])
    assert all(token != "common" for token, _ in index)
    want = {i: "block" if i % 50 % 7 == 0 else "allow" for i in range(500)}
    for most in (urls.INDEX_BYTES, 0):
        assert {r.page_id: r.verdict for r in urls.judge(pages, [], patterns, most).collect()} == want


def test_query_equals_sql_without_python_or_shuffle(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    df = queries.op11_url_patterns(spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(queries.oracle_sql()["op11_url_patterns"]).fetchall(), key=lambda r: r[0])
