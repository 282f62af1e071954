import re

from corpusmill.llm import url_filter
from corpusmill.llm.queries import PATTERN_RULES, QUERIES, SITE_RULES
from corpusmill.llm.url_filter import PatternRule, SiteRule

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/q",
        "https://example.com/EN/", "http://xexample.com/en/", "http://com", "http://com/", "ftp://a.net/fr/?x", "http://a.net/es", "http://net/es/1",
        "http://free-bets.org/", "http://my-free-bets.org/", "http://xfree-bets.org/", "http://m\u00fcnchen.com?x=/y/", "http://a.org/ads/1",
        "http://a.org/x://b.com/en/", "http://a.com:80/en/", "x" * 5000 + "://" + "y" * 5000 + ".com/" + "z" * 5000]


def plain(url, rules, default="allow"):
    found = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    site = [r for r in rules if isinstance(r, SiteRule) and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    glob = [r for r in rules if isinstance(r, PatternRule) and url is not None and re.search(r.regex(), low)]
    best = max(site, key=lambda r: (len(r.text), r.text), default=None)
    other = max(glob, key=lambda r: (len(r.text), r.text), default=None)
    return host, path, best and best.text, other and other.text, (best or other).verdict if best or other else default


def judged(spark, urls, rules, columns="url string, host int, verdict string"):
    pages = spark.createDataFrame([(u, 1, None) for u in urls], columns)
    rows = url_filter.judge(pages, rules).collect()
    return sorted(((r.url, r.host, r.path, r.rule, r.pattern, r.verdict) for r in rows), key=repr)


def test_judged_as_by_trying_every_rule(spark):
    rules = SITE_RULES + PATTERN_RULES + [SiteRule("m\u00fcnchen.com", "", "block"), SiteRule("a.org", "/x", "block"), PatternRule("*yyy*", "block"), PatternRule("bets.", "block")]
    urls = URLS + URLS[4:9]  # repeated rows
    assert judged(spark, urls, rules) == sorted(((u, *plain(u, rules)) for u in urls), key=repr)


def test_no_rules_and_no_rows(spark):
    assert [r[1:] for r in judged(spark, ["http://a.com/x"], [])] == [("a.com", "/x", None, None, "allow")]
    assert judged(spark, [], SITE_RULES) == []


def test_index_files_rules_under_their_rarest_whole_token(spark):
    urls = spark.createDataFrame([("http://a.example.com/en/",), ("http://example.org/en/",), ("http://b.com/",)], "url string")
    rules = url_filter._rules(spark, [SITE_RULES[1], PatternRule("bets", "block"), SiteRule("example.com", "/e", "block")])
    index = {r.rule_no: r.token for r in url_filter.token_index(urls, rules).collect()}
    assert index == {0: "com", 1: "", 2: "com"}


def test_query_covers_every_page(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_url_filter"](spark, sf).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in got} == {i: plain(u, SITE_RULES + PATTERN_RULES) for i, u in pages.items()}
