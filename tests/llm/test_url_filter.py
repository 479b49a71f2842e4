"""URL rules against a direct reading of the contract."""

import re


from cadenza.llm import url_filter
from cadenza.llm.queries import URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = split_url(url)
    fits = [
        (len(h) + len(p), len(h), a, h + p) for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/", "http://WWW.Example.COM/en/x?y=/fr/", "http://x.net/es/",
    "http://net/fr/1", "http://notnet/fr/", "http://x.net/en/", "http://com", "http://com/", "com/en/", "", None, "://",
    "http://example.com/english", "http://example.com//en/", "a://b://example.com/en/", "http://x.net:80/es/",
    "http://u@x.net/es/#z", "http://x.net?/es/", "http://x.net/es", "HTTP://É.NET/es/", "http://.net/es/", "http://x.net./es/",
    "http://line\nbreak.net/es/\nx", "http://" + "a." * 300 + "net/es/" + "d/" * 500,
]


def answers(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    out = url_filter.filter_urls(pages, table).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}, len(out)


def test_contract_rules(spark):
    urls = URLS + URLS[:3]
    got, n = answers(spark, urls, URL_RULES)
    assert n == len(urls)
    assert got == {i: judged(u, URL_RULES) for i, u in enumerate(urls)}


def test_any_rule_path_is_a_character_prefix(spark):
    rules = [
        ("block", "example.com", "/en"), ("allow", "example.com", "/en/a/b"), ("block", "a.b.example.com", ""),
        ("allow", "net", "/e"), ("block", "net", "/e"), (None, "org", "/"), ("block", None, "/"), ("odd", "com", "/"),
    ]
    real = [r for r in rules if r[0] in ("allow", "block") and r[1]]
    urls = URLS + ["http://c.a.b.example.com", "http://example.com/en/a/bc", "http://example.com/en/a/", "http://o.org/"]
    got, _ = answers(spark, urls, rules)
    assert got == {i: judged(u, real) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, none).collect()] == [
        (1, "http://x.net/es/", "x.net", "/es/", None, "allow")
    ]
    table = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    assert url_filter.filter_urls(pages.limit(0), table).collect() == []


def test_rules_with_nulls_only(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    nulls = spark.createDataFrame([(None, None, None)], "action string, host string, path string")
    assert url_filter.filter_urls(pages, nulls).first()["verdict"] == "allow"
