from chainsurf.llm import url_filters

URLS = {
    1: "http://Shop.Example.com/en/1?q=/es/",
    2: "https://www.example.com/en/x#top",
    3: "https://www.example.com/english",
    4: "http://a.b.net/es/",
    5: "http://net/fr/x",
    6: "http://notnet/fr/x",
    7: "ftp://example.org",
    8: "no scheme/here",
    9: None,
    10: "http://example.com",
    11: "http://example.com?x=://other.net/es/",
    12: "http://spam-farm.example.org/en/1",
    13: "http://x.spam-farm.example.com/de/1",
    14: "://",
    15: "http://EXAMPLE.COM/EN/",
}


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    listed = any(host == h or host.endswith("." + h) for h in url_filters.BLOCKED_HOSTS)
    return host, path, None, "block" if listed else "allow"


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in URLS.items()] + [(1, URLS[1], "again")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    blocked = spark.createDataFrame([(h,) for h in url_filters.BLOCKED_HOSTS], "host string")
    got = url_filters.judge(pages, rules, blocked=blocked).collect()
    assert len(got) == len(URLS) + 1
    assert {x.page_id: tuple(x)[1:] for x in got} == {k: brute(u) for k, u in URLS.items()}
    assert url_filters.judge(pages, rules.limit(0), default="block").filter("verdict = 'block'").count() == len(URLS) + 1
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_hosts_of_many_labels(spark):
    """Only as many labels are expanded as rules have, so such a url costs no more than its length."""
    deep = "a." * 100_000
    pages = spark.createDataFrame([(1, f"http://{deep}net/es/x"), (2, f"http://{deep}net.org/es/x"), (3, "http://" + "." * 5000 + "/fr/")], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filters.judge(pages, rules).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "allow"), 3: (None, "allow")}
