import random

from pyspark.sql import Row

from lumentab.llm.queries import RULES
from lumentab.llm.urls import filter_urls

SCHEMA = "page_id bigint, url string, host string, key string, verdict string"
RULE_SCHEMA = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or (h and host.endswith("." + h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in urls], SCHEMA)
    got = filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA))
    return sorted((r["page_id"] or -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got.collect())


def expected(urls, rules):
    return sorted((i or -1, h, p, r or "", v) for i, u in urls for h, p, r, v in [plain(u, rules)])


def test_odd_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://NET"), (5, "http://net/"), (5, "http://net/"), (None, "https://a.net/x?q=/en/"),
            (6, "x://example.net/en/a://org/fr/"), (7, "http://example.com/de"), (8, "http://myexample.com/de/"), (9, "http://.net/"), (10, "http://net./"),
            (11, "://org/fr/#x"), (12, "http://a.b.org/fr/" + "y" * 50000), (13, "http://" + "a." * 3000 + "net/z"), (14, "http://org?/fr/")]
    assert judge(spark, urls, RULES) == expected(urls, RULES)


def test_many_rules(spark):
    rng = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "ba", "x.ba", ""]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/d/e"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.6}.values())
    urls = [(i, f"h://{rng.choice(['', 'w.', 'c.', 'X.'])}{rng.choice(['a', 'b.a', 'ba', 'zba', 'c.b.a', ''])}{rng.choice(['', '/', '/e', '/en/x/y', '/d/e?q', '/d#e'])}") for i in range(300)]
    assert judge(spark, urls, rules) == expected(urls, rules)


def test_empty_and_conflicting_rules(spark):
    empty = spark.createDataFrame([], RULE_SCHEMA)
    pages = spark.createDataFrame([Row(page_id=1, url="http://net/")])
    assert [tuple(r) for r in filter_urls(pages, empty, default="block").collect()] == [(1, "net", "/", None, "block")]
    both = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block")], RULE_SCHEMA)
    assert filter_urls(pages, both).first()["verdict"] == "block"
    assert filter_urls(pages.limit(0), both).count() == 0
