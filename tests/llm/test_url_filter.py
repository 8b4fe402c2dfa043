import random

from conftest import rows
from pyspark.sql import functions as F

from millrace.llm.url_filter import bloom_filter, judge_urls, passing

RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("x.com", "", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("net", None, "block")]
URLS = [
    "http://a.example.org/es/x", "http://example.org/en/123?q", "https://EXAMPLE.ORG/en/2#f", "http://notexample.org/es/", "b.com/fr/",
    "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/DE/1", "http://x.com", "http://x.com/fr/", "ftp://y.x.com?p=/fr/", None, "",
    "http://", "http:///p", "http://o.net", "http://org", "http://org/", "//a.org/", "a://b://c.org/", "http://b.com/fr\n/",
    "http://" + "a." * 500 + "org/" + "p" * 5000, "http://É.com/fr/",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, verdict in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            found = (len(h + p), len(h), verdict, h + p)
            best = max(best, found) if best else found
    return host, path, best and best[3], best[2] if best else "allow"


def test_every_url_is_judged_as_by_hand(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judge_urls(pages, rules)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == {
        i: brute(u) for i, u in enumerate(URLS)
    }


def test_the_filter_passes_all_that_is_listed_and_little_else(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, n_words = bloom_filter(listed, "key")
    assert n_words * 64 >= 3000 * 12 > n_words * 32
    asked = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    found = {r["key"] for r in passing(asked, "key", bloom, n_words).collect()}
    assert {f"k{i}" for i in range(3000)} <= found and len(found) < 3000 + 37_000 * 0.05


def test_clashing_names_repeats_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/", "h", "r", "k")] * 2, "page_id long, url string, Host string, rule string, key string")
    found = judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    assert rows(found) == [(1, "http://a.org/", "k", "a.org", "/", "org/", "allow")] * 2
    assert rows(judge_urls(pages, rules.limit(0), "block"), "rule", "verdict") == [(None, "block")] * 2
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_random_rules(spark):
    rng = random.Random(2)
    hosts = ["a.b.c", "b.c", "c", "x.c", "b.x.c"]
    global RULES
    before, RULES = RULES, [(rng.choice(hosts), "/" + "".join(rng.choice("pq") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(12)]
    try:
        urls = ["http://" + rng.choice(hosts) + "/" + "".join(rng.choice("pq") for _ in range(4)) for _ in range(150)]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
        assert found == {i: brute(u) for i, u in enumerate(urls)}
    finally:
        RULES = before
