import random

from quorumlake.llm.url_filter import filter_urls, rules_frame


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
        path = rest[:cut]
    best = None
    for verdict, h, p in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, verdict))
    return (host, path, best[2] if best else None, best[3] if best else default)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules_frame(spark, rules)).collect()}


def test_stated_rules_and_odd_urls(spark):
    urls = [None, "", "example.org/es/", "http://", "https://Example.ORG/es/x?q#f", "http://example.org", "http://a.b.example.org/en/12", "http://badexample.org/es/", "x://com/de/", "http://É.com/fr/", "http://org?x=http://com/fr/", "ftp://a..com/de/", "http://com#/de/", "http://a\nb.org/\nx", "http://example.org.:80/es/"]
    got = run(spark, urls * 2, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls * 2)}


def test_nested_rules_equal_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "ab", "c", "a-b", "a0"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice(["x", "xy", ""]) for _ in range(rng.randrange(4)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(["", path()])) for _ in range(120)]
    urls = [f"http://{host()}{rng.choice(['', path(), path() + '?q'])}" for _ in range(800)]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    assert run(spark, ["http://a.org/x"], []) == {0: ("a.org", "/x", None, "allow")}
    df = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(df, rules_frame(spark, RULES)).collect() == []
