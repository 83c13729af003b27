from chainsift.llm import urlfilter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/1?x#y", "https://example.net/en", "https://example.net", "https://net/", "http://x.net?/en/", "ftp://example.com/de/x",
        "http://notexample.com/de/", "http://sub.example.com/de/", "http://É.org/fr/a", "http://org/fr/", "http://a.b.c.org/fr/#z", "http://u@example.net:80/en/", "a://b://c.net/", "http://x.net/" + "p" * 5000]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert got == {k: brute(u, RULES) for k, u in enumerate(URLS * 2)}


def test_many_rules_and_shuffled_filter(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    rules = [(f"h{k}.example.org", f"/{k % 7}", "block" if k % 2 else "allow") for k in range(400)]
    urls = [f"http://w.h{k}.example.org/{k % 5}/x" for k in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    odd = [("net", None, "block"), (None, "/", "block"), *rules[:5]]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame(rules + odd, "host string, path string, verdict string")).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_filter_never_loses_a_key_and_drops_most_others(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    other = spark.range(20_000).selectExpr("concat('x', id) AS key")
    bloom = U.build_filter(keys, 600)
    assert U.possible(keys, bloom, 600).count() == 3000
    assert U.possible(other, bloom, 600).count() < 600


def test_no_rules_no_pages_and_native_plan(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judge(pages, none).first().verdict == "allow"
    assert U.judge(pages.limit(0), none).count() == 0
    plan = U.judge(pages, none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
