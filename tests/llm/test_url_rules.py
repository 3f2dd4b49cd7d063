import random
import re

from tidefold.llm.queries import URL_RULES
from tidefold.llm.url_rules import judge_urls

RULES = "host string, path string, action string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def judged(spark, urls, rules, **k):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url AS host", "1 AS key")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, RULES), **k).collect()}
    return [out[i] for i in range(len(urls))]


def test_contract_rules(spark, sf_small):
    urls = [r.url for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    urls += [None, "", "http:/x", "no scheme", "://", "x://HOST.Com", "x://HOST.Com/", "https://WWW.EXAMPLE.com/en/a?q#f", "http://example.com/EN/",
             "http://a.www.example.com/en/", "http://notexample.com/en/", "http://net/es/x", "http://x.net/es", "http://a..net/fr/\nx", "http://example.com:80/en/",
             "http://com/", "http://com?x/", "http://é.com/ü", "http://.net/fr/", "a://b://net/es/"]
    urls += ["http://x.net/es/same"] * 50
    assert judged(spark, urls, URL_RULES) == [brute(u, URL_RULES) for u in urls]


def test_many_nested_rules_in_one_and_many_blocks(spark):
    rng = random.Random(3)
    name = lambda n: ".".join(rng.choice(["a", "b", "aa", "a-b", "c"]) for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "/".join(rng.choice(["x", "xy", "", "z"]) for _ in range(rng.randint(0, n)))
    rules = list({(name(3), path(3), rng.choice(["allow", "block"])) for _ in range(150)})
    urls = ["http://" + name(5) + path(5) for _ in range(600)]
    want = [brute(u, rules) for u in urls]
    assert judged(spark, urls, rules) == want
    assert judged(spark, urls, rules, block_rules=40) == want


def test_empty(spark):
    assert judged(spark, [], URL_RULES) == []
    assert judged(spark, ["http://a.com/x"], []) == [("a.com", "/x", None, "allow")]
