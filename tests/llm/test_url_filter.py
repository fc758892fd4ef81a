import random
import re

from pyspark.sql import types as T

from weftline.llm.queries import URL_RULES
from weftline.llm.url_filter import judge_urls

KIND = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("best", T.LongType())])


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for action, rule in rules:
        h, p = rule.partition("/")[0], rule[len(rule.partition("/")[0]) :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, action))
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def check(spark, urls, rules):
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(urls)]
    table = spark.createDataFrame(rules, "action string, rule string")
    got = judge_urls(spark.createDataFrame(rows, KIND), table).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_hard_rows(spark):
    urls = [None, "", "no scheme", "http://", "://x.example.com/en/7", "HTTP://WWW.Example.COM/en/76?q#f", "http://com/en/", "http://com/EN/", "http://notexample.com/en/7", "a://b://c.net/de/8", "http://example.net/de/8#x/y", "http://x.org?/es/", "http://É.ORG/es/é", "http://u@h.net:80/de/", "http://example.com/en/7", "http://" + "a." * 3000 + "net/de/" + "p" * 50_000, "http://.com/en/", "http://com./en/", "http://a\nb.com/en/\n"]
    check(spark, urls * 2, URL_RULES)


def test_random_rules_and_urls(spark):
    rng = random.Random(1)
    part = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    host = lambda: ".".join(part(2) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + part(2) for _ in range(rng.randint(0, 3)))
    rules = {host() + (path() or "/"): rng.choice(["allow", "block"]) for _ in range(40)}
    check(spark, [f"http://{host()}{path()}" for _ in range(400)], [(a, r) for r, a in rules.items()])


def test_no_rules_no_pages_and_default(spark):
    none = spark.createDataFrame([], "action string, rule string")
    page = spark.createDataFrame([(1, "http://a.b/c", "", "", 0)], KIND)
    assert [(r.rule, r.verdict) for r in judge_urls(page, none, "block").collect()] == [(None, "block")]
    assert judge_urls(page.where("false"), none).collect() == []
    twice = spark.createDataFrame([("allow", "a.b/"), ("block", "a.b/"), ("allow", None)], "action string, rule string")
    assert [r.verdict for r in judge_urls(page, twice).collect()] == ["block"]


def test_urls_of_very_many_pages(spark, monkeypatch):
    from weftline.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    check(spark, ["http://example.com/en/7x"] * 40 + [None] * 30 + ["http://a.org/es/b", "http://b.net/de/"] * 3 + ["http://none.xyz/"] * 9, URL_RULES)


def test_an_empty_rule_fits_nothing(spark):
    rows = [(1, None, "", "", 0), (2, "http://", "", "", 0), (3, "http://a.b/c", "", "", 0)]
    rules = spark.createDataFrame([("block", ""), ("block", "/c")], "action string, rule string")
    assert {r.rule for r in judge_urls(spark.createDataFrame(rows, KIND), rules).collect()} == {None}
