"""URL cascades against plain string comparison."""

import random
import re

from pyspark.sql import functions as F

from zonalis.llm import url_cascade as U
from zonalis.llm.common import Scratch

PAGES = "page_id long, url string, host string, `_key0` string, verdict string"


def plain(url, rules, blocked):
    """(host, path, rule, verdict) by looking at every rule."""
    at = (url or "").find("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :]).groups() if at >= 0 else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(key):
        h, slash, p = key.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith(slash + p)

    rule, action = max(((k, a) for k, a in rules if fits(k)), key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, action or ("block" if any(fits(k) for k in blocked) else "allow")


def some_urls(seed, count):
    r = random.Random(seed)
    part = lambda: r.choice(["a", "b", "c", "net", "org", "x-y", "Z"])
    return [
        f"{r.choice(['http', ''])}{r.choice(['://', '://', '://', ':/'])}{'.'.join(part() for _ in range(r.randint(1, 5)))}{r.choice(['', '/', '/en/', '/en/1', '/de/?q=/x', '#/en/', '?/en/', '/en'])}" for _ in range(count)
    ]


def judged(spark, urls, rules, blocked, **more):
    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(urls)], PAGES)
    listed = spark.createDataFrame([(b,) for b in blocked], "key string")
    out = U.judge_urls(spark, pages, spark.createDataFrame(rules, "key string, action string"), listed, **more)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_verdicts_as_by_plain_comparison(spark):
    rules = [("net/", "block"), ("a.net/en/", "allow"), ("b.org", "block"), ("org/en/", "allow"), ("x-y/", "block"), ("c.a.net/e", "block")]
    blocked = ["z.a", "b.b/en/", "c", "no.such.host", None]
    urls = some_urls(1, 400) + [None, "", "://", "://net", "http://NET/", "https://a.net/en/é", "q://" + "a." * 5000 + "net/x", "q://net/" + "en/" * 300_000, "http://net/\n/en/"]
    want = {k: plain(u, rules, [b for b in blocked if b]) for k, u in enumerate(urls)}
    assert judged(spark, urls, rules, blocked) == want
    assert judged(spark, urls, rules, blocked, block_keys=2) == want


def test_ties_repeats_and_empty(spark):
    both = [("net/", "block"), ("net/", "allow"), ("net/", "allow")]
    assert judged(spark, ["s://net/"] * 3, both, [])[2] == ("net", "/", "net/", "allow")
    assert judged(spark, [], both, ["a"]) == {}
    assert judged(spark, ["s://a/"], [], [])[0] == ("a", "/", None, "allow")


def test_cascade_is_exact_with_many_false_positives(spark):
    scratch = Scratch(spark)
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter("xxhash64(key) % 29 = 0")
    made = U.fit_cascade(spark, universe.unionByName(universe.limit(100)), listed, scratch)
    assert len(made.levels) > 2 and max(v.bits for v in made.levels) <= U.MOST_BITS
    wrong = universe.filter(made.has(F.col("key")) != (F.expr("xxhash64(key) % 29") == 0))
    assert wrong.count() == 0


def test_hosts_by_words(spark):
    urls = ["http://www.Spam-farm.net/x", "http://ads.a.b", "http://nospam.org/", "http://a.free-bets", None, "spam"]
    keys = {r[0] for r in U.hosts_by_words(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert keys == {"spam-farm.net", "ads.a.b", "free-bets"}
