import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import urlfilter as U

SCHEMA = "page_id long, url string, rule string, host string, digest string, `at` long"


def by_hand(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def rows(spark, urls):
    return spark.createDataFrame([(i % 7 if i % 11 else None, u, "r", "h", "d", i) for i, u in enumerate(urls)], SCHEMA)


@pytest.mark.parametrize("most_broadcast", [1000, 0])
def test_equals_rule_by_rule(spark, most_broadcast):
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "notorg", "example.org.", "EXAMPLE.org", "org:80", "", ".org", "é.org"]
    paths = ["", "/", "/es/", "/es/1", "/en/12", "/en/1", "/fr/x/y", "/de/", "/DE/", "/" + "a/" * 3000]
    tails = ["", "?q=/es/", "#/es/", "?a#b"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(['', 'www.', 'b.c.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(150)]
    urls += [None, "", "no scheme", "http:/org/", "a://b://org/es/", "://org/", "http://org?x", "http://org/x\ny"] + ["https://example.org/es/"] * 100
    rules = [*U.QUERY_RULES, ("block", "org", ""), ("allow", "b.c.com", "/"), ("block", "c.com", "/fr"), ("block", "example.org", "/es/1")]
    got = U.judged(rows(spark, urls), spark.createDataFrame(rules, U.RULES), most_broadcast=most_broadcast).select("row.at", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted((i, *by_hand(u, rules)) for i, u in enumerate(urls))


def test_equal_short_prefixes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(U, "_short", lambda digest: F.lit(7).cast("long"))  # all digests begin alike
    got = U.judged(rows(spark, ["a://org/", "a://com/fr/", "a://net/"]), spark.createDataFrame(U.QUERY_RULES, U.RULES)).select("row.url", "rule").collect()
    assert sorted(map(tuple, got), key=str) == [("a://com/fr/", "com/fr/"), ("a://net/", None), ("a://org/", "org/")]


def test_short_prefix_is_the_digests_first_four_bytes(spark):
    got = spark.range(1).select(U._short(U._digest(F.lit("org"), F.lit("/")))).first()[0]
    assert got == int.from_bytes(hashlib.sha256(b"org/").digest()[:4], "big")


def test_odd_rules_and_no_rows(spark):
    rules = spark.createDataFrame([("allow", None, "/"), ("block", "", "/"), ("allow", "a", "x"), ("block", "a/b", "/"), ("allow", "C", None), ("block", "c", ""), ("allow", "c", "")], U.RULES)
    got = U.judged(rows(spark, ["a://a/x", "b://c", "c://d/"]), rules, otherwise="look").select("row.url", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == [("a://a/x", None, "look"), ("b://c", "c", "block"), ("c://d/", None, "look")]
    assert U.judged(rows(spark, ["a"]).limit(0), rules).count() == 0
    none = U.judged(rows(spark, ["a://a/x", None]), rules.limit(0)).select("rule", "verdict").collect()
    assert [tuple(r) for r in none] == [(None, "allow")] * 2
