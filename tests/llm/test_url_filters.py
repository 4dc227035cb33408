"""URL filters against a plain reading of the rules, colliding digests and many files."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from millrace.llm import url_filters as uf

RULES = "host string, path string, verdict string, key int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate({k: k + 32 for k in range(65, 91)}), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judged(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p or ""), len(h), h + (p or ""), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


RULED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "", "block"), ("b.a.com", None, "allow"), ("com", "/aaaa", "allow"), ("x.com", "/aa", "block"), ("é.net", "/ü", "block")]
URLS = [
    None, "", "example.org/es/", "http://example.org", "http://example.org/", "HTTP://EXAMPLE.org/ES/", "http://example.org/es/?q=/en/1", "ftp://www.example.org/en/12#x", "http://notexample.org/es/", "http://org/es/", "http://a.com?x://b.org/", "http://b.a.com#/", "://c.b.a.com/de/",
    "http://x.com/aaaa", "http://com./fr/", "http://.com/fr/", "http://é.net/über", "http://ÉX.é.net/ü\n/", "http:///fr/", "http://a..org/\nx", "http://u:p@example.org:80/es/", "x" * 70_000 + "://example.org/es/" + "y" * 70_000, "http://example.org/en/1", "http://example.org/en/", "a://b://example.org/es/",
]


@pytest.mark.parametrize("each", [1, 1_000])
def test_against_a_plain_reading(spark, each):
    rows = [Row(page_id=k if k % 5 else None, url=u, host="clash", rule=1, path=2) for k, u in enumerate([*URLS, *URLS[:4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int, path int").repartition(3)
    rules = spark.createDataFrame([(*r, 1) for r in RULED + RULED[:2]], RULES)
    got = uf.filter_urls(pages, rules, keep=("page_id",), rules_each=each).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r.page_id, *judged(r.url, RULED)) for r in rows), key=repr)


def test_many_rules_over_many_files(spark):
    rnd = random.Random(2)
    label = lambda: rnd.choice(["a", "bb", "c", "dé"])
    host = lambda: ".".join(label() for _ in range(rnd.randrange(1, 4)))
    path = lambda: "".join("/" + label() for _ in range(rnd.randrange(0, 4)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(300))}.values())
    urls = [f"http://{host()}{path()}?q" for _ in range(2_000)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = uf.filter_urls(pages, spark.createDataFrame([(*r, 0) for r in rules], RULES), default="block", rules_each=10).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((judged(u, rules, "block") for u in urls), key=repr)


def test_equal_digests_are_told_apart_by_the_strings(tmp_path):
    """Three strings with one digest, and a digest between them that isn't there."""
    keys, ends = [b"a\x00", b"b\x00", b"cc\x00/"], [0, 2, 4, 8]
    for kind, raw in (("key", np.array([5, 5, 5], "<u8").tobytes()), ("end", np.array(ends, "<u8").tobytes()), ("txt", b"".join(keys)), ("ver", bytes([1, 0, 1]))):
        (tmp_path / f"f.{kind}").write_bytes(raw)
    probe = uf.Digests(f"file://{tmp_path}", 0, ["f"]).probe
    assert probe(np.array([5, 5, 5, 5, 4, 6], "u8"), ["a\x00", "b\x00", "cc\x00/", "d\x00", "a\x00", "a\x00"]).tolist() == [1, 0, 1, -1, -1, -1]


def test_no_rules_no_urls_and_bad_rules(spark):
    pages, none = spark.createDataFrame([("http://a.org/",)], "url string"), spark.createDataFrame([], RULES)
    assert uf.filter_urls(pages, none).collect() == [("a.org", "/", None, "allow")]
    some = spark.createDataFrame([("ORG", None, "allow", 1), ("org", "", "block", 1)], RULES)
    assert uf.filter_urls(pages, some).collect() == [("a.org", "/", "org", "block")]
    assert uf.filter_urls(pages.limit(0), some).collect() == []
    for bad in ((None, "/", "allow", 1), ("", "/", "allow", 1), ("a", "/", None, 1), ("a", "/", "x", 1)):
        with pytest.raises(Exception, match="a rule needs a host"):
            uf.filter_urls(pages, spark.createDataFrame([bad], RULES))
