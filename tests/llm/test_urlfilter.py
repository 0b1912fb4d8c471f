"""URL verdicts against plain code, and the filter's promises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import urlfilter as U
from riskloom.llm.queries import URL_RULES


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.org/x", "http://forg/x", "HTTP://Example.ORG/es/1?x", "http://b.example.org/es", "http://b.example.org/en/17#f", "http://example.org/en/27", "https://x.com/fr/1", "https://x.com/de/1", "https://x.com/en/1", "x://y://com/de/", "http://com?/de/", "http://com#/de/", "http://com/de/\n?q", "http://ÄB.com/de/Ä", "http://u@x.com:80/de/", "http://" + "a." * 5000 + "com/de/" + "z" * 100_000]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, URL_RULES, listed).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u, URL_RULES)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_canonical(spark):
    pairs = [("http://A.b/c/", "a.b/c"), ("https://a.b/c.html#x", "a.b/c"), ("http://a.b/c?utm_source=f&z=1&a=2", "a.b/c?a=2&z=1"), ("http://a.b/c?ref=x", "a.b/c"), ("http://a.b/c?reference=x", "a.b/c?reference=x"), ("http://a.b", "a.b"), ("a.b/c", None), (None, None), ("http://a.b/#?q=1", "a.b")]
    got = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pairs)], "i int, u string").select("i", U.canonical(F.col("u")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, c in pairs]


@pytest.mark.parametrize("most_bytes", [64, U.MOST_BYTES])
def test_list_is_exact_whatever_the_filter_lets_through(spark, most_bytes):
    listed = spark.range(0, 4000, 2).select(F.concat(F.lit("h/"), "id").alias("url")).unionByName(spark.createDataFrame([(None,), ("h/0",)], "url string"))
    rows = spark.range(4000).select(F.col("id"), F.concat(F.lit("h/"), "id").alias("k"), F.lit(1).alias("listed_before"), F.lit(2).alias("url"))
    rows = rows.unionByName(rows.filter("id < 2")).unionByName(rows.limit(1).withColumn("id", F.lit(-1).cast("bigint")).withColumn("k", F.lit(None).cast("string")))
    got = U.on_list(rows, "k", listed, most_bytes=most_bytes).collect()
    assert len(got) == 4003 and all(r.listed == (r.id >= 0 and r.id % 2 == 0) for r in got)


def test_filter_has_all_and_few_more(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("url"))
    bloom = U.build_filter(listed)
    assert bloom.nbytes <= 20_000 * U.BITS // 8 * 1.2
    hashes = spark.range(60_000).select(U._hash(F.concat(F.lit("h/"), "id")).alias("h")).toPandas()["h"].to_numpy()
    found = U.may_hold(bloom, hashes)
    assert found[:20_000].all() and found[20_000:].mean() < 0.01
    assert not U.may_hold(U.build_filter(listed.filter("url is null")), np.arange(9)).any()


def test_clashes_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a", "h", 7), (2, "http://x.net/b", None, 8)], "page_id long, url string, host string, verdict int").withColumn("lane", F.lit(3)).withColumn("canonical", F.lit(1)).withColumn("fit", F.lit(2)).withColumn("maybe", F.lit(4)).withColumn("same", F.lit(5))
    listed = spark.createDataFrame([("x.net/a",)], "url string")
    got = sorted(U.judge(pages, [], listed).collect())
    assert [(r.page_id, r.host, r.verdict, r.lane, r.canonical, r.fit, r.maybe, r.same) for r in got] == [(1, "x.net", "block", 3, 1, 2, 4, 5), (2, "x.net", "allow", 3, 1, 2, 4, 5)]
    assert U.judge(pages.limit(0), URL_RULES, listed).collect() == []
    with pytest.raises(ValueError):
        U.longest_rule([("allow", f"h{i}", "/") for i in range(501)], F.lit(""), F.lit(""))
