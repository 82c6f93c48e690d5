"""URL rules and the blocked Bloom filter, against a plain reading of the contract."""

import re

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from salesloom.llm import url_filter
from salesloom.llm.queries import ORACLE, QUERIES, URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    "http://a.Example.org/es/1", "http://example.org/en/12?x#y", "http://xexample.org/en/1", "http://org/", "http://org",
    "http://ÄB.com/fr/x", "https://q.com/de/1://x.org/", "x", "", None, "http://", "://com/de/", "a://b\nc.com/de/\n?",
    "http://www.q.net/p/?utm_source=1", "http://q.net/p.html", "http://m.q.net/p#utm_source=", "http://q.net/other",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, key string")


def test_parts_and_rules(pages, spark):
    listed = spark.createDataFrame([("q.net/p",), (None,), ("q.net/p",)], "key string")
    for row in url_filter.judge(pages, listed, URL_RULES).collect():
        host, path = parts(row.url)
        fits = rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, fits and fits.text)
        on_list = row.canonical_url == "q.net/p"
        assert row.listed == on_list
        assert row.verdict == (fits.verdict if fits else "block" if on_list else "allow")
    assert url_filter.judge(pages, listed, URL_RULES).where("listed").count() == 3


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("key"))
    others = spark.range(5000, 25000).select(F.concat(F.lit("h/"), "id").alias("key"))
    assert url_filter.possible(listed, listed, 5000).count() == 5000
    assert url_filter.possible(others, listed, 5000).count() < 200


def test_shuffled_filter_gives_the_same(spark, monkeypatch, pages):
    listed = spark.createDataFrame([("q.net/p",)], "key string")
    expected = sorted(map(str, url_filter.judge(pages, listed, URL_RULES).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert sorted(map(str, url_filter.judge(pages, listed, URL_RULES).collect())) == expected


def test_empty(spark, pages):
    none = spark.createDataFrame([], "key string")
    assert url_filter.judge(pages.limit(0), none, URL_RULES).count() == 0
    assert url_filter.judge(pages, none, URL_RULES).where("listed").count() == 0


def test_query_equals_sql(spark, small):
    rows, differences = compare(QUERIES["op3_url_filter"](spark, small), duck(small), ORACLE["op3_url_filter"])
    assert rows == 250
    assert differences == []
