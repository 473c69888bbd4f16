"""URL filters against a plain search of all entries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsframe.llm import url_filter
from tests.compare import connect, differences

ENTRIES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "a.example.net", "/en/se"),
    ("allow", "a.example.net", "/en/secret/not"),
    ("allow", "a.example.net", "/en/secret/"),
    ("block", "", "/track"),
    ("allow", "org", "/fr/"),
    ("allow", "org", "/fr/"),
    ("block", "org", "/fr/"),
    ("block", "é.org", ""),
    ("allow", "deep.org", "/" + "x/" * 3_000),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain_judge(url, entries, default="allow"):
    host, path = plain_parts(url)
    fits = [
        (len(h), len(p), v == "block", h + p, v)
        for v, h, p in entries
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def some_urls():
    dice = random.Random(5)
    hosts = ["net", "NET", "example.net", "a.example.net", "b.A.example.Net", "myexample.net", "x.org", "é.org", "z.é.org"]
    hosts += ["É.org", "deep.org", "", "net.", ".net", "a..net", "net:80", "u@net", "example.net/en"]
    paths = ["", "/", "/en", "/en/", "/en/s", "/en/secret", "/en/secret/no", "/en/secret/not/x", "/fr/", "/track/me", "//en/"]
    paths += ["/" + "x/" * n for n in (2_999, 3_000, 20_000)]
    ends = ["", "?q=/fr/", "#/fr/", "?a://b/fr/"]
    made = [f"https://{dice.choice(hosts)}{dice.choice(paths)}{dice.choice(ends)}" for _ in range(600)]
    return [None, "", "net/", "http:/net/", "://net/", "a\nb://net/x", "http://net?x://org/fr/", *made, *made[:50]]


@pytest.mark.parametrize("default", ["allow", "block"])
def test_trie_and_join_against_plain_search(spark, default):
    urls = some_urls()
    pages = spark.createDataFrame([(k, u, "mine", "old") for k, u in enumerate(urls)], "page_id INT, url STRING, other STRING, rule STRING")
    entries = spark.createDataFrame([*ENTRIES, (None, "x", "/"), ("block", None, "/")], "verdict STRING, host STRING, path STRING")
    want = [plain_judge(u, ENTRIES, default) for u in urls]
    for judged in (
        url_filter.judge(pages, ENTRIES, default),
        url_filter.judge_by(pages, entries, default),
        url_filter.judge_by(pages, entries, default, max_entries=2),
        url_filter.judge_by(pages, entries, default, max_chars=10),
    ):
        got = judged.orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
        assert all(r.other == "mine" for r in got) and [r.url for r in got] == urls


def test_no_entries_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id INT, url STRING")
    none = spark.createDataFrame([], "verdict STRING, host STRING, path STRING")
    for judged in (url_filter.judge(pages, []), url_filter.judge_by(pages, none, max_entries=-1)):
        assert [(r.rule, r.verdict) for r in judged.collect()] == [(None, "allow")]
    assert url_filter.judge(pages.filter(F.lit(False)), ENTRIES).collect() == []
    assert url_filter.judge_joined(pages.filter(F.lit(False)), none).collect() == []


def test_query_with_sql(spark, sf_dir):
    assert differences(entry.queries()["op12_url_filter"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op12_url_filter"]) is None
