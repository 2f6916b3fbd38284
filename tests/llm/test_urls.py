import re

import pytest

from tallywell.llm import urls
from tallywell.session import literal_table

RULES = [("net", "/", "block", 1), ("example.net", "/en/", "allow", 1), ("example.com", "/de/", "block", 1), ("org", "/fr/", "allow", 1),
         ("bad.example.org", "", "block", 0), ("A.B.example.net", "/en/x", "block", 1), ("tie.com", "/a/", "allow", 1), ("x.tie.com", "/", "block", 1)]
URLS = [None, "", "no scheme", "http://example.net/en/1", "http://Example.NET/en/1", "http://example.net", "http://example.net/", "x://net/",
        "http://notexample.net/en/", "http://w.example.com/de/a?b#c", "http://example.com/d", "http://example.com?x=/de/", "http://a.org/fr/",
        "http://a.org/fr", "http://bad.example.org/de", "http://bad.example.org/fr/", "https://a.b.example.net/en/xyz", "https://a.b.example.net/en/y",
        "http://x.tie.com/a/b", "http://.net/", "http://a..net/q", "://net/a", "http://a/b://net/", "http://é.net/ü", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
        "http://net\n/x", "http://example.net/en/1", "http://EXAMPLE.org/FR/"]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(c, len(h) + len(p), len(h), v, h.lower(), p) for h, p, v, c in rules
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best and best[5], best and best[0], best[3] if best else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, digest string")


def rules_table(spark, rules):
    return literal_table(spark, "host string, path string, verdict string, precedence int", rules)


@pytest.mark.parametrize("rules", [RULES, RULES[:1], []])
def test_matches_brute_force(spark, pages, rules):
    found = urls.judge(pages, rules_table(spark, rules)).orderBy("page_id").collect()
    assert [tuple(r)[2:] for r in found] == [judged(u, rules) for u in URLS * 2]


def test_no_python_in_the_plan(spark, pages):
    plan = urls.judge(pages, rules_table(spark, RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_and_null_pages(spark, pages):
    assert urls.judge(pages.where("false"), rules_table(spark, RULES)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "http://a.net/")], "page_id long, url string")
    assert sorted(r["verdict"] for r in urls.judge(nulls, rules_table(spark, RULES)).collect()) == ["allow", "block"]
