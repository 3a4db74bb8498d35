"""URL functions on examples, and against the standard library where it defines the result."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftline.functions import urls as U

from .helpers import values

@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(A=F.col("a"), B=F.col("b"))


def test_normalise(spark):
    cases = {
        "https://Example.COM": "https://example.com/", "http://example.com:80/a//b/": "http://example.com/a/b/", "https://example.com:8443/": "https://example.com:8443/",
        "https://example.com/a/./b/../c#frag": "https://example.com/a/c", "https://example.com/?b=2&a=1&a=0": "https://example.com/?a=0&a=1&b=2",
        "//cdn.example.com/x": "https://cdn.example.com/x", "": "", "  ": "", None: "", "mailto:a@b.c#x": "mailto:a@b.c#x", "https://user:pw@example.com/": "https://example.com/",
        "https://example.com/../../x": "https://example.com/x", "https://example.com/a;p=1": "https://example.com/a", "https://example.com/%7Eü": "https://example.com/%7Eü",
        "https://example.com/?q=a b+c%20d&e": "https://example.com/?e=&q=a+b+c+d", "https://example.com:x/": None, "https://example.com:99999/": None,
        "http://[::1]:80/x": "http://[::1]/x", "https://example.com/a/..": "https://example.com/", "https://example.com/a/": "https://example.com/a/",
        "https://example.com/?a=%zz": "https://example.com/?a=%25zz", "https://example.com/?&&a=1&": "https://example.com/?a=1", "HTTP://EXAMPLE.com/A": "http://example.com/A",
    }
    assert values(spark, U.normalise(A), list(cases)) == list(cases.values())


def test_normalise_against_a_base(spark):
    pairs = [("../x", "https://e.com/a/b/c"), ("y", "https://e.com/blog"), ("y", "https://e.com/blog/"), ("//h/z", "http://e.com/"), ("?q=1", "https://e.com/p"), ("/r", "https://e.com")]
    want = ["https://e.com/a/x", "https://e.com/y", "https://e.com/blog/y", "http://h/z", "https://e.com/p?q=1", "https://e.com/r"]
    assert values(spark, U.normalise(A, B), pairs) == want


def test_resolve_is_urljoin(spark):
    bases = ["https://e.com/a/b/c.html?q#f", "https://e.com", "https://e.com/a/b/", "http://e.com/a/../b/x;p"]
    refs = ["d", "./d", "../d", "../../d", "../../../d", "/d", "//h/d", "?x=1", "#g", "https://o.com/z", "mailto:a@b", "d/./e/../f", "..", ".", "d//e", "/a/../b/./c", "d;p?q#g", "HTTPS://e.com/up", "javascript:void(0)"]
    pairs = [(r, b) for b in bases for r in refs]
    assert values(spark, U.resolve(A, B), pairs) == [urljoin(b, r) for r, b in pairs]


def test_hosts(spark):
    pairs = [("https://a.com/x", "http://A.com:8080"), ("https://b.a.com", "https://a.com"), ("https://a.com", "https://b.a.com"), ("/x", "y"), ("https://xa.com", "https://a.com")]
    assert values(spark, U.is_same_host(A, B), pairs) == [True, False, False, True, False]
    assert values(spark, U.is_subdomain(A, B), pairs) == [False, True, False, False, False]


def test_should_crawl(spark):
    pairs = [("https://a.com/p", "https://a.com"), ("https://a.com/p.PNG", "https://a.com"), ("https://w.a.com/", "https://a.com"), ("ftp://a.com/", "https://a.com"), ("https://a.com/x.tar.gz/", "https://a.com"), ("https://a.com/foo.png/", "https://a.com")]
    assert values(spark, U.should_crawl(A, B), pairs) == [True, False, False, False, False, False]
    assert values(spark, U.should_crawl(A, B, True), pairs)[2] is True


def test_strip_tracking(spark):
    urls = ["https://e.com/?utm_source=x&UTM_Medium=y&b=2&a=1#f", "https://e.com/?fbclid=1", "https://e.com/p", "https://e.com/p;x?gclid=1&z"]
    assert values(spark, U.strip_tracking(A), urls) == ["https://e.com/?a=1&b=2#f", "https://e.com/", "https://e.com/p", "https://e.com/p;x?z="]
    assert values(spark, U.strip_tracking(A, ()), urls) == urls


def test_schemes_and_skips(spark):
    urls = [" MailTo:a@b", "data:x", "blob:y", "ftp://z", "#a", "", "/p", "https://e.com"]
    assert values(spark, U.is_excluded_scheme(A), urls) == [True, True, True, True, False, False, False, False]
    assert values(spark, U.is_skipped(A), urls) == [True, True, False, False, True, True, False, False]


def test_exclusions(spark):
    urls = ["https://e.com/admin/x", "https://e.com/a.TAR.GZ?x", "https://e.com/?x=/admin/"]
    assert values(spark, U.is_excluded_path(A, ("/admin/",)), urls) == [True, False, True]
    assert values(spark, U.has_excluded_extension(A, (".tar.gz",)), urls) == [False, True, False]


def test_everything_stays_on_the_jvm(spark):
    df = spark.createDataFrame([("https://e.com/",)], "a string").select(U.strip_tracking(U.normalise(A)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
