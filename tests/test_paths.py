import posixpath

import pytest
from pyspark.sql import functions as F

from weftline.config import safe_project_name
from weftline.functions import paths as P

from .helpers import values

@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(A=F.col("a"), B=F.col("b"))


def test_relative_file(spark):
    urls = ["https://e.com/", "https://e.com/a/b.html", "https://e.com/a/b", "https://e.com/a//b/", "https://e.com/x?q=1", "https://e.com/a.b/c:d.e|f.png?q=1", "https://e.com/a/./b.css"]
    got = values(spark, P.relative_file(A), urls)
    assert got[:4] == ["index.html", "a/b.html", "a/b/index.html", "a/b/index.html"]
    assert got[4].startswith("x/index_q") and got[4].endswith(".html") and len(got[4]) == len("x/index_q0123456789.html")
    assert got[5].startswith("a.b/c_d.e_f_q") and got[5].endswith(".png")
    assert got[6] == "a/b.css"


def test_save_path(spark):
    start = "https://e.com/start/"
    urls = ["https://e.com/", "https://e.com/start", "https://e.com/about", "https://e.com/css/s.css", "https://cdn.com:81/l.js", "/x.htm", "https://e.com/v1.2", "https://e.com/?p=1"]
    want = ["index.html", "index.html", "pages/about/index.html", "assets/css/s.css", "external/cdn.com/l.js", "pages/x.htm", "assets/v1.2", "index.html"]
    assert values(spark, P.save_path(A, F.lit(start)), urls) == want


def test_relative_path_is_relpath(spark):
    files = ["index.html", "pages/a.html", "pages/about/index.html", "assets/css/s.css", "external/h/x/y.js"]
    pairs = [(a, b) for a in files for b in files]
    assert values(spark, P.relative_path(A, B), pairs) == [posixpath.relpath(b, posixpath.dirname(a) or ".") for a, b in pairs]


def test_project_name(spark):
    names = ["plain", " a/b:c ", "", "///", None, "CON", "com1", "foo. .", "日本", "06/https://x.org", "a\x01b"]
    want = ["plain", "a_b_c", "weftline_project", "weftline_project", "weftline_project", "CON_", "com1_", "foo", "日本", "06_https___x.org", "a_b"]
    assert values(spark, P.project_name(A), names) == want == [safe_project_name(n) for n in names]


def test_rewritable(spark):
    assert values(spark, P.is_rewritable(A), ["a.html", "b.PHP", "c.css", "d.png", "e"]) == [True, True, True, False, False]
